"""Readers for term lists; every layout ends in one normalised table.

``lexicon(name, category, level, term, replacement)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.operators.tables import select_columns
from postlab.sources.posts import _strings, read_delimited

# Separator, columns of a file without a header, and which file
# column feeds which column of the table. Files with a header are read by name.
LAYOUTS = {
    "category": ("\t", None, {"category": "category", "level": "level", "term": "lemma"}),
    "category_plain": ("\t", ("category", "stereotype", "word"),
                       {"category": "category", "term": "word"}),
    "polarity": ("\t", None, {"term": "Words"}),
    "terms": (",", None, {"term": "term"}),
    "terms_tab": ("\t", None, {"term": "term"}),
    "slang": ("\t", ("word", "label"), {"term": "word", "replacement": "label"}),
}
COLUMNS = ("category", "level", "term", "replacement")


def read_lexicon(spark: SparkSession, path: str, layout: str, name: str,
                 multiline: bool = False) -> DataFrame:
    """Terms hold no line breaks, so files split unless ``multiline`` is asked for."""
    sep, columns, mapping = LAYOUTS[layout]
    raw = read_delimited(spark, path, sep, schema=_strings(*columns) if columns else None,
                         multiline=multiline)
    found = select_columns(raw, list(mapping.values()))
    return found.select(
        F.lit(name).alias("name"),
        *[(F.col(mapping[c]) if c in mapping else F.lit(None).cast("string")).alias(c)
          for c in COLUMNS])
