"""Readers for post tables and the auxiliary labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.operators.tables import filter_language, select_columns
from postlab.sources.splittable import parse_records, read_records


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


NULL_MARK = "\x01"

# Ids are zero-padded strings; no type is ever inferred.
POSTS = _strings("test_case", "id", "source", "language", "text", "task1", "task2")
LABELS = ("task1", "task2")


def read_delimited(spark: SparkSession, path: str, sep: str,
                   schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """Delimited text with doubled-quote escaping, every column a string.

    Without a schema the header names the columns; a file without a header needs
    one. ``multiline`` keeps quoted newlines but makes every file one split;
    ``read_quoted`` cuts large files. Without quoted newlines, switch it off and files
    split as usual.
    """
    reader = (
        spark.read.option("sep", sep).option("header", schema is None)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        # An empty field is NULL, a quoted empty field is an empty text. With the
        # default mark, which is empty itself, both would be NULL.
        .option("nullValue", NULL_MARK).option("emptyValue", ""))
    # Files of a folder whose header differs from the first one's fail instead of shifting columns.
    read = reader if schema is None else reader.schema(schema)
    return read.option("enforceSchema", schema is not None).csv(path)


def read_quoted(spark: SparkSession, path: str, sep: str,
                schema: T.StructType | None = None) -> DataFrame:
    """The rows of ``read_delimited`` with quoted newlines, but large files are cut into ranges.

    Lines end with a newline, before which one carriage return is dropped; inside of quotes
    both stay. A file's first line is its header. Files need UTF-8. It takes three passes
    over the text, so it pays where files are few and larger than a split.
    """
    plain = read_delimited(spark, path, sep, schema)
    records = read_records(spark, path, sep)
    if records is None:
        return plain
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n",
               "nullValue": NULL_MARK, "emptyValue": ""}
    return parse_records(records, plain.columns, options, schema is None)


def _read_table(spark: SparkSession, path: str, sep: str, multiline: bool, split: bool) -> DataFrame:
    if split:
        return read_quoted(spark, path, sep)
    return read_delimited(spark, path, sep, multiline=multiline)


def write_delimited(df: DataFrame, path: str, sep: str, header: bool = True) -> str:
    """The writing side of ``read_delimited``: nothing is trimmed, quotes are doubled."""
    (df.write.mode("overwrite")
       .option("sep", sep).option("header", header)
       .option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))
    return path


def read_posts(spark: SparkSession, path: str, language: str | None = None,
               multiline: bool = True, split: bool = False) -> DataFrame:
    """Tab-separated posts, optionally of one language.

    ``split`` reads few large files by ``read_quoted``. Files may hold further columns, in any order that all of them share. Test files may
    lack the labels, which are NULL then. No language means all rows.
    """
    raw = _read_table(spark, path, "\t", multiline, split)
    unlabelled = {c: F.lit(None).cast("string") for c in LABELS if c not in raw.columns}
    return filter_language(select_columns(raw.withColumns(unlabelled), POSTS.names), language)


def read_aux_labels(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Labels hold no line breaks, so files split unless ``multiline`` is asked for."""
    return select_columns(read_delimited(spark, path, ";", multiline=multiline),
                          ["status_id", "categoria"])


def read_aux_features(spark: SparkSession, path: str,
                      columns: tuple[str, ...] = ("status_id", "text"),
                      multiline: bool = True, split: bool = False) -> DataFrame:
    return select_columns(_read_table(spark, path, ",", multiline, split), list(columns))
