"""Terms that reach a share of all posts, found before any term is shuffled.

A term in p percent of all posts is in p percent of the posts of at least one task. Each task
counts with a bounded error (lossy counting): from time to time all its counts go down by
the same number and terms at zero are forgotten, and those losses stay below half of p
percent of the posts seen. So its summary misses no such term, and its size depends on
p and on the length of posts, not on the vocabulary. Candidates of all tasks are recounted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.session import ship_package

COUNTS = pa.schema([("term", pa.string()), ("n", pa.int64())])


def summary(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Terms that may be in ``percent`` of the posts of a task; a batch holds term lists."""
    counts, posts, lost = COUNTS.empty_table(), 0, 0
    for batch in batches:
        posts += batch.num_rows
        found = pc.value_counts(pc.drop_null(pc.list_flatten(batch.column(0)).cast(pa.string())))
        new = pa.table([found.field("values"), found.field("counts")], schema=COUNTS)
        both = pa.concat_tables([counts, new]).group_by("term").aggregate([("n", "sum")])
        counts = pa.table([both["term"], both["n_sum"]], schema=COUNTS)
        step = posts * percent // 200 - lost
        if step > 0:
            kept = counts.filter(pc.greater(counts["n"], step))
            counts = pa.table([kept["term"], pc.subtract(kept["n"], step)], schema=COUNTS)
            lost += step
    reached = pc.greater_equal(pc.multiply(pc.add(counts["n"], lost), 100), posts * percent)
    yield from counts.filter(reached).select(["term"]).to_batches()


def candidates(df: DataFrame, tokens: str, percent: int) -> DataFrame:
    """``term``: all terms of at least ``percent`` (1 to 100) of the posts, and a few others."""
    ship_package(df.sparkSession)
    distinct = df.select(F.array_distinct(tokens).alias("terms"))
    return distinct.mapInArrow(lambda it: summary(it, percent), "term string").distinct()
