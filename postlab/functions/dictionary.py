"""Row-local dictionaries: one value for all rows, looked up by hash inside an expression.

A dictionary frame becomes an array of small maps, the bucket of a key being its
hash. The array is a scalar subquery: computed once, sent to the executors with the
plan, read by reference in every row. A look-up searches one map of a few entries, so rows
need no join, no shuffle and no key of their own. Only for frames of a checked size; see
``fits``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.binding import let
from postlab.session import measured_bytes

TABLE_BYTES = 16 * 1024 * 1024
ENTRIES = 2  # of a bucket, on average
TABLE = "_table"


def fits(df: DataFrame, limit: int = TABLE_BYTES) -> bool:
    """Whether a dictionary may travel with the plan."""
    return limit > 0 and measured_bytes(df) <= limit


class Dictionary:
    """``key, value`` rows as one value; keys are distinct and not null."""

    def __init__(self, entries: DataFrame, key: str, value: str):
        spark = entries.sparkSession
        self.buckets = max(entries.count() // ENTRIES, 1)
        own = entries.select(self._bucket(F.col(key)).alias("bucket"), F.struct(
            F.col(key).alias("k"), F.col(value).alias("v")).alias("entry"))
        lists = own.groupBy("bucket").agg(F.collect_list("entry").alias("entries"))
        every = spark.range(self.buckets).withColumnRenamed("id", "bucket")
        filled = every.join(lists, "bucket", "left").select("bucket", F.coalesce(
            "entries", F.array().cast(lists.schema["entries"].dataType)).alias("entries"))
        # One row of a checked size.
        self.table = filled.agg(F.transform(
            F.array_sort(F.collect_list(F.struct("bucket", "entries"))),
            lambda x: F.map_from_entries(x["entries"])).alias("t")).scalar()

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def add(self, df: DataFrame, name: str, body: Callable[[Callable[[Column], Column]], Column]) -> DataFrame:
        """``df`` with ``body(look)`` as a column; ``look(key)`` is the key's value or NULL.

        ``look`` may be used inside lambdas. The table enters by a projection of its own, which the
        optimizer merges with the one that reads it, so no row ever holds it.
        """
        return df.withColumn(TABLE, self.table).withColumn(name, let(F.col(TABLE), lambda table: body(
            lambda key: F.try_element_at(F.get(table, self._bucket(key)), key)))).drop(TABLE)
