"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are range-partitioned by id. Each partition sums its bytes; the prefix sum
over those totals (one row per partition) tells every row how many bytes come
before it in the whole table, and equal targets cut that line. Only ids and sizes
are shuffled, never texts, and no shard or key gathers in one task: ranges are as many as
the rows need, and rows equal in everything are cut between by their place in the input.

Null text has no bytes (size 1). Null ids come first. Equal ids follow one another
in the order of size and checksum; rows equal in all of these are interchangeable.
A row longer than a target covers several of them, and the shards it skips stay
empty. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.session import in_ranges, removed, settle


def sizes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(id).alias("doc_id"), (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"))


def prefix_sums(sized: DataFrame) -> DataFrame:
    """Add ``before`` (bytes), ``position`` (rows) in front of each row, and ``total`` bytes."""
    order = ["doc_id", "size", "text_crc32"]
    # Written first, so texts are read once and places do not change.
    source = settle(sized.withColumn("place", F.monotonically_increasing_id()))
    placed = in_ranges(source, *order, "place", name="part")
    removed(source)
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"),
                                        F.count(F.lit(1)).alias("rows"))
    # One row per partition, so the single-task window and the broadcast are bounded.
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order, "place")
    local = placed.withColumns({
        "local": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "number": F.row_number().over(inside)})
    return local.join(F.broadcast(offsets), "part").select(
        *order, "part", (F.col("bytes_before") + F.col("local") - F.col("size")).alias("before"),
        (F.col("rows_before") + F.col("number") - 1).alias("position"), "total")


def shard_by_bytes(df: DataFrame, shards: int = 16, id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: the shard in which a row's first byte lies."""
    summed = prefix_sums(sizes(df, id, text)).withColumn(
        "shard", F.expr(f"cast(before * {shards} div total as int)"))
    first = summed.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return summed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
