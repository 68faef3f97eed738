"""Seeded sampling, balancing, shuffling and fold assignment.

Every choice is made by the order of ``md5(seed|id)``, so results have an exact
size, repeat for a seed and do not depend on partitioning. That order is total
over the table, but no task ever sees the whole of it: rows fall into buckets by
hash prefix, bucket sizes are counted first, and only rows inside one bucket are
ranked against each other. Buckets are even whatever the class sizes are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PREFIX = 4  # hex digits: 65,536 buckets


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return (df.withColumn("_hash", hash_order(key, seed))
              .withColumn("_bucket", F.substring("_hash", 1, PREFIX)))


def keep_exactly(df: DataFrame, quota: Callable[[Column], Column], key: str = "id",
                 seed: int = 123) -> DataFrame:
    """Keep the first ``quota(total)`` rows in hash order.

    Buckets that fit entirely are passed by a filter; only the one bucket the
    quota ends in is ranked.
    """
    hashed = _hashed(df, key, seed)
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("size"))
    # At most 16**PREFIX rows reach these two windows.
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = sizes.select(
        "_bucket", F.sum("size").over(upto).alias("upto"),
        quota(F.sum("size").over(Window.partitionBy())).alias("quota"))
    fits = F.col("upto") <= F.col("quota")
    border = running.agg(F.struct(
        F.min(F.when(~fits, F.col("_bucket"))).alias("bucket"),
        (F.max("quota") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("left"),
    ).alias("b")).scalar()
    marked = hashed.withColumn("_border", border)
    whole = marked.filter(
        F.col("_border.bucket").isNull() | (F.col("_bucket") < F.col("_border.bucket")))
    ranked = (
        marked.filter(F.col("_bucket") == F.col("_border.bucket"))
        .withColumn("_rank", F.row_number().over(
            Window.partitionBy("_bucket").orderBy("_hash", key)))
        .filter(F.col("_rank") <= F.col("_border.left")))
    return whole.select(*df.columns).unionByName(ranked.select(*df.columns))


def rank_by_hash(df: DataFrame, key: str = "id", seed: int = 123,
                 by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Rank 1..n in hash order, over the table or within each group of ``by``.

    The ranked side is shuffled once, by ``(by, bucket)``; the join with bucket
    offsets reuses that partitioning. ``by`` columns must not be NULL.
    """
    hashed = _hashed(df, key, seed)
    cell = [*by, "_bucket"]
    before = (Window.partitionBy(*by).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (hashed.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
               .select(*cell, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("_hash", key))
    return (hashed.withColumn("_inside", inside).join(offsets, cell)
            .select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name)))


def sample_fraction(df: DataFrame, fraction: float = 0.01, key: str = "id",
                    seed: int = 123) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows, ties to even."""
    return keep_exactly(
        df, lambda total: F.bround(total * F.lit(float(fraction))).cast("bigint"), key, seed)


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def downsample(df: DataFrame, column: str, value: str, n: int | Column, key: str = "id",
               seed: int = 123) -> DataFrame:
    """Keep ``n`` rows of one class and every row of the others."""
    count = F.lit(n) if isinstance(n, int) else n
    chosen = F.col(column).eqNullSafe(value)
    kept = keep_exactly(df.filter(chosen), lambda total: count.cast("bigint"), key, seed)
    return kept.unionByName(df.filter(~chosen))


def balance_to_minority(df: DataFrame, column: str, majority: str, minority: str,
                        key: str = "id", seed: int = 123) -> DataFrame:
    """Cut the majority class to the size of the minority class."""
    size = df.filter(F.col(column) == minority).agg(F.count(F.lit(1)).alias("n")).scalar()
    return downsample(df, column, majority, size, key, seed)


def shuffle(df: DataFrame, key: str = "id", seed: int = 123, batch_size: int = 16) -> DataFrame:
    """A random order as columns: ``position`` (from 1) and ``batch_id`` (from 0)."""
    return (rank_by_hash(df, key, seed, name="position")
            .withColumn("batch_id", F.floor((F.col("position") - 1) / batch_size)))


def assign_folds(df: DataFrame, label: str, k: int, key: str = "id", seed: int = 123) -> DataFrame:
    """Stratified folds 0..k-1: within a class, fold sizes differ by at most one."""
    return (rank_by_hash(df, key, seed, by=(label,), name="_rank")
            .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
            .drop("_rank"))


def shuffle_splits(df: DataFrame, repetitions: int, test_size: float, key: str = "id",
                   seed: int = 0) -> DataFrame:
    """One row per post and repetition with ``part`` in ``tune`` / ``evaluate``.

    The evaluation part takes ``ceil(test_size * n)`` rows.
    """
    copies = (df.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
                .withColumn("_draw", F.concat_ws("|", "repetition", F.col(key))))
    ranked = rank_by_hash(copies, "_draw", seed, by=("repetition",), name="_rank")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    test_rows = F.ceil(total * F.lit(float(test_size)))
    return (ranked.withColumn("part", F.when(F.col("_rank") <= test_rows, "evaluate")
                              .otherwise("tune"))
            .drop("_rank", "_draw"))
