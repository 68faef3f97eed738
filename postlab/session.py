"""Session-level helpers: shared folder, input spreading, size-checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from pathlib import Path
from threading import Lock

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 500_000
RANGE_ROWS = 2_000_000  # that one task sorts
HOT_ROWS = 10_000  # of one key, that one task joins


def workspace(spark: SparkSession) -> str:
    """A fresh folder below the shared one that ``spark.checkpoint.dir`` names.

    Unset, a cluster uses the warehouse, which its executors share as well; a
    session whose executor is the driver itself (tests) uses a temporary folder.
    All folders of an application lie below one that goes when Python ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        inside = spark.sparkContext._jsc.sc().isLocal()
        shared = _own_scratch() if inside else spark.conf.get("spark.sql.warehouse.dir")
    top = f"{shared.rstrip('/')}/postlab-{spark.sparkContext.applicationId}"
    _remove_at_exit(top)
    return f"{top}/{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="postlab-")


@lru_cache(maxsize=None)
def _remove_at_exit(folder: str) -> None:
    def remove() -> None:
        context = SparkContext._active_spark_context
        if context is not None and context._jsc is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)


ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS, SPARKS_ROWS = "1000", "10000"
SHIPPING = Lock()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, as ``--py-files`` would.

    Rows here are whole documents, so Spark's default Arrow batch would hold tens of
    megabytes in the executor and in its workers; a session that has not chosen
    another size gets smaller ones.
    """
    with SHIPPING:  # fits may run side by side
        _ship_once(spark.sparkContext.applicationId)
    if spark.conf.get(ARROW_BATCH) == SPARKS_ROWS:
        spark.conf.set(ARROW_BATCH, ARROW_ROWS)


@lru_cache(maxsize=None)
def _ship_once(application: str) -> None:
    package = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="postlab-")
    atexit.register(folder.cleanup)
    archive = Path(folder.name) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    SparkContext._active_spark_context.addPyFile(str(archive))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the input has fewer splits than the cluster has cores.

    A small file arrives as one task; a large input already has many and is left
    alone, so this adds no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame while several passes read it; a frame already kept stays as it is."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _width(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(32) + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType):
        sizes = F.transform(column, lambda x: _width(x, kind.elementType).cast("bigint"))
        whole = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.lit(32) + F.coalesce(whole, F.lit(0))
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(column), T.ArrayType(kind.keyType)) + _width(
            F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [_width(column[f.name], f.dataType) for f in kind.fields],
                      F.lit(16))
    if isinstance(kind, T.UserDefinedType):
        return F.lit(32) + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Rough in-memory size of a frame, nested values included, from one aggregate over it."""
    row = reduce(Column.__add__, [_width(F.col(f"`{f.name}`"), f.dataType)
                                  for f in df.schema.fields], F.lit(16))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def settle(df: DataFrame) -> DataFrame:
    """Write a derived frame to the shared folder and read it back.

    Cuts lineage and lets a frame be measured and joined without computing it
    twice; the files outlive lost executors.
    """
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing reads any more."""
    spark = df.sparkSession
    context = spark.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/postlab-{context.applicationId}/" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_ranges(source: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """A settled frame in range partitions, numbered in ``name``, as many as its rows need.

    Written again, so that whatever is counted and ranked speaks of the same partitions.
    Windows over ``name`` then run in as many tasks.
    """
    usual = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, -(-source.count() // RANGE_ROWS))
    placed = settle(source.repartitionByRange(parts, *order)
                    .withColumn(name, F.spark_partition_id()))
    return placed if parts == usual else placed.repartition(parts, name)


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in a total order, without one task that sees them all.

    Range partitions number their own rows; the numbers in front of each come from
    the partitions' sizes, one row per partition.
    """
    # Counted and sampled for its ranges from files, so the frame is computed once.
    source = settle(df)
    placed = in_ranges(source, *order, name="_part")
    removed(source)
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (placed.withColumn("_own", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_own") - 1)
            .drop("_part", "_own", "_before"))


def join_sized(big: DataFrame, small: DataFrame, keys: str | list[str], how: str = "inner",
               small_rows: int | None = None, limit: int = BROADCAST_BYTES,
               salts: int = 32) -> DataFrame:
    """Equi-join on a key that may be hot in ``big`` and is unique in ``small``.

    ``small`` is broadcast when ``small_rows``, an upper bound the caller can
    prove, is low enough, or else when it measures within ``limit`` bytes. Beyond
    that nothing of it is broadcast: both sides are shuffled and sorted, and keys with
    more than ``HOT_ROWS`` rows in ``big`` are salted, which spreads them over
    ``salts`` tasks. The rows are the same either way.
    """
    keys = [keys] if isinstance(keys, str) else keys
    proven = small_rows is not None and small_rows <= BROADCAST_ROWS
    if proven or measured_bytes(small) <= limit:
        return big.join(F.broadcast(small), keys, how)
    # One key at most in HOT_ROWS rows; null keys find nothing, but may be many.
    hot = settle(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
                 .dropna(subset=keys).select(*keys, F.lit(True).alias("_hot")))
    own = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    several = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    copies = small.withColumn("_salt", F.lit(0))
    if not hot.isEmpty():
        several = several | F.col("_hot").isNotNull()
        big = big.join(F.broadcast(hot), keys, "left")
        every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        copies = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    salted = big.withColumn("_salt", F.when(several, own).otherwise(0)).drop("_hot")
    # Spark takes the size of a file for that of its rows and would broadcast many times that.
    return salted.join(copies.hint("shuffle_merge"), [*keys, "_salt"], how).drop("_salt")
