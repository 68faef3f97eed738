"""Centroid clustering of integer vectors with an incremental distance matrix.

Each vector keeps its exact dot product with every centroid. A centroid that moves
changes some of its components; only those are multiplied with the vectors and added to
the stored products, a centroid that stays costs nothing. The distance follows as
``|v|^2 - 2 v.c + |c|^2``, all in integers, and the nearest centroid (ties: the smaller
number) is found anew. Products, clusters and vectors are a written table of each
round, so a lost executor repeats one round's work, not all. The table before the last
one is removed.

Centroids start as the kept vectors whose ids have the smallest hashes and move to the
floored mean of their vectors; an empty one stays. Per round, ``k`` sums of components
reach the driver and ``k`` centroids go back; ``k`` and the dimension are parameters, so
neither grows with the table.

Vectors of another length, or with a null, NaN or infinite component, are left out, as
are null vectors. A null id counts as the empty string; among equal ids the smaller
vector comes first, and repeated rows may start several centroids, of which the first
takes the vectors. Fewer vectors than centroids give as many centroids as vectors; none
give no rows. Components beyond ``most(dimensions)`` would leave 64 bits and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.session import removed, settle, ship_package

K = 8
DIMENSIONS = 64
ROUNDS = 10
SEED = 3
SCALE = 1024


def most(dimensions: int) -> int:
    """Largest component whose squared distances stay within 62 bits."""
    return 1 << (60 - dimensions.bit_length()) // 2


def integers(df: DataFrame, id: str = "vec_id", vector: str = "embedding",
             dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the kept vectors as ``floor(scale * x)``."""
    x = F.col(vector).cast("array<double>")
    kept = df.select(F.col(id).alias("vec_id"), x.alias("x")).filter(
        F.col("x").isNotNull() & (F.size("x") == dimensions)).filter(
            F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(text.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def flat(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def moved_products(products: np.ndarray, vectors: np.ndarray, before: np.ndarray,
                   after: np.ndarray) -> np.ndarray:
    """Dot products with the centroids ``after``, from those with ``before``."""
    products = products.copy()
    for j, change in enumerate(after - before):
        some = np.flatnonzero(change)
        if len(some):
            products[:, j] += vectors[:, some] @ change[some]
    return products


def nearest(products: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number first."""
    distance = norms[:, None] - 2 * products + (centroids * centroids).sum(1)
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(distance)), cluster]


def assigned(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state with products, clusters and distances for the centroids ``after``."""
    spark, (k, width) = state.sparkSession, after.shape
    sent = spark.sparkContext.broadcast((before, after))

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = sent.value
        for batch in batches:
            vectors = flat(batch.column("v"), width)
            products = (flat(batch.column("products"), k) if "products" in batch.schema.names
                        else np.zeros((len(vectors), k), np.int64))
            products = moved_products(products, vectors, old, new)
            cluster, distance = nearest(products, (vectors * vectors).sum(1), new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), lists(products),
                 pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "v", "products", "cluster", "distance"])

    schema = T.StructType([state.schema["vec_id"], state.schema["v"],
                           T.StructField("products", T.ArrayType(T.LongType())),
                           T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return state.mapInArrow(update, schema)


def sums(state: DataFrame, width: int) -> DataFrame:
    """``cluster, n, inertia, sums``: one row per task and cluster."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            vectors = flat(batch.column("v"), width)
            distance = batch.column("distance").to_numpy()
            for j in np.unique(cluster).tolist():
                own = cluster == j
                # Python's integers, as a task's sum may leave 64 bits.
                part = [int(own.sum()), sum(distance[own].tolist()), *map(int, vectors[own].sum(0))]
                total[j] = [a + b for a, b in zip(total.get(j, [0] * len(part)), part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([[str(x) for x in t] for t in total.values()],
                                                         pa.list_(pa.string()))], ["cluster", "parts"])

    return state.select("v", "cluster", "distance").mapInArrow(add, "cluster int, parts array<string>")


def totals(state: DataFrame, k: int, width: int) -> list[list[int]]:
    """Count, inertia and component sums of every cluster, exact."""
    # At most k rows per task, added up by Spark to k rows of decimals.
    each = sums(state, width).groupBy("cluster").agg(*[
        F.sum(F.col("parts")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width + 2)])
    out = [[0] * (width + 2) for _ in range(k)]
    for row in each.collect():
        out[row["cluster"]] = [int(x) for x in row[1:]]
    return out


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K,
            dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = SEED,
            scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, products`` per kept vector."""
    spark = df.sparkSession
    ship_package(spark)
    state = settle(integers(df, id, vector, dimensions, scale))
    largest = state.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if largest is not None and largest > most(dimensions):
        raise ValueError(f"a component of {largest} leaves the integers of 64 bits; the most is {most(dimensions)}")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.select("vec_id", F.lit(0).alias("cluster"), *(
            F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")),
            F.lit("").alias("centroid_sha256"), F.array().cast("array<long>").alias("products"))
    before = np.zeros_like(centroids)
    for round_ in range(rounds + 1):
        earlier, state = state, settle(assigned(state, before, centroids))
        removed(earlier)
        found = totals(state, len(centroids), dimensions)
        if round_ < rounds:
            before = centroids
            centroids = np.array([[x // n for x in rest] if n else old.tolist()
                                  for (n, _, *rest), old in zip(found, centroids)], np.int64)
    whole = sum(t[1] for t in found)
    ends = spark.createDataFrame(pd.DataFrame({
        "cluster": range(len(centroids)), "cluster_inertia": [t[1] for t in found], "inertia": whole,
        "centroid_sha256": [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
                            for c in centroids.tolist()]}),
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid.
    return state.join(F.broadcast(ends), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "products")
