"""Leading principal directions of a wide sparse vector column, without a columns x columns matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.operators.linear import PARTS, _blocks, _pieces, _summed, sparse_rows
from postlab.session import cached, ship_package

EXTRA = 10  # directions beyond the wanted ones; the more, the faster the rest settles
ROUNDS, TOLERANCE = 60, 1e-10


def principal_directions(df: DataFrame, k: int, columns: int, features: str = "features",
                         rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``directions (columns x k), mean``: randomised subspace iteration, centred implicitly.

    A pass multiplies the rows with a basis of ``k + EXTRA`` directions and back; tasks keep sums
    of that size, which is all that reaches the driver. It ends when the variances along the
    wanted directions stand still, or after ``rounds`` passes. The sign of a direction is the one
    that makes its largest component positive.
    """
    ship_package(df.sparkSession)
    context = df.sparkSession.sparkContext
    width = min(k + EXTRA, columns)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    before = None
    rows = sparse_rows(df.filter(F.col(features).isNotNull()).withColumn("_none", F.array(F.lit(0))),
                       features, "_none")
    with cached(rows):
        parts = rows.rdd.getNumPartitions()
        for _ in range(rounds):
            sent = context.broadcast(basis)

            def product(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                towards = sent.value
                # Products, then sums of the columns, then the number of rows.
                sums = np.zeros((columns + 1, towards.shape[1] + 1))
                for batch in batches:
                    for n, used, cells, _ in _blocks(batch, towards.shape[1]):
                        sums[used, :-1] += cells.T @ (cells @ towards[used])
                        sums[used, -1] += cells.sum(0)
                        sums[-1, -1] += n
                yield from _pieces(sums)

            sums = _summed(rows.mapInArrow(product, PARTS), parts, (columns + 1) * (width + 1))
            sent.unpersist()
            sums = sums.reshape(columns + 1, width + 1)
            n, mean = max(sums[-1, -1], 1.0), sums[:-1, -1] / max(sums[-1, -1], 1.0)
            moved = sums[:-1, :-1] / n - np.outer(mean, mean @ basis)
            spread, turn = np.linalg.eigh((basis.T @ moved + moved.T @ basis) / 2)
            spread, turn = spread[::-1], turn[:, ::-1]
            directions = (basis @ turn)[:, :k]
            if before is not None and np.abs(spread[:k] - before).max() <= TOLERANCE * max(spread[0], 1e-300):
                break
            before = spread[:k]
            basis = np.linalg.qr(moved)[0]
    largest = directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])]
    return directions * np.where(largest < 0, -1.0, 1.0), mean


def projected(vector: Column, directions: np.ndarray, mean: np.ndarray) -> Column:
    """Centred scores of a vector along the directions, as an array; NULL stays NULL."""
    sent = SparkSession.active().sparkContext.broadcast((directions, mean @ directions))

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        towards, shift = sent.value
        for indices, values in batches:
            yield pd.Series([
                None if v is None else np.asarray(v) @ (towards if i is None else towards[i]) - shift
                for i, v in zip(indices, values)], dtype=object)

    raw = F.unwrap_udt(vector)
    return scores(raw["indices"], raw["values"])
