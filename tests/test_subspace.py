"""Principal directions of wide vectors against the exact ones."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlab.operators import lexicon as L
from postlab.operators import linear as N
from postlab.operators.subspace import principal_directions


def frame(spark, x):
    rows = [(i, Vectors.dense(v.tolist()) if i % 2 else Vectors.sparse(
        len(v), np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "lexicon"]).repartition(3).persist()


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(4)
    made = rng.normal(size=(200, 5)) * [9, 7, 5, 3, 2] @ rng.normal(size=(5, 40)) + rng.normal(size=(200, 40)) * 0.1
    return np.where(rng.random(made.shape) < 0.2, 0, made) + 3 * (np.arange(40) % 3 == 0)


@pytest.mark.parametrize("piece, driver", [(1 << 16, 1 << 21), (50, 0)])
def test_directions_equal_the_exact_ones(spark, x, monkeypatch, piece, driver):
    monkeypatch.setattr(N, "PIECE", piece)
    monkeypatch.setattr(N, "DRIVER_CELLS", driver)
    rounds = 60 if driver else 3
    got, mean = principal_directions(frame(spark, x), 3, 40, "lexicon", rounds)
    exact = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3].T
    assert mean == pytest.approx(x.mean(0))
    assert np.abs(np.diag(got.T @ exact)) == pytest.approx(np.ones(3), abs=1e-5 if driver else 0.05)


def test_wide_and_narrow_vectors_get_the_same_scores(spark, x):
    df = frame(spark, x)
    wide = {r.id: np.abs(r.reduced.toArray()) for r in L.reduce_vector(df, 2, narrow=10).collect()}
    for r in L.reduce_vector(df, 2).collect():
        assert wide[r.id] == pytest.approx(np.abs(r.reduced.toArray()), abs=1e-3)


def test_fifty_thousand_columns(spark):
    """Two directions that two far columns carry; no matrix of all columns would fit."""
    rows = [(i, Vectors.sparse(50_000, [3, 49_999], [float(i % 5), 10.0 * (i % 2)])) for i in range(100)]
    df = spark.createDataFrame(rows, ["id", "lexicon"]).coalesce(2)
    got, _ = principal_directions(df, 2, 50_000, "lexicon")
    assert abs(got[49_999, 0]) > 0.99 and abs(got[3, 1]) > 0.99
    assert {len(r.reduced) for r in L.reduce_vector(df, 2).select("reduced").collect()} == {2}


def test_null_vectors_stay_null(spark, x):
    df = frame(spark, x[:50])
    some = df.withColumn("lexicon", F.when(F.col("id") > 2, F.col("lexicon")))
    got = {r.id: r.reduced for r in L.reduce_vector(some, 2, narrow=10).collect()}
    assert len(got) == 50 and [i for i in got if got[i] is None] and all(got[i] is None for i in (0, 1, 2))
