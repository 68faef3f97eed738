"""Many linear models per pass: each equals the fit it would get alone."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlab.operators import linear as N
from postlab.operators import models as M


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * [1, 1, 20, 0.1, 1, 1]
    x[:, 5] = 0  # a constant column
    x[rng.random(x.shape) < 0.3] = 0
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.05 * x[:, 2] + rng.normal(size=300) > 0.3).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    """Dense and sparse vectors mixed."""
    made = []
    for i, (v, t) in enumerate(zip(*data)):
        places = np.flatnonzero(v).tolist()
        vector = Vectors.dense(v.tolist()) if i % 2 else Vectors.sparse(6, places, v[places].tolist())
        made.append((str(i), vector, float(t)))
    return spark.createDataFrame(made, ["id", "features", "label"]).repartition(3).persist()


def one_task(y, penalty, weight=(1.0, 1.0)):
    return N.LinearTask(penalty, np.array(weight), np.array([False, True]),
                        float(np.array(weight) @ np.bincount(y.astype(int), minlength=2)))


def fitted(rows, tasks, loss, **kw):
    coded = N.sparse_rows(rows.withColumn("codes", F.array(F.col("label").cast("int")))).persist()
    return N.fit_linear(coded, tasks, 6, N.column_scale(rows), loss, **kw)


def objective(model, x, y, penalty, loss, weight=(1.0, 1.0)):
    t, w = 2 * y - 1, np.array(weight)[y.astype(int)]
    z = t * (x @ model[:-1] + model[-1])
    value = np.logaddexp(0, -z) if loss == "logistic" else np.maximum(0, 1 - z)
    return (w * value).sum() / w.sum() + penalty / 2 * model[:-1] @ model[:-1]


def test_logistic_models_equal_the_librarys(rows, data):
    settings = [(p, w) for p in (1e-3, 0.1) for w in ((1.0, 1.0), (0.7, 1.9))]
    got = fitted(rows, [one_task(data[1], p, w) for p, w in settings], "logistic", tolerance=1e-9)
    for model, (p, w) in zip(got, settings):
        weighted = rows.withColumn("w", F.when(F.col("label") > 0, w[1]).otherwise(w[0]))
        own = M.LogisticRegression(regParam=p, tol=1e-9, maxIter=200, standardization=False,
                                   weightCol="w").fit(weighted)
        assert model[:-1] == pytest.approx(own.coefficients.toArray(), abs=1e-4)
        assert model[-1] == pytest.approx(own.intercept, abs=1e-4)


def test_hinge_models_reach_the_librarys_loss(rows, data):
    x, y = data
    for p, model in zip((1e-3, 0.1), fitted(
            rows, [one_task(y, p) for p in (1e-3, 0.1)], "hinge", tolerance=1e-4, max_iter=60)):
        own = M.LinearSVC(regParam=p, standardization=False, maxIter=60, tol=1e-6).fit(rows)
        best = objective(np.append(own.coefficients.toArray(), own.intercept), x, y, p, "hinge")
        assert objective(model, x, y, p, "hinge") <= best * 1.01


@pytest.mark.parametrize("cells, piece, driver", [(16, 3, 1 << 21), (1 << 20, 5, 0)])
def test_sets_pieces_and_the_tree_of_sums_do_not_change_models(rows, data, monkeypatch, cells, piece, driver):
    tasks = [one_task(data[1], p) for p in (1e-2, 0.1, 1.0)]
    wanted = np.concatenate([fitted(rows, [t], "logistic", max_iter=4) for t in tasks])
    for name, value in (("MODEL_CELLS", cells), ("PIECE", piece), ("DRIVER_CELLS", driver)):
        monkeypatch.setattr(N, name, value)
    assert fitted(rows.repartition(9), tasks, "logistic", max_iter=4) == pytest.approx(wanted, abs=1e-6)


def test_without_intercept_and_without_rows(rows, data):
    empty = N.LinearTask(0.1, np.zeros(2), np.array([False, True]), 0.0)
    model, nothing = fitted(rows, [one_task(data[1], 0.1), empty], "logistic", intercept=False)
    assert model[-1] == 0 and model[:-1].any() and not nothing.any()


def test_blocks_hold_all_cells(data):
    import pyarrow as pa

    x, _ = data
    lists = [np.flatnonzero(v) for v in x]
    batch = pa.RecordBatch.from_pydict({
        "codes": pa.array([[i % 4] for i in range(300)], pa.list_(pa.int32())),
        "indices": pa.array(lists, pa.list_(pa.int32())),
        "values": pa.array([v[at] for v, at in zip(x, lists)], pa.list_(pa.float64()))})
    for part in (batch, batch.slice(7, 100), batch.slice(0, 0)):
        low = 0
        for n, columns, cells, codes in N._blocks(part, N.BLOCK_CELLS // 9):
            full = np.zeros((n, 6))
            full[:, columns] = cells
            first = 0 if part is batch else 7
            assert np.array_equal(full, x[first + low:first + low + n])
            assert codes[:, 0].tolist() == [i % 4 for i in range(first + low, first + low + n)]
            low += n
        assert low == part.num_rows


def test_shared_passes_give_the_scores_of_separate_fits(rows):
    grid = {"C": [0.1, 1], "balanced": [False, True]}
    exact = M.logistic_regression(1, tol=1e-7, maxIter=40)
    got = M.grid_search(rows, exact, grid, folds=2)
    wanted = M._separate_grid_search(rows, exact, grid, 2, "accuracy", 2, "id")
    assert got.scores == pytest.approx(wanted.scores, abs=1e-6)
    assert [p[exact.regParam] for p in got.points] == pytest.approx([p[exact.regParam] for p in wanted.points])


def test_repeated_splits_equal_separate_fits(rows, monkeypatch):
    grid = {"C": [0.1], "balanced": [False, True]}

    def exact(n, **params):
        return M.logistic_regression(n, tol=1e-7, maxIter=40, **params)

    def scores():
        found = M.repeated_split_scores(rows, exact, grid, repetitions=2, folds=2)
        return {r.repetition: r.asDict() for r in found.collect()}

    shared = scores()
    monkeypatch.setattr(M, "shares_passes", lambda *a: False)
    separate = scores()
    assert shared.keys() == separate.keys() == {0, 1}
    for repetition, own in separate.items():
        assert shared[repetition] == pytest.approx(own, abs=1e-6)


def test_other_models_keep_fits_of_their_own(rows):
    assert M.shares_passes(M.linear_svm(10), rows)
    assert not M.shares_passes(M.random_forest(2), rows)
    assert not M.shares_passes(M.logistic_regression(10), rows.withColumn("label", F.lit(2.0)))
    assert not M.shares_passes(M.logistic_regression(10, elasticNetParam=0.5), rows)
