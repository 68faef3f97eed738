import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlab.operators import models as M


@pytest.fixture(scope="module")
def points(spark):
    rows = [(str(i), Vectors.dense([i % 7 - 3.0, i % 5 - 2.0]), float((i % 7 - 3) > 0))
            for i in range(70)]
    return spark.createDataFrame(rows, ["id", "features", "label"]).coalesce(2).persist()


@pytest.fixture(scope="module")
def texts(spark):
    words = {"a": ["uno", "dos"], "b": ["tres", "dos"], "c": ["cuatro", "dos"]}
    rows = [(str(i), "T", ("es", "en")[i // 3 % 2], words["abc"[i % 3]], "abc"[i % 3])
            for i in range(36)]
    return spark.createDataFrame(
        rows, "id string, test_case string, language string, tokens array<string>, y string",
    ).coalesce(2).persist()


@pytest.mark.parametrize("name, params", [
    ("logistic_regression", {"maxIter": 10}), ("baseline", {"maxIter": 10}),
    ("svm", {"maxIter": 10}),
    ("random_forest", {"trees": 5, "depth": 4})])
def test_text_models_learn_and_keep_rows(texts, name, params):
    model = M.fit_text_model(texts, "y", name, **params)
    got = {r.id: r.category for r in M.predict(model, texts).collect()}
    assert got == {r.id: r.y for r in texts.collect()}


def test_rows_without_label_are_not_fitted_on(texts):
    hidden = texts.withColumn("y", F.when(F.col("id") != "0", F.col("y")))
    assert M.predict(M.fit_text_model(hidden, "y", "svm", maxIter=5), hidden).count() == 36


def test_per_language(texts):
    models = M.fit_per_language(
        texts, "y", ["es", "en"], "logistic_regression", maxIter=5)
    assert set(models) == {"es", "en"}
    assert M.predict_per_language(models, texts).count() == 36


def test_languages_are_fitted_side_by_side(texts, monkeypatch):
    """Two fits wait for each other; the model of a language stays with it."""
    both, fit = threading.Barrier(2), M.fit_text_model

    def met(*args, **kwargs):
        both.wait(timeout=60)
        return fit(*args, **kwargs)

    monkeypatch.setattr(M, "fit_text_model", met)
    models = M.fit_per_language(texts, "y", iter(["es", "en"]), "logistic_regression", maxIter=5)
    for x, model in models.items():
        alone = fit(texts.filter(F.col("language") == x), "y", "logistic_regression", maxIter=5)
        assert model.stages[0].vocabulary == alone.stages[0].vocabulary


def test_linear_fits_take_as_few_tasks_as_their_rows_need(texts, monkeypatch):
    tasks, margins = {}, M.fit_margins

    def counted(rows, classifier, classes):
        tasks[type(classifier).__name__] = rows.rdd.getNumPartitions()
        return margins(rows, classifier, classes)

    monkeypatch.setattr(M, "fit_margins", counted)
    monkeypatch.setattr(M, "LINEAR_ROWS", texts.count() // 2)
    spread = texts.repartition(4)
    M.fit_text_model(spread, "y", "svm", maxIter=2)
    M.fit_text_model(spread, "y", "random_forest", trees=2, depth=2)
    assert tasks == {"LinearSVC": 2, "RandomForestClassifier": 4}


def test_regularisation_scale():
    assert M.logistic_regression(100).getRegParam() == pytest.approx(1e-5)
    assert M.linear_svm(50).getRegParam() == pytest.approx(0.02)
    with pytest.raises(ValueError):
        M.get_classifier("tree", 1)


def test_class_weights(points):
    weights = {r.label: r.weight for r in M.class_weights(points, "label").collect()}
    assert weights == {0.0: pytest.approx(70 / 80), 1.0: pytest.approx(70 / 60)}
    total = M.with_class_weights(points, "label").agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(70)


def test_margin_probability_is_monotone(points):
    model, calibration = M.fit_with_probability(points, M.linear_svm(70, maxIter=5), folds=3)
    rows = M.margin_probability(model.transform(points), calibration).collect()
    assert len(rows) == 70
    by_margin = sorted(rows, key=lambda r: r.rawPrediction[1])
    probabilities = [r.probability for r in by_margin]
    assert probabilities == sorted(probabilities)


@pytest.fixture(scope="module")
def noise(spark):
    """Few rows, many columns without a meaning: margins of training rows are far too large."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 60))
    y = (x[:, 0] + rng.normal(size=600) * 1.5 > 0).astype(float)
    rows = [(str(i), Vectors.dense(v.tolist()), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "features", "label"]).coalesce(2).persist()


def test_cross_fitted_probabilities_beat_in_sample_ones(noise):
    number = F.col("id").cast("int")
    train, rest = noise.filter(number < 150).persist(), noise.filter(number >= 150).persist()
    svm = M.linear_svm(150, c=100.0, maxIter=50)

    def loss(model, calibration):
        rows = M.margin_probability(model.transform(rest), calibration).collect()
        return -np.mean([np.log(max(r.probability if r.label else 1 - r.probability, 1e-12)) for r in rows])

    model, crossed = M.fit_with_probability(train, svm)
    own = M.margin_calibration(model.transform(train).select(
        "label", vector_to_array("rawPrediction")[1].alias("margin")))
    assert loss(model, crossed) < loss(model, own) - 0.1


def test_no_margin_comes_from_a_model_that_saw_its_row(noise):
    train = noise.filter(F.col("id").cast("int") < 60)
    svm = M.linear_svm(60, c=100.0, maxIter=30)
    crossed = M.cross_margins(train, svm, folds=3).collect()
    assert len(crossed) == 60
    own = svm.fit(train).transform(train).collect()
    right = [np.mean([(m > 0) == (y > 0) for m, y in pairs]) for pairs in (
        [(r.margin, r.label) for r in crossed], [(r.rawPrediction[1], r.label) for r in own])]
    assert right[0] < right[1]


def test_fold_weights_come_from_the_training_rows(points):
    folded = M.assign_folds(points.filter("id < 66 OR label = 1"), "label", 3, "id")
    rows = M.with_fold_weights(folded, 3).collect()
    for held in range(3):
        train = [r.label for r in rows if r.fold != held]
        for r in rows:
            assert r._weights[held] == pytest.approx(len(train) / (2 * train.count(r.label)))


def test_grid_search_equals_separate_fits(points):
    grid = {"C": [1, 10], "balanced": [False, True]}
    search = M.grid_search(points, M.logistic_regression(1, maxIter=5), grid, folds=2)
    folded = M.assign_folds(points, "label", 2, "id").persist()
    wanted = []
    for c in (1, 10):
        for balanced in (False, True):
            right = 0.0
            for fold in range(2):
                train = M.with_class_weights(folded.filter(F.col("fold") != fold), "label")
                if not balanced:
                    train = train.withColumn("weight", F.lit(1.0))
                model = M.logistic_regression(35, c, maxIter=5, weightCol="weight").fit(train)
                held = model.transform(folded.filter(F.col("fold") == fold))
                right += held.filter("prediction = label").count() / held.count() / 2
            wanted.append(right)
    assert sorted(search.scores) == pytest.approx(sorted(wanted))
    assert search.scores[search.points.index(search.best())] == max(search.scores)


def test_grid_search(points):
    grid = {"C": [1, 10], "balanced": [False, True]}
    model = M.grid_search(points, M.logistic_regression(1, maxIter=5), grid, folds=2)
    scores = M.grid_scores(model)
    assert len(scores) == 4 and all(0.8 < s <= 1 for _, s in scores)
    assert sum("balanced" in name for name, _ in scores) == 2


def test_cross_validation(points):
    predictions = M.cross_val_predict(
        points, lambda train: M.logistic_regression(60, maxIter=5).fit(train), k=3)
    assert predictions.select("id").distinct().count() == predictions.count() == 70
    assert M.cross_validate(predictions).count() == 3


def test_repeated_splits(points):
    scores = M.repeated_split_scores(
        points, lambda n, **p: M.logistic_regression(n, maxIter=5, **p), {"C": [1, 10]},
        repetitions=2, folds=2)
    assert sorted(r.repetition for r in scores.collect()) == [0, 1]


def test_two_heads(points):
    rows = points.withColumns({
        "gold1": F.col("label").cast("int"),
        "gold2": F.when(F.col("id") == "0", -1).otherwise(F.col("label").cast("int") * 2)})
    heads = M.fit_two_heads(rows, maxIter=20)
    scored = M.score_two_heads(heads, rows)
    assert scored.filter("gold1 = pred1").count() == 70
    assert scored.filter("gold2 >= 0 and gold2 <> pred2").count() == 0
    assert len(scored.first().logits2) == 3


def random_rows(spark, rows, parts):
    return spark.range(0, rows, 1, parts).select(
        "id", array_to_vector(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)).cast("double")
                                        for i in range(4)])).alias("features"),
        F.pmod(F.xxhash64("id"), F.lit(2)).cast("double").alias("label"))


def test_forests_of_a_search_are_fitted_in_few_tasks(spark, monkeypatch):
    seen = []

    def fit(self, rows, *_):
        seen.append((rows.rdd.getNumPartitions(), self.getCacheNodeIds()))
        raise RuntimeError("seen")

    monkeypatch.setattr(M.RandomForestClassifier, "fit", fit)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with pytest.raises(RuntimeError, match="seen"):
            M.grid_search(random_rows(spark, 200, 40), M.random_forest(2), {"numTrees": [2, 3]}, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(seen) == {(1, True)}


def test_frames_of_few_tasks_keep_them(spark):
    rows = random_rows(spark, 200, 8)
    assert M.few_tasks(rows, 200) is rows
    assert M.few_tasks(random_rows(spark, 200, 40), 3 * M.FOREST_ROWS).rdd.getNumPartitions() == 3


def test_kept_nodes_give_the_same_trees(spark):
    rows = random_rows(spark, 300, 4).cache()
    plain = M.random_forest(5, bootstrap=True)
    kept = M.with_kept_nodes(plain, rows)
    assert kept.fit(rows).toDebugString.split("\n", 1)[1] == plain.fit(rows).toDebugString.split("\n", 1)[1]
    rows.unpersist()
