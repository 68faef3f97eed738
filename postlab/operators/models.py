"""Classifiers, grid search, cross-validation and two-head scoring on MLlib.

A fitted text model is a saved chain of MLlib stages that starts from a token
column; tokens come from the same Column functions for training and scoring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, LogisticRegressionModel, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IndexToString, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.functions.scores import argmax
from postlab.operators.evaluate import macro_scores, mean_metrics
from postlab.operators.features import fit_tfidf
from postlab.operators.linear import LinearTask, column_scale, fit_linear, linear_margins, sparse_rows
from postlab.operators.sampling import assign_folds, rank_by_hash, shuffle_splits
from postlab.operators.tables import append_rows
from postlab.session import cached, join_sized, settle, workspace

SEED = 123
# The default settings of the classifiers.
LOGISTIC_C, LOGISTIC_TOL = 1e3, 0.01
FOREST_TREES = 250
SVM_C = 1.0
CALIBRATION_FOLDS = 5
FOREST_ROWS = 16_384  # of a task
LINEAR_ROWS = 16_384  # of a task, in each of many short passes
FITS = 4  # models fitted side by side
TREE_ROW_BYTES = 120  # that the nodes of a tree take while it grows, per row it is fitted on
MAX_TREE_DEPTH = 30  # the deepest tree the library grows; there is no "unlimited"

# Searched settings per classifier. Settings that cannot change the
# result of a linear or one-vs-rest model are left out.
GRIDS = {
    "baseline": {"C": [1, 10], "balanced": [False, True]},
    "logistic_regression": {"C": [1, 10], "balanced": [False, True]},
    "random_forest": {"balanced": [False, True], "numTrees": [250, 450],
                      "bootstrap": [True, False], "maxDepth": [MAX_TREE_DEPTH]},
    "svm": {"balanced": [False, True], "C": [1, 10, 100, 10000]},
}


def logistic_regression(n: int, c: float = LOGISTIC_C, tol: float = LOGISTIC_TOL,
                        **params) -> LogisticRegression:
    """A penalty given as ``C`` on summed losses is ``1 / (C n)`` on mean losses."""
    return LogisticRegression(regParam=1.0 / (c * n), tol=tol, standardization=False, **params)


def linear_svm(n: int, c: float = SVM_C, **params) -> LinearSVC:
    return LinearSVC(regParam=1.0 / (c * n), standardization=False, **params)


def random_forest(trees: int = FOREST_TREES, depth: int = MAX_TREE_DEPTH,
                  **params) -> RandomForestClassifier:
    defaults = {"bootstrap": False, "seed": SEED}
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, **{**defaults, **params})


@dataclass
class GridSearch:
    """Parameter maps of a grid and the mean score of each over the folds."""

    points: list[dict]
    scores: list[float]

    def best(self) -> dict:
        """The parameters of the best score, the first of equal ones."""
        return self.points[max(range(len(self.scores)), key=lambda i: self.scores[i])]


def get_classifier(name: str, n: int, **params) -> Estimator:
    """A classifier by name; ``n`` is the number of training rows."""
    if name == "random_forest":
        return random_forest(**params)
    makers = {"logistic_regression": logistic_regression, "baseline": logistic_regression,
              "svm": linear_svm}
    if name not in makers:
        raise ValueError(f"unknown classifier: {name}")
    return makers[name](n, **params)


def fit_margins(rows: DataFrame, classifier: Estimator, classes: int,
                label: str = "label") -> list[Transformer]:
    """Fitted stages that end in one ``margins`` vector with a number per class.

    Two classes, or a classifier for any number of them: one model. Otherwise one
    model per class against the rest, fitted side by side; their margins are put
    into one vector, so a single pass scores all classes.
    """
    if classes <= 2 or isinstance(classifier, RandomForestClassifier):
        return [classifier.copy({classifier.rawPredictionCol: "margins"}).fit(rows)]

    def fit_one(i: int) -> Transformer:
        target = rows.withColumn("_is", (F.col(label) == i).cast("double"))
        names = {classifier.labelCol: "_is", classifier.rawPredictionCol: f"_raw{i}",
                 classifier.predictionCol: f"_pred{i}"}
        if classifier.hasParam("probabilityCol"):
            names[classifier.getParam("probabilityCol")] = f"_prob{i}"
        return classifier.copy(names).fit(target)

    with ThreadPoolExecutor(min(classes, 4)) as pool:
        models = list(pool.map(fit_one, range(classes)))
    # A binary margin vector is (-m, m): the odd places are the classes' own.
    return [
        *models,
        VectorAssembler(inputCols=[f"_raw{i}" for i in range(classes)], outputCol="_raws"),
        VectorSlicer(inputCol="_raws", outputCol="margins",
                     indices=[2 * i + 1 for i in range(classes)]),
    ]


def margin_calibration(margins: DataFrame, margin: str = "margin", label: str = "label",
                       max_iter: int = 50) -> LogisticRegressionModel:
    """A logistic fit of a two-class label on the one number of a margin."""
    chain = VectorAssembler(inputCols=[margin], outputCol="_m")
    calibrate = LogisticRegression(
        featuresCol="_m", labelCol=label, rawPredictionCol="_raw", predictionCol="_p",
        probabilityCol="_prob", maxIter=max_iter)
    with cached(chain.transform(margins).select("_m", label)) as rows:
        return calibrate.fit(rows)


def cross_margins(rows: DataFrame, classifier: Estimator, folds: int = CALIBRATION_FOLDS,
                  label: str = "label", key: str = "id") -> DataFrame:
    """``label, margin`` of every row from a model that was fitted without its fold."""
    with cached(assign_folds(rows, label, folds, key)) as folded:
        def scored(fold: int) -> DataFrame:
            model = classifier.fit(folded.filter(F.col("fold") != fold))
            return model.transform(folded.filter(F.col("fold") == fold)).select(
                label, vector_to_array(model.getRawPredictionCol())[1].alias("margin"))

        with ThreadPoolExecutor(min(folds, 4)) as pool:
            return settle(append_rows(*pool.map(scored, range(folds))))


def margin_probability(scored: DataFrame, calibration: LogisticRegressionModel,
                       raw: str = "rawPrediction") -> DataFrame:
    """Add ``probability`` of the second class, from a margin and a calibration of margins.

    The calibration is fitted on `cross_margins`: margins of a model's own training rows are
    too large, so a fit on those gives probabilities that are too sure.
    """
    chain = VectorAssembler(inputCols=["_margin"], outputCol="_m")
    vectors = chain.transform(scored.withColumn("_margin", vector_to_array(raw)[1]))
    return (calibration.transform(vectors)
            .withColumn("probability", vector_to_array("_prob")[1])
            .drop("_margin", "_m", "_raw", "_p", "_prob"))


def fit_with_probability(rows: DataFrame, classifier: Estimator, folds: int = CALIBRATION_FOLDS,
                         label: str = "label", key: str = "id") -> tuple[Transformer, LogisticRegressionModel]:
    """A two-class model of all rows and the calibration of its margins from models of ``folds``."""
    return classifier.fit(rows), margin_calibration(
        cross_margins(rows, classifier, folds, label, key), "margin", label)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight = n / (k * n_class)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    whole = counts.agg(F.struct(
        F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k")).alias("w")).scalar()
    return counts.withColumn("_w", whole).select(
        label, "n_class", (F.col("_w.n") / (F.col("_w.k") * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Rows with their class weight."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(output))
    return join_sized(df, settle(weights), label)


def fit_label_index(df: DataFrame, label: str, output: str = "label") -> StringIndexerModel:
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc").fit(df)


def fit_text_model(train: DataFrame, label: str, classifier: str = "svm",
                   tokens: str = "tokens", min_df: float = 0.01, **params) -> PipelineModel:
    """tokens -> TF-IDF -> margins -> class name, fitted on ``train``.

    The last stage only names the classes; `predict` puts the arg-max before it. A linear
    solver passes over its vectors up to a hundred times, so they lie in as few tasks as they need.
    """
    with cached(train.filter(F.col(label).isNotNull()).select(tokens, label)) as rows:
        n = rows.count()
        weigh = fit_tfidf(rows, tokens, min_df=min_df)
        index = fit_label_index(rows, label)
        vectors = index.transform(weigh.transform(rows)).select("features", "label")
        if classifier != "random_forest":  # those draw their rows by task
            vectors = vectors.coalesce(max(math.ceil(n / LINEAR_ROWS), 1))
        with cached(vectors) as ready:
            fitted = fit_margins(ready, get_classifier(classifier, n, **params), len(index.labels))
    names = IndexToString(inputCol="predicted", outputCol="category", labels=list(index.labels))
    return PipelineModel([*weigh.stages, *fitted, names])


def predict(model: PipelineModel, posts: DataFrame,
            keep: tuple[str, ...] = ("test_case", "id")) -> DataFrame:
    """Scored posts: kept columns and ``category``. Nothing is matched by position."""
    *chain, names = model.stages
    scored = PipelineModel(chain).transform(posts).withColumn(
        "predicted", argmax(vector_to_array("margins")).cast("double"))
    return names.transform(scored).select(*keep, "category")


def fit_per_language(train: DataFrame, label: str, languages: Iterable[str],
                     classifier: str = "svm", tokens: str = "tokens",
                     **params) -> dict[str, PipelineModel]:
    """One model per language, all fitted from one scan of ``train``, ``FITS`` of them at a time."""
    chosen = list(languages)
    with cached(train.select("language", label, tokens)) as kept:
        def fit(x: str) -> PipelineModel:
            return fit_text_model(
                kept.filter(F.col("language") == x), label, classifier, tokens, **params)

        with ThreadPoolExecutor(FITS) as pool:
            return dict(zip(chosen, pool.map(fit, chosen)))


def predict_per_language(models: dict[str, PipelineModel], posts: DataFrame,
                         keep: tuple[str, ...] = ("test_case", "id")) -> DataFrame:
    return append_rows(*[
        predict(m, posts.filter(F.col("language") == x), keep) for x, m in models.items()])


def with_kept_nodes(classifier: RandomForestClassifier, df: DataFrame) -> RandomForestClassifier:
    """The classifier with the node of each row and tree kept between passes: the same trees, but
    no pass ships the trees grown so far and walks them from their roots."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # cuts the lineage of what is kept
        context.setCheckpointDir(workspace(df.sparkSession))
    return classifier.copy({classifier.cacheNodeIds: True})


def grid_of(classifier: Estimator, settings: dict, n: float) -> list[dict]:
    """Parameter maps for a ``GRIDS`` entry; ``balanced`` switches the weight column."""
    grid = ParamGridBuilder()
    for name, values in settings.items():
        if name == "C":
            grid = grid.addGrid(classifier.regParam, [1.0 / (c * n) for c in values])
        elif name == "balanced":
            grid = grid.addGrid(
                classifier.weightCol, ["balanced" if v else "uniform" for v in values])
        else:
            grid = grid.addGrid(classifier.getParam(name), values)
    return grid.build()


def with_fold_weights(folded: DataFrame, folds: int, label: str = "label") -> DataFrame:
    """``_weights`` added: the weight of the row's class per fold that is left out.

    Weights of a fold come from the rows of the other folds alone, so nothing of the rows it
    validates enters a fit.
    """
    counts = settle(folded.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")))
    left_out = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")
    left = (counts.select("fold", label, "n", left_out).filter(F.col("fold") != F.col("held"))
            .groupBy("held", label).agg(F.sum("n").alias("n_class")))
    per_fold = Window.partitionBy("held")
    weights = left.select("held", label, (
        F.sum("n_class").over(per_fold)
        / (F.count(F.lit(1)).over(per_fold) * F.col("n_class"))).alias("w"))
    by_class = weights.groupBy(label).agg(
        F.map_from_entries(F.collect_list(F.struct("held", "w"))).alias("_weights"))
    return join_sized(folded, settle(by_class), label)


def shares_passes(classifier: Estimator, df: DataFrame, label: str = "label") -> bool:
    """Whether many models of ``classifier`` can be fitted in common passes: two-class linear ones,
    whose result depends on nothing but penalty, weights, iterations and tolerance."""
    if not isinstance(classifier, (LogisticRegression, LinearSVC)):
        return False
    if isinstance(classifier, LogisticRegression) and (
            classifier.getElasticNetParam() or classifier.getThreshold() != 0.5
            or classifier.getFamily() == "multinomial"):
        return False
    if isinstance(classifier, LinearSVC) and classifier.getThreshold():
        return False
    if classifier.getStandardization() or classifier.isSet(classifier.weightCol):
        return False
    return df.filter(~F.col(label).isin(0.0, 1.0) | F.col(label).isNull()).isEmpty()


def grid_search(df: DataFrame, classifier: Estimator, settings: dict, folds: int = 5,
                metric: str = "accuracy", parallelism: int = 2, key: str = "id") -> GridSearch:
    """Exhaustive search over ``(key, features, label)`` with stratified, seeded folds.

    Class weights are those of the rows that train a fold; validation rows have no part in them.
    Two-class linear models of all settings and folds are fitted in common passes over the rows.
    """
    if metric == "accuracy" and shares_passes(classifier, df):
        folded = assign_folds(df, "label", folds, key).withColumn(
            "codes", F.array(_code(F.lit(0), F.col("fold"), F.col("label"), folds)))
        with cached(folded.select("features", "codes")) as ready:
            shared = SharedFits(ready, classifier, 1, folds)
            # A fold is fitted on the rows of all the others.
            points = grid_of(classifier, settings, shared.counts[0, 0].sum() * (folds - 1) / folds)
            return GridSearch(points, shared.accuracies(points, part=0)[0].tolist())
    return _separate_grid_search(df, classifier, settings, folds, metric, parallelism, key)


def _code(part: Column, fold: Column, label: Column, folds: int) -> Column:
    return ((part * folds + fold) * 2 + label).cast("int")


class SharedFits:
    """Fits of many two-class linear models over ``(features, codes)``.

    ``codes[r]`` packs the part, fold and class of a row in repetition ``r``, see `_code`.
    """

    def __init__(self, df: DataFrame, classifier: Estimator, repetitions: int, folds: int, parts: int = 1):
        self.classifier, self.repetitions, self.folds, self.parts = classifier, repetitions, folds, parts
        keep = [c for c in df.columns if c not in ("features", "codes")]
        self.rows = sparse_rows(df, "features", "codes", *keep)
        self.scale = column_scale(df)
        counts = np.zeros((repetitions, parts * folds * 2))
        for r in self.rows.select(F.posexplode("codes").alias("slot", "code")).groupBy(
                "slot", "code").count().collect():
            counts[r.slot, r.code] = r["count"]
        # Rows by repetition, part, fold and class.
        self.counts = counts.reshape(repetitions, parts, folds, 2)

    def _task(self, point: dict, repetition: int, part: int, held: int) -> LinearTask:
        values = {p.name: v for p, v in point.items()}
        trained = self.counts[repetition, part].copy()
        trained[held] = 0
        weights = np.zeros((self.parts, self.folds, 2))
        weights[part] = 1.0
        if values.get("weightCol") == "balanced":
            seen = trained.sum(0)
            weights[part] = seen.sum() / (np.count_nonzero(seen) * np.maximum(seen, 1))
        weights[part, held] = 0
        positive = np.zeros(weights.shape, bool)
        positive[..., 1] = True
        return LinearTask(values.get("regParam", self.classifier.getRegParam()),
                          weights.ravel(), positive.ravel(),
                          float((weights * self.counts[repetition]).sum()), repetition)

    def margins(self, points: list[list[dict]], part: int, *keep: str) -> DataFrame:
        """``keep, slot, fold, gold, margins``: of the rows of ``part``, by the models of
        ``points[repetition]`` that were fitted without the row's fold."""
        tasks, asked = [], []
        for repetition in range(self.repetitions):
            lists = [np.zeros(0, np.int64)] * (self.parts * self.folds * 2)
            for held in range(self.folds):
                own = np.arange(len(tasks), len(tasks) + len(points[repetition]))
                first = (part * self.folds + held) * 2
                lists[first] = lists[first + 1] = own
                tasks += [self._task(p, repetition, part, held) for p in points[repetition]]
            asked.append(lists)
        models = fit_linear(
            self.rows, tasks, len(self.scale), self.scale,
            "hinge" if isinstance(self.classifier, LinearSVC) else "logistic",
            self.classifier.getMaxIter(), self.classifier.getTol(), self.classifier.getFitIntercept())
        scored = linear_margins(self.rows, models, asked, *keep)
        return scored.select(
            *keep, "slot", F.floor((F.col("code") - part * self.folds * 2) / 2).cast("int").alias("fold"),
            F.pmod("code", F.lit(2)).cast("double").alias("gold"), "margins")

    def accuracies(self, points: list[dict], part: int) -> np.ndarray:
        """``repetitions x points``: the mean over folds of the accuracy of rows left out."""
        scored = self.margins([points] * self.repetitions, part)
        right = scored.select("slot", "fold", F.posexplode(F.transform(
            "margins", lambda m: ((m > 0) == (F.col("gold") > 0)).cast("long"))).alias("point", "right"))
        sums = np.zeros((self.repetitions, len(points), self.folds))
        for r in right.groupBy("slot", "point", "fold").agg(F.sum("right").alias("n")).collect():
            sums[r.slot, r.point, r.fold] = r.n
        sizes = self.counts[:, part].sum(-1)[:, None, :]
        return (sums / np.maximum(sizes, 1)).mean(-1)


def few_tasks(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in as many tasks as ``n`` of them need, for the fit of a forest.

    A task holds and sends the statistics of all open nodes, however few rows it has, so many small
    tasks cost as many times those. Frames of few tasks stay as they are; a forest draws its rows by task.
    """
    if rows.rdd.getNumPartitions() <= 2 * rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return rows.coalesce(max(math.ceil(n / FOREST_ROWS), 1))


def fits_at_once(points: list[dict], rows: DataFrame, n: float, least: int) -> int:
    """How many forests may grow side by side: as many as keep all cores busy, as far as the driver
    can hold their nodes, and ``least`` of them in any case."""
    context = rows.sparkSession.sparkContext
    trees = [v for p in points for k, v in p.items() if k.name == "numTrees"] or [FOREST_TREES]
    heap = context._jvm.java.lang.Runtime.getRuntime().maxMemory()
    held = int(heap * 0.75 / max(sum(trees) / len(trees) * n * TREE_ROW_BYTES, 1))
    return max(least, min(context.defaultParallelism // rows.rdd.getNumPartitions(), held))


def _separate_grid_search(df: DataFrame, classifier: Estimator, settings: dict, folds: int, metric: str,
                          parallelism: int, key: str) -> GridSearch:
    """Any classifier and metric: a fit of its own per setting and fold, those of all folds side by side."""
    evaluator = MulticlassClassificationEvaluator(metricName=metric)
    forest = isinstance(classifier, RandomForestClassifier)
    with ExitStack() as kept:
        ready = kept.enter_context(cached(with_fold_weights(assign_folds(df, "label", folds, key), folds)))
        # A fold is fitted on the rows of all the others.
        n = ready.count() * (folds - 1) / folds
        points = grid_of(classifier, settings, n)
        if forest:
            classifier = with_kept_nodes(classifier, df)
        parts = []
        for fold in range(folds):
            train = ready.filter(F.col("fold") != fold).withColumns({
                "balanced": F.col("_weights")[fold], "uniform": F.lit(1.0)}).select(
                    "features", "label", "balanced", "uniform")
            held = ready.filter(F.col("fold") == fold).select("features", "label")
            if forest:
                train, held = few_tasks(train, n), few_tasks(held, n / (folds - 1))
            parts.append((kept.enter_context(cached(train)), kept.enter_context(cached(held))))

        def score(fold: int, i: int) -> float:
            rows, held = parts[fold]
            return evaluator.evaluate(classifier.copy(points[i]).fit(rows).transform(held))

        if forest:
            parallelism = fits_at_once(points, parts[0][0], n, parallelism)
        jobs = [(fold, i) for fold in range(folds) for i in range(len(points))]
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(lambda job: score(*job), jobs))
    totals = [0.0] * len(points)
    for (_, i), x in zip(jobs, scores):
        totals[i] += x
    return GridSearch(points, [t / folds for t in totals])


def grid_scores(search: GridSearch) -> list[tuple[str, float]]:
    """One ``(setting, mean score)`` pair per grid point."""
    return [
        (", ".join(sorted(f"{p.name}={v}" for p, v in point.items())), float(score))
        for point, score in zip(search.points, search.scores)]


def cross_val_predict(df: DataFrame, fit: Callable[[DataFrame], object], k: int = 10,
                      label: str = "label", key: str = "id") -> DataFrame:
    """Out-of-fold predictions ``(key, fold, gold, pred)``.

    ``fit(train)`` returns anything with ``transform`` that adds ``prediction``.
    """
    parts = []
    with cached(assign_folds(df, label, k, key)) as folded:
        for fold in range(k):
            model = fit(folded.filter(F.col("fold") != fold))
            scored = model.transform(folded.filter(F.col("fold") == fold))
            parts.append(scored.select(
                key, "fold", F.col(label).alias("gold"), F.col("prediction").alias("pred")))
        return settle(append_rows(*parts))


def cross_validate(predictions: DataFrame) -> DataFrame:
    """Per fold: accuracy and macro precision, recall and f1."""
    return macro_scores(predictions, by=("fold",))


def fit_two_heads(df: DataFrame, features: str = "features",
                  labels: tuple[str, str] = ("gold1", "gold2"), **params) -> list:
    """Two multinomial heads over one shared feature column; rows labelled -1 are skipped."""
    with cached(df) as rows:
        return [
            LogisticRegression(
                featuresCol=features, labelCol=label, family="multinomial",
                rawPredictionCol=f"raw{i}", probabilityCol=f"probability{i}",
                predictionCol=f"prediction{i}", **params,
            ).fit(rows.filter(F.col(label) >= 0))
            for i, label in enumerate(labels, 1)]


def score_two_heads(heads: list, df: DataFrame) -> DataFrame:
    """Adds ``logits1, pred1, logits2, pred2`` in one pass."""
    for i, head in enumerate(heads, 1):
        df = (head.transform(df)
              .withColumn(f"logits{i}", vector_to_array(f"raw{i}"))
              .withColumn(f"pred{i}", argmax(F.col(f"logits{i}")))
              .drop(f"raw{i}", f"probability{i}", f"prediction{i}"))
    return df


def repeated_split_scores(df: DataFrame, classifier: Callable[..., Estimator], settings: dict,
                          repetitions: int = 10, folds: int = 10, test_size: float = 0.7,
                          key: str = "id") -> DataFrame:
    """Per repetition: tune on one part, cross-validate the best setting on the other.

    ``classifier(n, **params)`` makes an estimator for ``n`` training rows. Scores
    are averaged over folds, one row per repetition; `mean_metrics` averages those. Two-class
    linear models are fitted in common passes: one set tunes all repetitions, one scores them.
    """
    if shares_passes(classifier(1), df):
        return _shared_split_scores(df, classifier, settings, repetitions, folds, test_size, key)
    results = []
    with cached(shuffle_splits(df, repetitions, test_size, key)) as split:
        for repetition in range(repetitions):
            chosen = split.filter(F.col("repetition") == repetition)
            tune = chosen.filter(F.col("part") == "tune")
            estimator = classifier(tune.count() * (folds - 1) / folds)
            point = grid_search(tune, estimator, settings, folds, key=key).best()

            def fit(train: DataFrame) -> Transformer:
                # Weights of the training rows alone.
                rows = with_class_weights(train, "label", "balanced").withColumn("uniform", F.lit(1.0))
                return estimator.copy(point).fit(rows)

            scores = cross_validate(cross_val_predict(
                chosen.filter(F.col("part") == "evaluate"), fit, folds, key=key))
            metrics = [c for c in scores.columns if c != "fold"]
            results.append(
                mean_metrics(scores, metrics).withColumn("repetition", F.lit(repetition)))
        return settle(append_rows(*results))


def _shared_split_scores(df: DataFrame, classifier: Callable[..., Estimator], settings: dict,
                         repetitions: int, folds: int, test_size: float, key: str) -> DataFrame:
    parts = ("tune", "evaluate")
    rows = settle(df.select(F.col(key).alias("_key"), "label", "features")
                  .withColumn("_row", F.monotonically_increasing_id()))
    # Vectors stay in place: parts and folds of all repetitions are drawn on narrow rows.
    split = shuffle_splits(rows.select("_key", "_row", "label"), repetitions, test_size, "_key")
    ranked = rank_by_hash(split, "_key", by=("repetition", "part", "label"), name="_rank")
    code = _code((F.col("part") == parts[1]).cast("int"), F.pmod(F.col("_rank") - 1, F.lit(folds)),
                 F.col("label"), folds)
    codes = ranked.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("repetition", code.alias("code")))), lambda x: x["code"]).alias("codes"))
    with cached(rows.join(codes, "_row").select("features", "codes")) as ready:
        tune_rows = ready.count() - math.ceil(ready.count() * test_size)
        estimator = classifier(tune_rows * (folds - 1) / folds)
        shared = SharedFits(ready, estimator, repetitions, folds, len(parts))
        points = grid_of(estimator, settings, shared.counts[0, 0].sum() * (folds - 1) / folds)
        # The first of equal scores wins.
        best = shared.accuracies(points, part=0).argmax(1)
        predictions = shared.margins([[points[i]] for i in best], 1).select(
            F.col("slot").alias("repetition"), "fold", "gold",
            (F.col("margins")[0] > 0).cast("double").alias("pred"))
        scores = macro_scores(predictions, by=("repetition", "fold"))
        metrics = [c for c in scores.columns if c not in ("repetition", "fold")]
        return settle(scores.groupBy("repetition").agg(*[F.avg(m).alias(m) for m in metrics])
                      .select(*metrics, "repetition"))
