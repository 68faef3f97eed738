"""M1-M10 and S5: fitted models, and the SQL-checkable parts around them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from postlab.functions import text as T
from postlab.functions import tokens as K
from postlab.operators import models as M
from postlab.operators.evaluate import classification_report, mean_metrics
from postlab.operators.features import fit_tfidf
from postlab.operators.sampling import assign_folds, shuffle_splits
from postlab.operators.tables import append_rows, attach_predictions, languages
from postlab.plans import checksql as S
from postlab.plans import views
from postlab.plans.registry import query
from postlab.session import cached, settle, workspace
from postlab.sources.models import load_model, save_model


def _posts(spark, sf):
    return views.posts(spark, sf).withColumn(
        "tokens", K.tokenize(F.lower(T.clean_text(F.col("text"), T.TRAIN)))).drop("text")


def _split(spark, sf):
    """Labelled posts to fit on, all others to score."""
    posts = _posts(spark, sf)
    training = F.col("split") == "train"
    return posts.filter(training), posts.filter(~training)


def _fit_and_score(spark, sf, label, classifier, **params):
    train, rest = _split(spark, sf)
    return M.predict(M.fit_text_model(train, label, classifier, **params), rest)


def _vectors(spark, sf):
    """``id, features, label`` from the embedding table."""
    return views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"))


@query()
def m1_logistic_regression(spark, sf):
    """One-vs-rest over four languages."""
    return _fit_and_score(spark, sf, "language", "logistic_regression")


@query()
def m2_random_forest(spark, sf):
    return _fit_and_score(spark, sf, "language", "random_forest")


@query()
def m3_linear_svm(spark, sf):
    return _fit_and_score(spark, sf, "task1", "svm")


@query()
def m3_svm_probability(spark, sf):
    binary = _vectors(spark, sf).withColumn("label", (F.col("label") >= 5).cast("double"))
    with cached(binary) as rows:
        model, calibration = M.fit_with_probability(rows, M.linear_svm(rows.count()))
    return M.margin_probability(model.transform(binary), calibration).select(
        "id", F.col("prediction").cast("int").alias("pred"),
        F.round("probability", 6).alias("probability"))


@query()
def m4_fit_text_model(spark, sf):
    """The default classifier on the six-class task."""
    return _fit_and_score(spark, sf, "task2", "svm")


def _saved_and_loaded(spark, sf):
    train, rest = _split(spark, sf)
    model = M.fit_text_model(train, "task1", "logistic_regression")
    folder = workspace(spark)
    save_model(model, folder)
    return model, load_model(folder), rest


@query()
def m5_predict(spark, sf):
    """Scores of a model that was saved and loaded."""
    _, loaded, rest = _saved_and_loaded(spark, sf)
    return M.predict(loaded, rest)


@query(S.with_views("SELECT id, cast(1 AS bigint) AS same FROM v_posts WHERE split <> 'train'", S.POSTS))
def s5_save_load_model(spark, sf):
    """Whether each post gets the same category before and after saving."""
    model, loaded, posts = _saved_and_loaded(spark, sf)
    # Cut once, for this file; both models read the tokens.
    rest = settle(posts.select("id", "tokens"))
    before, after = M.predict(model, rest, ("id",)), M.predict(loaded, rest, ("id",))
    loaded = after.select("id", F.col("category").alias("loaded"))
    return before.join(loaded, "id").select(
        "id", (F.col("category") == F.col("loaded")).cast("bigint").alias("same"))


@query()
def m6_fit_per_language(spark, sf):
    train, rest = _split(spark, sf)
    models = M.fit_per_language(train, "task1", languages(train), "logistic_regression")
    return M.predict_per_language(models, rest)


@query()
def m6_report_over_languages(spark, sf):
    """A model per language, fitted on four folds of the labelled posts and scored on
    the fifth, for every fold; one report over all languages together."""
    labelled = _posts(spark, sf).filter(F.col("split") == "train")
    # Cleaned and cut once, for this file: the plans of all fits start from it.
    posts = settle(assign_folds(labelled, "language", 5))
    parts = []
    for fold in range(5):
        held_out, rest = posts.filter(F.col("fold") == fold), posts.filter(F.col("fold") != fold)
        models = M.fit_per_language(rest, "task1", languages(rest), "logistic_regression")
        # Written fold by fold, so that no plan holds all models.
        parts.append(settle(attach_predictions(
            held_out.select("id", F.col("task1").alias("gold")),
            M.predict_per_language(models, held_out, ("id",)).withColumnRenamed("category", "pred"))))
    return _report(append_rows(*parts))


def _report(scored):
    report = classification_report(scored)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query()
def m4_validation_report(spark, sf):
    """The default model fitted on four fifths of the labelled posts, reported on the rest."""
    labelled = _posts(spark, sf).filter(F.col("split") == "train")
    with cached(assign_folds(labelled, "task1", 5)) as posts:
        validation = posts.filter(F.col("fold") == 0)
        model = M.fit_text_model(posts.filter(F.col("fold") > 0), "task1")
        scored = settle(attach_predictions(
            validation.select("id", F.col("task1").alias("gold")),
            M.predict(model, validation, ("id",)).withColumnRenamed("category", "pred")))
    return _report(scored)


WEIGHTS = ("SELECT task2, count(*) AS n_class, round((SELECT count(*) FROM v_posts WHERE task2 IS NOT NULL) / "
           "((SELECT count(DISTINCT task2) FROM v_posts) * count(*)), 6) AS weight "
           "FROM v_posts WHERE task2 IS NOT NULL GROUP BY task2")


@query(S.with_views(WEIGHTS, S.POSTS))
def m7_class_weights(spark, sf):
    labelled = views.posts(spark, sf).filter(F.col("task2").isNotNull())
    return M.class_weights(labelled, "task2").withColumn("weight", F.round("weight", 6))


def _binary(spark, sf):
    return _vectors(spark, sf).withColumn("label", (F.col("label") >= 5).cast("double"))


def _searched(spark, sf, name):
    """Mean score of every setting of a ``GRIDS`` entry."""
    model = M.grid_search(_binary(spark, sf), M.get_classifier(name, 1), M.GRIDS[name])
    return spark.createDataFrame(M.grid_scores(model), "setting string, score double")


@query()
def m7_grid_search(spark, sf):
    """The four distinct logistic settings on a binary target."""
    return _searched(spark, sf, "logistic_regression")


@query()
def m7_grid_search_baseline(spark, sf):
    return _searched(spark, sf, "baseline")


@query()
def m7_grid_search_svm(spark, sf):
    return _searched(spark, sf, "svm")


@query()
def m7_grid_search_forest(spark, sf):
    return _searched(spark, sf, "random_forest")


FOLDS = ("SELECT id, task2, (row_number() OVER (PARTITION BY task2 ORDER BY md5(concat('123|', id)), id) - 1) % 10 "
         "AS fold FROM v_posts WHERE task2 IS NOT NULL")


@query(S.with_views(FOLDS, S.POSTS))
def m8_assign_folds(spark, sf):
    labelled = views.posts(spark, sf).filter(F.col("task2").isNotNull())
    return assign_folds(labelled, "task2", 10).select("id", "task2", F.col("fold").cast("bigint"))


def _out_of_fold(spark, sf, k):
    vectors = _vectors(spark, sf)
    n = vectors.count()
    return M.cross_val_predict(
        vectors, lambda train: M.logistic_regression(n * (k - 1) / k).fit(train), k=k)


@query()
def m8_cross_val_predict(spark, sf):
    return _out_of_fold(spark, sf, 10)


@query()
def m8_cross_validate(spark, sf):
    """Per fold and averaged."""
    per_fold = M.cross_validate(_out_of_fold(spark, sf, 10)).withColumn(
        "fold", F.col("fold").cast("string"))
    metrics = [c for c in per_fold.columns if c != "fold"]
    mean = mean_metrics(per_fold, metrics).withColumn("fold", F.lit("mean"))
    return per_fold.unionByName(mean).withColumns({m: F.round(m, 6) for m in metrics})


SPLITS = ("SELECT id, repetition, CASE WHEN row_number() OVER (PARTITION BY repetition ORDER BY "
          "md5(concat('0|', repetition, '|', id)), concat(repetition, '|', id)) <= "
          "ceil((SELECT count(*) FROM v_posts WHERE task1 IS NOT NULL) * 0.7::double) THEN 'evaluate' ELSE 'tune' END AS part "
          "FROM v_posts, (SELECT unnest(generate_series(0, 9)) AS repetition) r WHERE task1 IS NOT NULL")


@query(S.with_views(SPLITS, S.POSTS))
def m9_shuffle_splits(spark, sf):
    labelled = views.posts(spark, sf).filter(F.col("task1").isNotNull()).select("id")
    return shuffle_splits(labelled, 10, 0.7).select(
        "id", F.col("repetition").cast("bigint"), "part")


@query()
def m9_repeated_split_scores(spark, sf):
    """Tune the whole grid on one part, cross-validate the best on the other, ten times."""
    return M.repeated_split_scores(
        _binary(spark, sf), M.logistic_regression, M.GRIDS["logistic_regression"])


@query()
def m10_two_heads(spark, sf):
    """Two heads over one embedding column, scored in one pass."""
    rows = views.logits(spark, sf).join(
        _vectors(spark, sf).select("id", "features"), "id").select("id", "features", "gold1", "gold2")
    heads = M.fit_two_heads(rows)
    return M.score_two_heads(heads, rows).select("id", "gold1", "pred1", "gold2", "pred2")


@query()
def m10_text_heads(spark, sf):
    """The same two heads over TF-IDF, with both label columns of the posts."""
    posts = _posts(spark, sf).withColumns({
        "gold1": F.when(F.col("task1") == "toxic", 1).when(F.col("task1") == "non-toxic", 0)
        .otherwise(-1),
        "gold2": F.coalesce(F.array_position(F.array(*[F.lit(x) for x in views.TASK2]),
                                             F.col("task2")).cast("int") - 1, F.lit(-1))})
    weigh = fit_tfidf(posts.filter(F.col("split") == "train"))
    vectors = weigh.transform(posts).select("id", "features", "gold1", "gold2", "split")
    heads = M.fit_two_heads(vectors.filter(F.col("split") == "train"))
    return M.score_two_heads(heads, vectors).select("id", "pred1", "pred2")
