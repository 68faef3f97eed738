"""E1-E13: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.functions.scores import argmax, cross_entropy, focal_loss
from postlab.operators import evaluate as E
from postlab.operators.sampling import assign_folds, shuffle
from postlab.plans import checksql as S
from postlab.plans import views
from postlab.plans.registry import query


def _scored(spark, sf):
    return views.logits(spark, sf).withColumns({
        "pred1": argmax(F.col("logits1")), "pred2": argmax(F.col("logits2"))})


def _task2(spark, sf):
    """Second head; ignored gold labels are no gold labels."""
    return _scored(spark, sf).filter(F.col("gold2") != -1).select(
        "id", F.col("gold2").alias("gold"), F.col("pred2").alias("pred"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


SCORED = """v_scored AS (SELECT *, list_position(logits1, list_max(logits1)) - 1 AS pred1,
  list_position(logits2, list_max(logits2)) - 1 AS pred2 FROM v_logits)"""
TASK2 = "v_task AS (SELECT id, gold2 AS gold, pred2 AS pred FROM v_scored WHERE gold2 <> -1)"


def _class_table(source: str, key: str = "") -> str:
    """Per label tp, support, predicted, by comparing every label with its rows."""
    cols = f"{key}, " if key else ""
    return f"""v_sides AS (
  SELECT {cols}gold AS label, 1 AS support, 0 AS predicted, cast(gold = pred AS int) AS tp FROM {source}
  UNION ALL SELECT {cols}pred, 0, 1, 0 FROM {source}),
v_sums AS (SELECT {cols}label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
  FROM v_sides GROUP BY {cols}label),
v_classes AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r,
  coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f FROM v_sums)"""


BASE = (S.LOGITS, SCORED, TASK2)


@query(S.with_views("SELECT id, cast(pred1 AS bigint) AS pred1, cast(pred2 AS bigint) AS pred2 "
                    "FROM v_scored", S.LOGITS, SCORED))
def e1_argmax(spark, sf):
    return _scored(spark, sf).select(
        "id", F.col("pred1").cast("bigint"), F.col("pred2").cast("bigint"))


@query(S.with_views("SELECT round(avg(cast(gold = pred AS int)), 6) AS accuracy FROM v_task", *BASE))
def e2_accuracy(spark, sf):
    return _rounded(E.accuracy(_task2(spark, sf)), "accuracy")


MACRO = "round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1"


@query(S.with_views(
    f"SELECT round(sum(tp) / sum(support), 6) AS accuracy, {MACRO} FROM v_classes",
    *BASE, _class_table("v_task")))
def e3_macro_scores(spark, sf):
    return _rounded(E.macro_scores(_task2(spark, sf)),
                    "accuracy", "macro_precision", "macro_recall", "macro_f1")


REPORT = """SELECT cast(label AS varchar) AS label, round(p, 6) AS precision, round(r, 6) AS recall,
  round(f, 6) AS f1, cast(support AS bigint) AS support FROM v_classes
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
  round(sum(tp) / sum(support), 6), cast(sum(support) AS bigint) FROM v_classes
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(support) AS bigint) FROM v_classes
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), cast(sum(support) AS bigint) FROM v_classes"""


@query(S.with_views(REPORT, *BASE, _class_table("v_task")))
def e4_classification_report(spark, sf):
    return _rounded(E.classification_report(_task2(spark, sf)), "precision", "recall", "f1")


RULE = ("v_task AS (SELECT language AS gold, CASE WHEN text LIKE '%ñ%' AND text LIKE '% la %' THEN 'es' "
        "WHEN text LIKE '% der %' THEN 'de' WHEN text LIKE '% le %' THEN 'fr' ELSE 'en' END AS pred "
        "FROM v_posts)")


def _language_guess(spark, sf):
    """String labels over all posts: the language against a word rule."""
    def has(part):
        return F.col("text").contains(part)

    return views.posts(spark, sf).select(
        F.col("language").alias("gold"),
        F.when(has("ñ") & has(" la "), "es").when(has(" der "), "de")
        .when(has(" le "), "fr").otherwise("en").alias("pred"))


@query(S.with_views(REPORT, S.POSTS, RULE, _class_table("v_task")))
def e4_report_over_languages(spark, sf):
    return _rounded(E.classification_report(_language_guess(spark, sf)),
                    "precision", "recall", "f1")


@query(S.with_views(
    "SELECT cast(g.label AS bigint) AS gold, cast(q.label AS bigint) AS pred, cast(count(t.id) AS bigint) AS n FROM labels_seen g "
    "JOIN labels_seen q ON true LEFT JOIN v_task t ON t.gold = g.label AND t.pred = q.label "
    "GROUP BY g.label, q.label",
    *BASE, "labels_seen AS (SELECT gold AS label FROM v_task UNION SELECT pred FROM v_task)"))
def e5_confusion_matrix(spark, sf):
    return E.confusion_matrix(_task2(spark, sf)).select(
        F.col("gold").cast("bigint"), F.col("pred").cast("bigint"), "n")


@query(S.with_views(
    "SELECT gold, " + ", ".join(
        f"count(*) FILTER (pred = '{x}') AS pred_{x}" for x in ("de", "en", "es", "fr"))
    + " FROM v_task GROUP BY gold", S.POSTS, RULE))
def e5_confusion_wide(spark, sf):
    return E.confusion_wide(
        E.confusion_matrix(_language_guess(spark, sf)), ["de", "en", "es", "fr"])


DERIVED = ("v_derived AS (SELECT id, gold1 AS gold, CASE WHEN pred2 <> 0 THEN 1 ELSE 0 END AS pred "
           "FROM v_scored)")


@query(S.with_views(
    f"SELECT round(sum(tp) / sum(support), 6) AS accuracy, {MACRO} FROM v_classes",
    S.LOGITS, SCORED, DERIVED, _class_table("v_derived")))
def e6_derived_task1_eval(spark, sf):
    derived = _scored(spark, sf).select(
        F.col("gold1").alias("gold"), E.derive_task1(F.col("pred2")).alias("pred"))
    return _rounded(E.macro_scores(derived),
                    "accuracy", "macro_precision", "macro_recall", "macro_f1")


STACKED = """v_stacked AS (SELECT 'task1' AS task, gold1 AS gold, pred1 AS pred FROM v_scored
  UNION ALL SELECT 'task2', gold2, pred2 FROM v_scored WHERE gold2 <> -1
  UNION ALL SELECT 'task1_from_task2', gold1, CASE WHEN pred2 <> 0 THEN 1 ELSE 0 END FROM v_scored)"""


@query(S.with_views(
    f"SELECT task, round(sum(tp) / sum(support), 6) AS accuracy, {MACRO} FROM v_classes GROUP BY task",
    S.LOGITS, SCORED, STACKED, _class_table("v_stacked", "task")))
def e7_multitask_eval(spark, sf):
    return _rounded(E.multitask_scores(_scored(spark, sf)),
                    "accuracy", "macro_precision", "macro_recall", "macro_f1")


def _logp(head: int) -> str:
    return (f"logits{head}[gold{head} + 1] - list_max(logits{head}) - ln(list_sum(list_transform("
            f"logits{head}, lambda x: exp(x - list_max(logits{head})))))")


LOGP = (f"v_logp AS (SELECT id, batch_id, {_logp(1)} AS logp1, "
        f"CASE WHEN gold2 <> -1 THEN {_logp(2)} END AS logp2 FROM v_logits)")


def _losses(spark, sf):
    return views.logits(spark, sf).select(
        "id", "batch_id", cross_entropy(F.col("logits1"), F.col("gold1")).alias("loss1"),
        cross_entropy(F.col("logits2"), F.col("gold2")).alias("loss2"))


@query(S.with_views("SELECT round(avg(-logp1), 6) AS loss1, round(avg(-logp2), 6) AS loss2, "
                    "count(logp2) AS n2 FROM v_logp", S.LOGITS, LOGP))
def e8_cross_entropy(spark, sf):
    return _losses(spark, sf).agg(
        F.round(F.avg("loss1"), 6).alias("loss1"), F.round(F.avg("loss2"), 6).alias("loss2"),
        F.count("loss2").alias("n2"))


@query(S.with_views(
    "SELECT round(avg(-pow(1 - exp(logp1), 2) * logp1), 6) AS loss1, "
    "round(avg(-pow(1 - exp(logp2), 2) * logp2), 6) AS loss2 FROM v_logp", S.LOGITS, LOGP))
def e9_focal_loss(spark, sf):
    return views.logits(spark, sf).agg(*[
        F.round(F.avg(focal_loss(F.col(f"logits{i}"), F.col(f"gold{i}"))), 6).alias(f"loss{i}")
        for i in (1, 2)])


@query(S.with_views("SELECT round(avg(-logp1), 6) AS loss1, round(avg(-logp2), 6) AS loss2, "
                    "round(avg(-logp1) + avg(-logp2), 6) AS loss FROM v_logp", S.LOGITS, LOGP))
def e10_multitask_loss_sum(spark, sf):
    return _rounded(E.multitask_loss(_losses(spark, sf)), "loss1", "loss2", "loss")


@query(S.with_views(
    "SELECT round(avg(-logp1), 6) AS loss1, round(avg(-logp2), 6) AS loss2, "
    "round(0.3::double * avg(-logp1) + 0.7::double * avg(-logp2), 6) AS loss FROM v_logp", S.LOGITS, LOGP))
def e10_multitask_loss_alpha(spark, sf):
    return _rounded(E.multitask_loss(_losses(spark, sf), alpha=0.3), "loss1", "loss2", "loss")


@query(S.with_views(
    "SELECT round(avg(b), 6) AS loss, count(b) AS n_batches FROM "
    "(SELECT batch_id, avg(-logp2) AS b FROM v_logp GROUP BY batch_id) x", S.LOGITS, LOGP))
def e11_epoch_loss(spark, sf):
    return _rounded(E.epoch_loss(_losses(spark, sf), "loss2"), "loss")


@query(S.with_views(
    "SELECT round(avg(b), 6) AS loss, count(b) AS n_batches FROM (SELECT batch, avg(-logp2) AS b FROM "
    "(SELECT *, (row_number() OVER (ORDER BY md5(concat('123|', cast(id AS varchar))), id) - 1) // 16 AS batch "
    "FROM v_logp) s GROUP BY batch) x", S.LOGITS, LOGP))
def e11_epoch_loss_shuffled(spark, sf):
    """Batches drawn by the seeded shuffle."""
    batches = shuffle(_losses(spark, sf).drop("batch_id"))
    return _rounded(E.epoch_loss(batches, "loss2"), "loss")


def _best_epoch(column: str, sign: str) -> str:
    """Early stopping by recursion: one step of the rule per epoch."""
    return S.with_views("""SELECT run_id, max(best_epoch) AS best_epoch, max(epoch) AS stop_epoch,
  arg_max(best, epoch) AS best_value FROM walk GROUP BY run_id""", "RECURSIVE_MARK " + S.METRIC_LOG, f"""
walk AS (
  SELECT run_id, epoch, {column} AS best, epoch AS best_epoch, 0 AS waited FROM v_metric_log WHERE epoch = 1
  UNION ALL
  SELECT l.run_id, l.epoch,
    CASE WHEN l.{column} {sign} w.best THEN l.{column} ELSE w.best END,
    CASE WHEN l.{column} {sign} w.best THEN l.epoch ELSE w.best_epoch END,
    CASE WHEN l.{column} {sign} w.best THEN 0 ELSE w.waited + 1 END
  FROM walk w JOIN v_metric_log l ON l.run_id = w.run_id AND l.epoch = w.epoch + 1
  WHERE w.waited < 8)""").replace("WITH RECURSIVE_MARK", "WITH RECURSIVE")


def _wide(best):
    return best.withColumns({c: F.col(c).cast("bigint") for c in ("best_epoch", "stop_epoch")})


@query(_best_epoch("macro_f1", ">"))
def e12_select_best_epoch_f1(spark, sf):
    return _wide(E.select_best_epoch(views.metric_log(spark, sf)))


@query(_best_epoch("loss", "<"))
def e12_select_best_epoch_loss(spark, sf):
    return _wide(E.select_best_epoch(views.metric_log(spark, sf), monitor="loss"))


@query(S.with_views(
    "SELECT round(avg(acc), 6) AS accuracy FROM (SELECT fold, avg(cast(gold = pred AS int)) AS acc FROM "
    "(SELECT *, (row_number() OVER (PARTITION BY gold ORDER BY md5(concat('123|', cast(id AS varchar))), id) - 1) % 10 "
    "AS fold FROM v_task) f GROUP BY fold) x", *BASE))
def e13_mean_metrics(spark, sf):
    folds = assign_folds(_task2(spark, sf), "gold", 10)
    return _rounded(E.mean_metrics(E.macro_scores(folds, by=("fold",)), ["accuracy"]), "accuracy")


@query(S.with_views(
    "SELECT round(avg(acc), 6) AS accuracy FROM (SELECT task, avg(acc) AS acc FROM "
    "(SELECT task, fold, avg(cast(gold = pred AS int)) AS acc FROM (SELECT *, id % 10 AS fold FROM ("
    "SELECT id, 'task1' AS task, gold1 AS gold, pred1 AS pred FROM v_scored UNION ALL "
    "SELECT id, 'task2', gold, pred FROM v_task) u) f GROUP BY task, fold) x GROUP BY task) y", *BASE))
def e13_mean_metrics_splits(spark, sf):
    """Folds first, then the groups the folds belong to."""
    first = _scored(spark, sf).select(
        "id", F.lit("task1").alias("task"), F.col("gold1").alias("gold"),
        F.col("pred1").alias("pred"))
    second = _task2(spark, sf).withColumn("task", F.lit("task2"))
    both = first.unionByName(second).withColumn("fold", F.col("id") % 10)
    scores = E.macro_scores(both, by=("task", "fold"))
    return _rounded(E.mean_metrics(scores, ["accuracy"], split="task"), "accuracy")
