"""Evaluation as aggregates.

Every count-based score starts from the confusion cells ``(gold, pred, n)``: one
map-side-combined pass over the scored rows, then arithmetic on a table that is
only as large as the label set squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.functions.scores import IGNORED_LABEL


def confusion_cells(scored: DataFrame, gold: str = "gold", pred: str = "pred",
                    by: tuple[str, ...] = ()) -> DataFrame:
    return (scored.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def class_scores(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per label: precision, recall, f1, support; zero where undefined."""
    hit = F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("s")
    sums = (cells.select(*by, sides).groupBy(*by, F.col("s.label").alias("label"))
            .agg(F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"),
                 F.sum("s.predicted").alias("predicted")))
    return sums.select(
        *by, "label", "tp",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support")


def _macro(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"))


def accuracy(scored: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return scored.agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))


def macro_scores(scored: DataFrame, gold: str = "gold", pred: str = "pred",
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and unweighted class means over labels seen in gold or pred."""
    return _macro(class_scores(confusion_cells(scored, gold, pred, by), by), by)


def classification_report(scored: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row per class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    The accuracy row repeats the accuracy in all three columns: with one label
    per row, micro-averaged precision, recall and f1 are all equal to it.
    """
    scores = class_scores(confusion_cells(scored, gold, pred))
    values = ("precision", "recall", "f1")
    total = F.sum("support")
    weighted = [F.sum(F.col(v) * F.col("support")) / total for v in values]
    hits = [F.sum("tp") / total] * 3
    means = [F.avg(v) for v in values]

    def line(name: str, cells: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("label"),
                        *[c.alias(v) for c, v in zip(cells, values)], total.alias("support"))

    summary = scores.agg(F.array(
        line("accuracy", hits), line("macro avg", means), line("weighted avg", weighted),
    ).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    classes = scores.select(F.col("label").cast("string").alias("label"), *values, "support")
    return classes.unionByName(summary)


def confusion_matrix(scored: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``(gold, pred, n)`` for all pairs of labels, zero cells included."""
    cells = confusion_cells(scored, gold, pred)
    labels = (cells.select(F.explode(F.array("gold", "pred")).alias("label"))
              .agg(F.array_sort(F.collect_set("label")).alias("labels")))
    grid = (labels.select("labels", F.explode("labels").alias("gold"))
            .select("gold", F.explode("labels").alias("pred"), F.lit(0).cast("bigint").alias("n")))
    return (cells.unionByName(grid).groupBy("gold", "pred").agg(F.sum("n").alias("n")))


def confusion_wide(matrix: DataFrame, labels: list) -> DataFrame:
    """The matrix with one ``pred_<label>`` column per label."""
    wide = matrix.groupBy("gold").pivot("pred", labels).agg(F.first("n"))
    return wide.select("gold", *[F.col(str(x)).alias(f"pred_{x}") for x in labels])


def derive_task1(pred2: Column, negative: int = 0) -> Column:
    return F.when(pred2 != negative, 1).otherwise(0)


def multitask_scores(scored: DataFrame, ignore: int = IGNORED_LABEL) -> DataFrame:
    """Both heads and task 1 derived from the second head, in one pass.

    Needs ``gold1, pred1, gold2, pred2``; ignored gold labels are left out.
    """
    stacked = scored.select(F.explode(F.array(
        F.struct(F.lit("task1").alias("task"), F.col("gold1").alias("gold"),
                 F.col("pred1").alias("pred")),
        F.struct(F.lit("task2").alias("task"), F.col("gold2").alias("gold"),
                 F.col("pred2").alias("pred")),
        F.struct(F.lit("task1_from_task2").alias("task"), F.col("gold1").alias("gold"),
                 derive_task1(F.col("pred2")).alias("pred")))).alias("s")).select("s.*")
    return macro_scores(stacked.filter(F.col("gold") != ignore), by=("task",))


def multitask_loss(losses: DataFrame, alpha: float | None = None) -> DataFrame:
    """``loss1 + loss2``, or ``alpha * loss1 + (1 - alpha) * loss2``.

    Takes per-row ``loss1, loss2`` that are NULL where the label is ignored.
    """
    first, second = F.avg("loss1"), F.avg("loss2")
    joined = first + second if alpha is None else alpha * first + (1 - alpha) * second
    return losses.agg(first.alias("loss1"), second.alias("loss2"), joined.alias("loss"))


def epoch_loss(losses: DataFrame, loss: str = "loss", batch: str = "batch_id") -> DataFrame:
    """Mean over batches of the batch means."""
    return (losses.groupBy(batch).agg(F.avg(loss).alias("batch_loss"))
            .agg(F.avg("batch_loss").alias("loss"), F.count("batch_loss").alias("n_batches")))


def select_best_epoch(log: DataFrame, monitor: str = "macro_f1", patience: int = 8,
                      max_epochs: int = 20) -> DataFrame:
    """Per run: the last improving epoch before training stops, and the stop epoch.

    ``log`` has ``run_id, epoch, loss, macro_f1``. Better means strictly higher
    f1 or strictly lower loss; NaN never improves on a number, and nothing improves on
    a run that opens with NaN. A run ends after ``patience`` epochs in a row
    without improvement, or with its last epoch; it never has more than
    ``max_epochs`` of them, which also bounds what one window group can hold.
    """
    value = -F.col(monitor) if monitor == "loss" else F.col(monitor)
    run = Window.partitionBy("run_id").orderBy("epoch")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    # Spark orders NaN above all numbers; comparisons here must be false with it.
    number = F.when(~F.isnan("_value"), F.col("_value"))
    best_before = F.max(number).over(earlier)
    opened = F.first(number).over(so_far)
    steps = (
        log.filter(F.col("epoch") <= max_epochs)
        .withColumn("_value", value)
        .withColumn("_step", F.row_number().over(run))
        .withColumn("_better", (F.col("_step") == 1) | F.coalesce(
            opened.isNotNull() & (number > best_before), F.lit(False)))
        .withColumn("_last", F.max(F.when(F.col("_better"), F.col("_step"))).over(so_far))
        .withColumn("_stopped", F.max(
            (F.col("_step") - F.col("_last") >= patience).cast("int")).over(earlier)))
    seen = steps.filter(F.coalesce("_stopped", F.lit(0)) == 0)
    return seen.groupBy("run_id").agg(
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.max_by(monitor, F.when(F.col("_better"), F.col("epoch"))).alias("best_value"),
        F.max("epoch").alias("stop_epoch"))


def mean_metrics(scores: DataFrame, metrics: list[str], fold: str = "fold",
                 split: str | None = None) -> DataFrame:
    """Mean of each metric over folds, then over splits."""
    if split is None:
        return scores.agg(*[F.avg(m).alias(m) for m in metrics])
    per_split = scores.groupBy(split).agg(*[F.avg(m).alias(m) for m in metrics])
    return per_split.agg(*[F.avg(m).alias(m) for m in metrics])
