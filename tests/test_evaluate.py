import math

import pytest
from pyspark.sql import functions as F

from postlab.functions.scores import argmax, cross_entropy, focal_loss
from postlab.operators import evaluate as E


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "gold int, pred int")


def test_report_by_hand(spark):
    # Label 2 is never gold, label 3 is never predicted.
    df = scored(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (3, 0)])
    rows = {r.label: r for r in E.classification_report(df).collect()}
    assert set(rows) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert rows["0"].precision == pytest.approx(2 / 3) and rows["0"].recall == pytest.approx(2 / 3)
    assert rows["1"].f1 == pytest.approx(0.5) and rows["1"].support == 2
    assert (rows["2"].precision, rows["2"].recall, rows["2"].support) == (0, 0, 0)
    assert (rows["3"].precision, rows["3"].recall, rows["3"].f1) == (0, 0, 0)
    assert rows["accuracy"].f1 == pytest.approx(0.5)
    assert rows["macro avg"].f1 == pytest.approx((2 / 3 + 0.5) / 4)
    assert rows["weighted avg"].f1 == pytest.approx((3 * 2 / 3 + 2 * 0.5) / 6)
    assert rows["weighted avg"].support == 6
    macro = E.macro_scores(df).first()
    assert macro.accuracy == pytest.approx(0.5)
    assert macro.macro_recall == pytest.approx((2 / 3 + 0.5) / 4)


def test_confusion_has_zero_cells(spark):
    df = scored(spark, [(0, 0), (0, 2)])
    matrix = E.confusion_matrix(df)
    assert {(r.gold, r.pred): r.n for r in matrix.collect()} == {
        (0, 0): 1, (0, 2): 1, (2, 0): 0, (2, 2): 0}
    wide = {r.gold: (r.pred_0, r.pred_2) for r in E.confusion_wide(matrix, [0, 2]).collect()}
    assert wide == {0: (1, 1), 2: (0, 0)}


def losses(spark, rows):
    df = spark.createDataFrame(rows, "x array<double>, y int")
    return [
        (r.c, r.f) for r in df.select(
            cross_entropy(F.col("x"), F.col("y")).alias("c"),
            focal_loss(F.col("x"), F.col("y")).alias("f")).collect()]


def test_losses_by_hand(spark):
    rows = [([0.0, 0.0], 0), ([1.0, 3.0, 2.0], 2), ([1000.0, 0.0], 1), ([1.0, 2.0], -1)]
    got = losses(spark, rows)
    total = sum(math.exp(v) for v in (1, 3, 2))
    p = math.exp(2) / total
    assert got[0][0] == pytest.approx(math.log(2))
    assert got[0][1] == pytest.approx(0.25 * math.log(2))
    assert got[1][0] == pytest.approx(-math.log(p))
    assert got[1][1] == pytest.approx(-(1 - p) ** 2 * math.log(p))
    assert got[2][0] == pytest.approx(1000.0)
    assert got[3] == (None, None)


def test_all_labels_ignored(spark):
    df = spark.createDataFrame([([1.0, 2.0], -1)], "x array<double>, y int")
    assert df.agg(F.avg(cross_entropy(F.col("x"), F.col("y"))).alias("l")).first().l is None


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0],)], "x array<double>")
    assert df.select(argmax(F.col("x")).alias("a")).first().a == 1


def test_epoch_loss_differs_only_for_a_short_batch(spark):
    even = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0)],
                                 "batch_id int, loss double")
    assert E.epoch_loss(even).first().loss == even.agg(F.avg("loss")).first()[0]
    short = even.filter("loss < 7")
    assert E.epoch_loss(short).first().loss == pytest.approx(3.5)


def test_multitask(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 0), (1, 0, 2, 2), (1, 1, -1, 1)], "gold1 int, pred1 int, gold2 int, pred2 int")
    rows = {r.task: r.accuracy for r in E.multitask_scores(df).collect()}
    assert rows == {"task1": pytest.approx(2 / 3), "task2": 1.0, "task1_from_task2": 1.0}
    frame = spark.createDataFrame([(1.0, 4.0), (3.0, None)], "loss1 double, loss2 double")
    assert E.multitask_loss(frame).first().loss == 6.0
    assert E.multitask_loss(frame, alpha=0.25).first().loss == pytest.approx(3.5)


def walk(values, monitor, patience):
    """The early-stopping rule as a plain loop: (best epoch, stop epoch)."""
    best, best_epoch, waited, epoch = None, None, 0, 0
    for epoch, v in enumerate(values, 1):
        if best is None or (v < best if monitor == "loss" else v > best):
            best, best_epoch, waited = v, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best_epoch, epoch, best


@pytest.mark.parametrize("monitor", ["loss", "macro_f1"])
def test_best_epoch_equals_a_plain_loop(spark, monitor):
    import random

    rng = random.Random(5)
    runs = {i: [rng.randint(0, 9) / 10 for _ in range(rng.randint(1, 20))] for i in range(60)}
    rows = [(i, e, v, v) for i, vs in runs.items() for e, v in enumerate(vs, 1)]
    log = spark.createDataFrame(rows, "run_id int, epoch int, loss double, macro_f1 double")
    got = E.select_best_epoch(log, monitor, patience=3).collect()
    assert {r.run_id: (r.best_epoch, r.stop_epoch, r.best_value) for r in got} == {
        i: walk(vs, monitor, 3) for i, vs in runs.items()}


def test_nan_never_improves_and_stays_if_it_opens_a_run(spark):
    nan = float("nan")
    runs = {0: [0.9, 0.8, nan, 0.1], 1: [nan, 0.5, 0.4], 2: [0.5, nan, nan]}
    rows = [(i, e, v, v) for i, vs in runs.items() for e, v in enumerate(vs, 1)]
    log = spark.createDataFrame(rows, "run_id int, epoch int, loss double, macro_f1 double")
    best = {r.run_id: r.best_epoch for r in E.select_best_epoch(log, "loss").collect()}
    assert best == {0: 4, 1: 1, 2: 1}
    best = {r.run_id: r.best_epoch for r in E.select_best_epoch(log, "macro_f1").collect()}
    assert best == {0: 1, 1: 1, 2: 1}


def test_mean_metrics(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0), (0, 1, 0.0), (0, 2, 0.5), (1, 0, 1.0)], "split int, fold int, acc double")
    assert E.mean_metrics(df, ["acc"], split="split").first().acc == pytest.approx(0.75)
    assert E.mean_metrics(df, ["acc"]).first().acc == pytest.approx(0.625)
