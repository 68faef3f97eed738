import hashlib
import math

import pytest
from pyspark.sql import functions as F

from postlab.operators import sampling as B


def posts(spark, n, partitions=4):
    # Two thirds of the rows are in one class.
    label = F.when(F.col("id") % 3 == 0, "rare").otherwise("hot")
    return (spark.range(n).withColumn("label", label)
            .withColumn("id", F.col("id").cast("string")).repartition(partitions))


def order(ids, seed=123):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n, fraction", [(0, 0.5), (1, 0.01), (50, 0.01), (150, 0.01),
                                         (1000, 0.3), (1000, 1.0), (37, 0.0)])
def test_sample_is_exact(spark, n, fraction):
    kept = [r.id for r in B.sample_fraction(posts(spark, n), fraction).collect()]
    assert sorted(kept) == sorted(order([str(i) for i in range(n)])[:round(fraction * n)])


def test_sample_does_not_depend_on_partitions(spark):
    draws = [sorted(r.id for r in B.sample_fraction(posts(spark, 500, p), 0.1).collect())
             for p in (1, 7)]
    assert draws[0] == draws[1]
    other = sorted(r.id for r in B.sample_fraction(posts(spark, 500), 0.1, seed=1).collect())
    assert other != draws[0]


def test_few_buckets_give_the_same_choice(spark, monkeypatch):
    expected = order([str(i) for i in range(300)])
    monkeypatch.setattr(B, "PREFIX", 1)
    kept = B.keep_exactly(posts(spark, 300), lambda total: F.lit(77)).collect()
    assert sorted(r.id for r in kept) == sorted(expected[:77])
    ranked = B.rank_by_hash(posts(spark, 300)).collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r["rank"])] == expected


@pytest.mark.parametrize("n", [0, 10, 10_000])
def test_downsample(spark, n):
    kept = B.downsample(posts(spark, 200), "label", "hot", n).collect()
    hot = [r.id for r in kept if r.label == "hot"]
    assert len(kept) - len(hot) == 67
    assert len(hot) == min(n, 133)


def test_downsample_keeps_rows_without_a_class(spark):
    df = spark.createDataFrame([("1", None), ("2", "x"), ("3", "x")], "id string, label string")
    kept = B.downsample(df, "label", "x", 1).collect()
    assert len(kept) == 2 and any(r.label is None for r in kept)


def test_balance(spark):
    kept = B.balance_to_minority(posts(spark, 200), "label", "hot", "rare")
    assert {r.label: r.n for r in B.class_counts(kept, "label").collect()} == {
        "hot": 67, "rare": 67}


def test_shuffle(spark):
    rows = B.shuffle(posts(spark, 100), batch_size=16).orderBy("position").collect()
    assert [r.id for r in rows] == order([str(i) for i in range(100)])
    assert [r.position for r in rows] == list(range(1, 101))
    assert [r.batch_id for r in rows] == [i // 16 for i in range(100)]


def test_folds_are_stratified(spark):
    rows = B.assign_folds(posts(spark, 200), "label", 7).collect()
    for label, size in (("hot", 133), ("rare", 67)):
        counts = [sum(r.fold == f and r.label == label for r in rows) for f in range(7)]
        assert sum(counts) == size and max(counts) - min(counts) <= 1


def test_shuffle_splits(spark):
    rows = B.shuffle_splits(posts(spark, 45), 3, 0.7).collect()
    parts = {}
    for r in rows:
        parts.setdefault((r.repetition, r.part), set()).add(r.id)
    for i in range(3):
        assert len(parts[i, "evaluate"]) == math.ceil(45 * 0.7)
        assert not parts[i, "evaluate"] & parts[i, "tune"]
        assert len(parts[i, "evaluate"] | parts[i, "tune"]) == 45
    assert parts[0, "tune"] != parts[1, "tune"]
