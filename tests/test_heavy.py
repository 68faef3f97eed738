import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlab.operators import features as X
from postlab.operators.heavy import candidates, summary


def batches(posts, size):
    for i in range(0, len(posts), size):
        yield pa.record_batch([pa.array(posts[i:i + size], pa.list_(pa.string()))], ["terms"])


@pytest.mark.parametrize("percent", [1, 5, 40, 100])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_no_frequent_term_is_missed(percent, size):
    draw = random.Random(percent * size)
    posts = [sorted({f"t{int(draw.paretovariate(0.6))}" for _ in range(8)}) for _ in range(1500)]
    posts += [None, []] * 5
    draw.shuffle(posts)
    count = Counter(t for p in posts for t in p or [])
    frequent = {t for t, c in count.items() if c * 100 >= percent * len(posts)}
    found = {t for b in summary(batches(posts, size), percent) for t in b.column(0).to_pylist()}
    assert frequent <= found
    # Nothing far below the bound is kept.
    assert all(count[t] * 200 >= percent * len(posts) - 200 for t in found)


def test_the_summary_does_not_grow_with_the_vocabulary():
    posts = [["the", f"own{i}", f"other{i}"] for i in range(20_000)]
    found = [t for b in summary(batches(posts, 500), 1) for t in b.column(0).to_pylist()]
    assert found == ["the"]


def test_a_term_of_one_task_alone(spark):
    """One percent of all rows, all of them in one partition, nulls among the tokens."""
    df = spark.range(0, 1000, 1, 4).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") < 10, F.array(F.lit("x"), F.lit(None)))
        .when(F.col("id") < 19, F.array(F.lit("y")))
        .otherwise(F.array(F.lit("z"), F.col("id").cast("string"))).alias("tokens"))
    assert {"x", "z"} <= {r.term for r in candidates(df, "tokens", 1).collect()}
    kept = X.bag_of_words(df).groupBy("term").agg(F.max("df").alias("df")).collect()
    assert {r.term: r.df for r in kept} == {"x": 10, "z": 981}


def test_candidates_too_large_to_travel_give_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame(
        [("1", ["a", "b", "a"]), ("1", ["b"]), (None, ["c"]), ("2", None)],
        "id string, tokens array<string>")
    want = sorted(map(str, X.tfidf(df).collect()))
    narrow = X.narrowed
    monkeypatch.setattr(X, "narrowed", lambda *a: narrow(*a, limit=0))
    assert sorted(map(str, X.tfidf(df).collect())) == want
