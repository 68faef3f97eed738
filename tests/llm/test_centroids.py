import hashlib
import math
import random

import numpy as np
import pytest

from postlab.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, products int, v string"


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in start[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(middle)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if own:
                middle[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for c, d in found if c == j) for j in range(len(middle))]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest())
            for (i, _), (c, d) in zip(kept, found)]


def vectors(rng, n):
    rows = [(i, [rng.gauss(i % 5, 2) for _ in range(64)]) for i in range(n)]
    odd = [(None, rows[1][1]), (3, rows[3][1]), (3, rows[4][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 65),
           (903, [None] + [1.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [0.0] * 64),
           (907, [])]
    return rows + odd + [(908, [0.0] * 64)] * 20


@pytest.mark.parametrize("n", [0, 5, 300])
def test_equals_plain_python(spark, n):
    rows = vectors(random.Random(n), n) if n > 5 else [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in centroids.cluster(df).drop("products").collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_products_stay_exact(spark):
    rows = vectors(random.Random(1), 60)
    out = centroids.cluster(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), rounds=3)
    kept = {r.vec_id: r.v for r in centroids.integers(
        spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)).collect() if r.vec_id not in (3, None)}
    for r in out.collect():
        if r.vec_id in kept:
            assert all(p % 1 == 0 for p in r.products) and len(r.products) == 8


def test_only_changed_components_count():
    rng = np.random.default_rng(2)
    vectors_, before = rng.integers(-9, 9, (50, 64)), rng.integers(-9, 9, (8, 64))
    after = before.copy()
    after[2, 5] += 3
    after[7] = rng.integers(-9, 9, 64)
    assert (centroids.moved_products(vectors_ @ before.T, vectors_, before, after) == vectors_ @ after.T).all()


def test_ties_go_to_the_smaller_number():
    cluster, distance = centroids.nearest(np.array([[0, 0]]), np.array([4]), np.array([[0, 2], [2, 0]]))
    assert cluster.tolist() == [0] and distance.tolist() == [8]


def test_components_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 0, "")], SCHEMA)
    with pytest.raises(ValueError):
        centroids.cluster(df)
