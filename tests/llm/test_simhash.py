import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from postlab.llm import simhash as S


def test_fingerprint_is_the_majority_of_each_bit():
    for text in ("The quick  brown\tfox JUMPS over É the lazy dog " * 3, "one two", "Ab"):
        words = [w for w in text.encode().lower().split() if w]
        shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert S.bit_majority(text) == expected
    assert S.bit_majority("") == S.bit_majority(" \n") == 0
    assert S.bit_majority("a\u00a0b c") == S.bit_majority("A\u00a0B C")


def test_a_query_visits_the_leaves_of_all_values_within_one_bit():
    random_ = np.random.default_rng(3)
    weights = random_.integers(0, 50, 1 << 16).astype(float)
    weights[77] = 1e6
    tree = S.VantageTree(weights, weights.sum() / 40, seed=1)
    assert tree.leaves > 10
    for value in random_.integers(0, 1 << 16, 300):
        visited = set(tree.visited[tree.first[value]:tree.first[value + 1]].tolist())
        near = [value, *(value ^ (1 << i) for i in range(16))]
        assert {int(tree.home[v]) for v in near} <= visited


def clusters(rng, n):
    values = set()
    for _ in range(n):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 3)):
                centre ^= 1 << rng.randrange(64)
            values.add(centre)
    return sorted(values)


def brute_force(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(v for v in values if find(v) == r) for r in values if root[r] == r}


def test_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF_LEAST", 20)
    monkeypatch.setattr(S, "SHARD_MOST", 7)  # leaves become grids too
    values = clusters(random.Random(4), 150)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "bits long")
    roots = {r.node: r.root for r in S.components(S.links(frame)).collect()}
    groups = {}
    for v, s in zip(values, signed):
        groups.setdefault(roots.get(s, s), set()).add(v)
    assert {frozenset(g) for g in groups.values()} == brute_force(values)


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(7, text), (3, text.upper()), (9, "other " + "thing " * 40), (1, None), (5, " "), (5, " "),
            (None, text), (2, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bits int")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 3), (3, 3), (9, 9), (1, 1), (5, 1), (5, 1), (None, 3), (2, 2)], key=repr)
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_the_grid_bounds_visitors_too(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_MOST", 100)
    monkeypatch.setattr(S, "VISITORS_MOST", 300)
    random_ = np.random.default_rng(5)
    hot = np.uint64(0x1234)
    low = np.concatenate([np.full(4000, hot), *(np.full(40, hot ^ np.uint64(1 << i)) for i in range(16))])
    values = np.unique(random_.integers(0, 1 << 48, len(low), dtype=np.uint64) << np.uint64(16) | low.astype(np.uint64))
    weights = np.bincount((values & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16).astype(float)
    tree = S.VantageTree(weights, 50, seed=0)
    routed = S.route(values, [tree], [S.grid_of(tree, weights)])
    sizes = routed.groupby(["shard", "resident"]).size()
    assert sizes.xs(True, level="resident").max() <= 1.6 * 100 and sizes.xs(False, level="resident").max() <= 1.6 * 300
    # Every resident of a leaf meets each of its visitors in exactly one cell.
    at = {kind: rows.groupby("bits")["shard"].agg(set) for kind, rows in routed.groupby("resident")}
    for a in random_.choice(values, 20).view(np.int64):
        assert all(len(at[True][a] & at[False][b]) == 1 for b in
                   (values[((values ^ np.int64(a).view(np.uint64)) & np.uint64(0xFFFF)) == 0][:50]).view(np.int64))
