import itertools
import random
import re

import numpy as np
import pytest

from postlab.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n int, print string, cls int"


def plain_set(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows):
    """Smallest id per row by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            label = [label[a] if x == label[b] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min([v for v in (i, least.get(x)) if v is not None], default=None)
    return [(i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label)]


def near_copies(rng, n):
    vocabulary = [f"W{i}é" for i in range(60)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=rng.randint(1, 8))
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 4, 5, 6, 20, 60, 150]))
            if kind > 0.8:
                words = passage + words
        texts.append(rng.choice([" ", "\t", "\n "]).join(words))
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    """Also with groups and tasks so small that most links cross them."""
    if small:
        monkeypatch.setattr(jaccard, "GROUP_TOKENS", 100)
        monkeypatch.setattr(jaccard, "STRETCH", 500)
    rng = random.Random(4)
    texts = near_copies(rng, 400) + [None, None, "", " \t", "same", "SAME", "same ", "a b c d e"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[9]), (3, None)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in jaccard.near_duplicates(df).collect()]
    want = [(i, n, c) for i, n, c in plain_components(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_group_labels_equal_all_pairs():
    rng = random.Random(5)
    for _ in range(30):
        sets = [jaccard.shingle_set(t) for t in near_copies(rng, 60)]
        sets = [np.array(s) for s in {tuple(s) for s in sets}]
        want = list(range(len(sets)))
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                want = [want[a] if x == want[b] else x for x in want]
        got = jaccard.group_labels(sets).tolist()
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_leading_tokens_meet_often_enough():
    """Two sets in one order, as far apart as the bound allows, meet as often as the rule says."""
    for n in range(1, 300):
        lead = n - jaccard.at_least(n) + jaccard.meetings(n)
        for m in range(jaccard.at_least(n), n + 1):
            both = -(-80 * (n + m) // 180)
            if both <= m:  # the shared tokens come last in both sets
                first = m - jaccard.at_least_larger(m) + jaccard.meetings(m)
                meet = min(first - (m - both), lead - (n - both))
                assert meet >= jaccard.meetings(m) >= jaccard.meetings(jaccard.at_least(n))


def test_union_bounds_the_overlap():
    members = [np.arange(0, 10, dtype=np.uint64), np.arange(20, 30, dtype=np.uint64)]
    queries = [np.arange(2, 12, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64), np.arange(40, 45, dtype=np.uint64)]
    assert jaccard.opened(members, queries, 80).tolist() == [False, False, False]
    assert jaccard.opened(members, [np.arange(1, 10, dtype=np.uint64), *queries], 80).tolist() == [True] + [False] * 3


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(40_000))
    whole = jaccard.shingle_set(text)
    monkeypatch.setattr(jaccard, "PIECE", 101)
    assert (jaccard.shingle_set(text) == whole).all() and len(whole) == len(plain_set(text))


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
