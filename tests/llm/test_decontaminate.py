import tracemalloc
from collections import Counter

import numpy as np

from postlab.llm import decontaminate as D

ITEMS = [
    (1, "What is the highest mountain on the whole earth today? It is called mount everest by most people."),
    (2, "Name the river that flows through the old city of vienna and many other towns"),
    (3, None), (4, "..."), (5, "Who wrote this? Nobody."),
]


def index(items):
    sizes = [len(D.words_of(t)) for _, t in items]
    seen = Counter(w for _, t in items for w in set(D.words_of(t)))
    return D.Index(items, len(items), sum(sizes) / len(sizes), seen), max(sizes)


def test_search_finds_all_above_the_threshold():
    rng = np.random.default_rng(2)
    words = [f"w{int(x)}" for x in np.sqrt(rng.integers(0, 3600, 4000))]
    items = [(i, " ".join(words[i * 12:i * 12 + 8 + i % 5])) for i in range(120)]
    made, _ = index(items)
    impact = {}
    for t, i, x in zip(made.term, made.item, made.impact):
        impact.setdefault(int(i), {})[int(t)] = float(x)
    passages = [sorted(set(rng.integers(0, len(made.terms), 25).tolist())) for _ in range(200)]
    who = np.repeat(np.arange(200), [len(p) for p in passages])
    for least in (0.05, 0.3, 0.6):
        got = {(int(p), int(i)): s for p, i, s in zip(*made.search(who, np.concatenate(passages), least))}
        expected = {(p, i): sum(x.get(t, 0) for t in ts) for p, ts in enumerate(passages)
                    for i, x in impact.items()}
        expected = {k: s for k, s in expected.items() if s >= least}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - s) < 1e-9 for k, s in expected.items())
    assert all(abs(sum(x.values()) - 1) < 1e-9 for x in impact.values())


def test_search_of_a_slice_without_essential_terms(monkeypatch):
    made, longest = index([(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(12)])
    alone = np.array([made.terms[f"alpha{i}"] for i in range(12)])
    who = np.arange(12)
    assert made.term_most[alone].max() < 0.35
    found = made.search(who, alone, 0.35)  # no passage can reach the threshold
    assert [len(column) for column in found] == [0, 0, 0]
    monkeypatch.setattr(D, "CELLS", 1)  # each passage is a slice; one holds an item
    whole = sorted(made.terms[f"{w}5"] for w in ("alpha", "beta", "gamma", "delta"))
    who = np.concatenate([who, np.full(4, 12), who + 13])
    passage, item, score = made.search(who, np.concatenate([alone, whole, alone]), 0.35)
    assert (passage.tolist(), item.tolist()) == ([12], [5]) and abs(score[0] - 1) < 1e-9
    texts = [["alpha1", "none"], "alpha5 beta5 gamma5 delta5".split(), ["none"], [], ["delta2"]]
    assert [(text, i) for text, i, *_ in made.leaks(texts, longest, 0.35)] == [(1, 5)]


def test_parts():
    assert D.question_and_answer("Who? Me and you.") == (["who"], ["me", "and", "you"])
    assert D.question_and_answer("no end") == (["no", "end"], ["no", "end"])
    assert D.overlap(list("abcdef"), list("xabcdey")) == 0.5
    assert D.overlap(["a", "b"], ["b", "a", "b"]) == 1.0 and D.overlap([], ["a"]) == 0.0


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ITEMS", 2)
    filler = "completely unrelated words stand here in front " * 40
    rows = [(1, filler + ITEMS[0][1] + filler), (2, ITEMS[1][1].upper()), (2, ITEMS[1][1]), (3, None), (4, ""),
            (5, ITEMS[0][1].split("?")[0]), (6, "the mountain on the river of the city"), (7, filler),
            (None, ITEMS[1][1]), (2 ** 60 + 1, ITEMS[1][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (None, 2), (2 ** 60 + 1, 2)}
    assert D.find_leaks(docs, items).count() == 4
    assert D.find_leaks(docs, items.limit(0)).count() == D.find_leaks(docs.limit(0), items).count() == 0


def test_documents_that_share_a_few_words_with_items(spark):
    docs = spark.createDataFrame([(i, "a mountain and a river") for i in range(3)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_leaks(docs, items).count() == 0
    leaky = docs.union(spark.createDataFrame([(7, ITEMS[1][1])], docs.schema)).coalesce(1)
    assert [(r.doc_id, r.item_id) for r in D.find_leaks(leaky, items).collect()] == [(7, 2)]


def test_a_search_over_many_words_takes_bounded_memory():
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in np.sqrt(rng.integers(0, 90_000, 200 * 16))]
    made, longest = index([(i, " ".join(words[i * 16:i * 16 + 16])) for i in range(200)])
    texts = [[f"w{int(x)}" for x in rng.integers(0, 300, 256)] for _ in range(1024)]
    tracemalloc.start()
    try:
        list(made.leaks(texts, longest, 0.35))
        assert tracemalloc.get_traced_memory()[1] < 128 << 20
    finally:
        tracemalloc.stop()
