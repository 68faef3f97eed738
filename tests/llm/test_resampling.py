import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from postlab.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight int, features string"


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain_draw(rows, target):
    docs = [plain_features(t) for _, t in rows]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, f in docs:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text)[1], 1)
    total_s, total_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (total_s + 10_000) / ((int(s[b]) + 1) * (total_t + 10_000))))
            for b in range(10_000)]
    out = []
    for (i, _), (words, f) in zip(rows, docs):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                    words >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(*r[:4], n) for n, r in enumerate(able[:25 * len(able) // 100], 1)]
    return ranks + [(*r[:4], None) for r in able[25 * len(able) // 100:]] + [(*r[:4], None) for r in out if not r[4]]


def texts(rng, n):
    words = ["The", "the", "a1", "é", "ÀB", "x" * 300, "y" * 5000, "日本", "z", "q9", "\u0085", "\xa0u", "K"]
    gaps = [" ", "-", "\n\n", "_", "\x00", "/", ". "]
    return ["".join(w for _ in range(rng.choice([0, 1, 2, 19, 20, 60])) for w in (rng.choice(words), rng.choice(gaps)))
            for _ in range(n)]


@pytest.mark.parametrize("stretch", [None, 50])
def test_features(monkeypatch, stretch):
    """Also with stretches shorter than a word, so that texts are scanned in pieces."""
    if stretch:
        monkeypatch.setattr(resampling, "STRETCH", stretch)
    some = [None, "", " ", *texts(random.Random(1), 300)]
    counts, lists = resampling.bucket_lists(some, 10_000)
    for text, n, found in zip(some, counts, lists):
        words, wanted = plain_features(text)
        assert n == words and sorted(found.tolist()) == sorted(wanted)


def test_moved_crcs_compose():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 127, 4096, 100_003):
        a, b = rng.randbytes(20), rng.randbytes(n)
        state = resampling.moved(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]
        assert int(state) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_draw_equals_plain_python(spark):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 400))) + [(7, "the a1 é z " * 9), (7, "the a1 é z " * 9), (None, "z " * 30), (3, None)]
    target = texts(rng, 30) + [None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.resample(df, items).collect()]
    assert sorted(got, key=repr) == sorted(plain_draw(rows, target), key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(df, df).count() == 0
    one = spark.createDataFrame([(1, "a b", 0, "")], SCHEMA)
    assert resampling.resample(one, df).collect()[0].n_features == 3
