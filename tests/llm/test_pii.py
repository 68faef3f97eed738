import random
import re

import numpy as np

from postlab.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ALPHABET = ["a", "b.", "@", "1", "2", "99", "4", ".", ".com", "-", " ", "+1", "(", "555", "x@y.z", "%", "_",
            "4111111111111111", "1.2.3.4", "300", "é", "😀"]


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def test_strict_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 25)))
        assert pii.strict_spans(text) == plain(text)
        for (a, kind, b), pattern in pii.candidates(text):
            assert a < b <= len(text) and len(pattern) == pii.LABELERS + 2


def test_long_runs_end(spark):
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        pii.candidates(text)


def test_ip_parts_of_any_length(spark):
    texts = ["at 1.2.3." + "0" * 5000 + " now", "0" * 5000 + "9.1.1.1", "1.2.3." + "9" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = [[(s.start, s.end) for s in r.spans if s.kind == "ip"]
             for r in pii.detect(df, pii.fit(df)).orderBy("doc_id").collect()]
    assert found == [[(3, 5009)], [(0, 5007)], []]


def test_labeler_reliabilities_are_recovered():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.9, 0.85, 0.8, 0.7, 0.6, 0.95])
    votes = np.where(rng.random((20_000, 6)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns = np.column_stack([np.full(20_000, 4), votes, np.full(20_000, 3)])
    table, posterior = pii.expectation_maximisation(patterns, np.ones(20_000))
    assert np.abs(table[1, :, 2] - right).max() < 0.03
    assert ((posterior > 0.5) == truth).mean() > 0.95


def test_frames(spark):
    texts = ["mail a.b@c.com or call +1 (744) 555-1421 now", None, "", "nothing here", "order 123456789",
             "card 4111 1111 1111 1111, ip 10.0.0.1", "mail a.b@c.com or call +1 (744) 555-1421 now"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    model = pii.fit(df)
    rows = pii.detect(df, model).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        strict = [(s.start, s.kind, s.end) for s in r.spans if s.kind in pii.KINDS[:pii.STRICT]]
        assert strict == [(a, pii.KINDS[k], b) for a, k, b in plain(t or "")]
    hidden = [r.text for r in pii.redact(df, model).orderBy("doc_id").collect()]
    assert hidden[0] == "mail <EMAIL> or call <PHONE> now" and hidden[1] is None and hidden[2] == ""
    assert hidden[5].startswith("card <CARD>, ip <IP>")
    nothing = pii.fit(df.limit(0))
    assert pii.detect(df.limit(0), nothing).count() == 0
    assert pii.accepted("order 123456789", nothing) == []
