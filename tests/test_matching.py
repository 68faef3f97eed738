import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlab.functions import matching as M
from postlab.functions.tokens import word_count
from postlab.operators import lexicon as L


def by_regex(text, terms):
    """Whole-word alternation, longest term first."""
    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    pattern = "|".join(r"\b" + re.escape(t) + r"\b" for t in ordered)
    return re.findall(pattern, text.lower())


@pytest.mark.parametrize("text, terms, expected", [
    ("PUÑO y puño", ["puño"], ["puño", "puño"]),
    ("maña xma ma", ["ma"], ["ma"]),
    ("a b c a b", ["a b", "b c"], ["a b", "a b"]),
    ("a b c", ["b c", "a b c", "a"], ["a b c"]),
    ("a  b a, b a b", ["a b"], ["a b"]),
    ("x-y x y", ["x-y"], ["x-y"]),
    ("", ["a"], []),
    (None, ["a"], []),
    ("!!! ¿?", ["a b"], []),
])
def test_hits(apply, text, terms, expected):
    assert apply(lambda c: M.term_hits(c, terms), [text]) == [expected]


def test_flag_and_count(apply):
    texts = ["a b a", "c", None]
    assert apply(lambda c: M.has_lexicon_term(c, ["a"]), texts) == [1, 0, 0]
    assert apply(lambda c: M.count_lexicon_terms(c, ["a"]), texts) == [2, 0, 0]


def test_terms_must_be_whole_words():
    with pytest.raises(ValueError):
        M.normalise_terms(["!a"])


TEXTS = st.lists(
    st.text(alphabet="ab ñ-.B", max_size=30), min_size=30, max_size=40)
TERMS = st.lists(
    st.from_regex(r"\A[abñ]{1,2}([ -][abñ]{1,2}){0,2}\Z"), min_size=1, max_size=6, unique=True)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS, TERMS)
def test_inline_join_and_regex_agree(spark, texts, terms):
    posts = spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    expected = {str(i): by_regex(t, terms) for i, t in enumerate(texts)}
    inline = L.lexicon_hits(posts, lexicon).collect()
    joined = L.lexicon_hits(posts, lexicon, limit=0).collect()
    assert {r.id: r.hits for r in inline} == expected
    assert {r.id: r.hits for r in joined} == expected


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_count_properties(apply, texts):
    terms = ["a", "b", "ab", "ñ"]
    rows = apply(lambda c: F.struct(
        M.has_lexicon_term(c, terms).alias("flag"), M.count_lexicon_terms(c, terms).alias("n"),
        word_count(c).alias("words")), texts)
    for r in rows:
        assert r.flag == int(r.n > 0)
        assert 0 <= r.n <= r.words


def test_vectors(spark):
    posts = spark.createDataFrame(
        [("1", "a b a"), ("2", "b"), ("3", "z"), ("4", "a")], "id string, text string")
    lexicon = spark.createDataFrame([("a",), ("b",), ("q",)], "term string")
    matched = L.lexicon_hits(posts, lexicon)
    flat = {(r.id, r.term): r.weight for r in L.lexicon_vector(matched).collect()}
    assert flat == {("1", "a"): 1, ("1", "b"): 1, ("2", "b"): 1, ("4", "a"): 1}
    for bound in (3, None):
        weighted = L.weighted_lexicon_vector(matched, lexicon_terms=bound).collect()
        assert {(r.id, r.term): r.weight for r in weighted} == {
            ("1", "a"): 2.0, ("1", "b"): 2.0, ("2", "b"): 2.0, ("4", "a"): 2.0}
        # Column mean is one for every term that occurs.
        for term in ("a", "b"):
            assert sum(r.weight for r in weighted if r.term == term) / 4 == 1
    wide = L.vectorise_hits(matched, ["a", "b", "q"], weights={"a": 2.0, "b": 2.0})
    assert {r.id: r.lexicon.toArray().tolist() for r in wide.collect()} == {
        "1": [2, 2, 0], "2": [0, 2, 0], "3": [0, 0, 0], "4": [2, 0, 0]}
    reduced = L.reduce_vector(wide, 2).select("reduced").collect()
    for i in range(2):
        assert abs(sum(r.reduced[i] for r in reduced)) < 1e-9


def test_select_lexicon(spark):
    rows = [("pa", "conservative", "x"), ("pa", "inclusive", "y"), ("zz", "conservative", "w"),
            ("pr", "conservative", "x")]
    df = spark.createDataFrame(rows, "category string, level string, term string")
    assert [r.term for r in L.select_lexicon(df).collect()] == ["x"]
    assert {r.term for r in L.select_lexicon(df, filtered=False).collect()} == {"x", "y", "w"}


def test_class_lexicon(spark):
    df = spark.createDataFrame(
        [("p", ["a", "b", "a"]), ("p", ["a", "c"]), ("n", ["a", "d"]), (None, ["c"])],
        "label string, tokens array<string>")
    both = L.class_lexicon(df, "label", "p", 10, disjoint=False).collect()
    assert [(r.term, r.df) for r in both] == [("a", 2), ("b", 1), ("c", 1)]
    only = L.class_lexicon(df, "label", "p", 10).collect()
    assert [r.term for r in only] == ["b", "c"]


def test_topic_lexicon(spark):
    df = spark.createDataFrame(
        [(0, "a", 2.0), (0, "b", 1.0), (0, "c", 3.0), (1, "d", 1.0), (2, "c", 9.0)],
        "topic int, term string, weight double")
    top = L.top_words(df, 2).collect()
    assert {(r.topic, r.term, r["rank"]) for r in top} == {
        (0, "c", 1), (0, "a", 2), (1, "d", 1), (2, "c", 1)}
    assert {r.term for r in L.topic_lexicon(df, 1, [0, 2]).collect()} == {"c"}


def test_both_routes_skip_terms_that_can_match_no_word(spark):
    from postlab.operators import lexicon as L

    posts = spark.createDataFrame([(1, "a !a b-c"), (2, None)], "id int, text string")
    terms = spark.createDataFrame([("!a",), ("A",), (None,), ("b-c",), ("",)], "term string")
    for limit in (0, 100):
        hits = {r.id: r.hits for r in L.lexicon_hits(posts, terms, limit=limit).collect()}
        assert hits == {1: ["a", "a", "b-c"], 2: []}


ODD_ROWS = [(None, "a b c a b"), (None, "b c"), ("1", "a b"), ("1", "A B c d"), ("1", "a b"), ("2", None), ("3", "")]


def test_rows_keep_their_own_hits(spark):
    """Null and repeated ids, the same by look-up and by join."""
    posts = spark.createDataFrame(ODD_ROWS, "id string, text string")
    lexicon = spark.createDataFrame([("a b",), ("b c",), ("c",), ("a b c d",), (None,)], "term string")
    expected = sorted((i, t, by_regex(t or "", ["a b", "b c", "c", "a b c d"])) for i, t in [
        (i or "", t or "") for i, t in ODD_ROWS])
    for limit in (0, L.TABLE_BYTES):
        rows = L.lexicon_hits(posts, lexicon, limit=limit).collect()
        assert sorted((r.id or "", r.text or "", r.hits) for r in rows) == expected


def test_every_place_by_both_routes(spark):
    posts = spark.createDataFrame(ODD_ROWS, "id string, text string")
    lexicon = spark.createDataFrame([("a b",), ("b c",), ("b",), ("a b c d",)], "term string")
    found = [sorted(map(repr, L.match_lexicon(posts, lexicon, limit=limit).collect())) for limit in (0, L.TABLE_BYTES)]
    assert found[0] == found[1]
    texts = [t.lower() for _, t in ODD_ROWS if t]
    wanted = sum(len(re.findall(rf"(?=\b{t}\b)", x)) for x in texts for t in ("a b", "b c", "b", "a b c d"))
    assert len(found[0]) == wanted


def test_look_up_needs_no_shuffle_of_texts(spark):
    posts = spark.createDataFrame(ODD_ROWS, "id string, text string")
    lexicon = spark.createDataFrame([("a b",), ("c",)], "term string")
    plan = L.lexicon_hits(posts, lexicon)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Join" not in plan and "Exchange" not in plan
    joined = L.lexicon_hits(posts, lexicon, limit=0).select("id", "hits")
    scans = [x for x in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x]
    assert scans and not any("text:" in x for x in scans)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 9)), max_size=200))
def test_overlaps_are_dropped_across_blocks(spark, spans):
    spans = sorted(set(spans))
    free, kept = 0, []
    for start, length in spans:
        if start >= free:
            free, _ = start + length, kept.append(f"{start}+{length}")
    df = spark.createDataFrame([([(s, n, f"{s}+{n}") for s, n in spans],)], "x " + M.PLACE)
    assert df.select(M.without_overlaps(F.col("x")).alias("hits")).first().hits == kept


def test_chunks_find_what_the_look_up_finds(spark, monkeypatch):
    """Terms of up to five words, chunks of a few rows, long words; nothing broadcast but by its size."""
    from postlab.operators import chunks

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 400)
    word = "ä" * 20
    texts = [f"a b c d e {word} x" * (i % 3 + 1) + f" w{i} w{i + 1}, a b" for i in range(60)] + [None, "", "!!"]
    posts = spark.createDataFrame([(str(i % 50), t) for i, t in enumerate(texts)], "id string, text string")
    terms = ["a b c d e", "b c", f"e {word} x", word, "a b c", "w7 w8, a", "d", "nowhere at all"]
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r.id, r.text or "", r.hits) for r in L.lexicon_hits(posts, lexicon, limit=0).collect())
    assert got == sorted((str(i % 50), t or "", by_regex(t or "", terms)) for i, t in enumerate(texts))
    plans = []
    kept = L.settle
    monkeypatch.setattr(L, "settle", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    L.lexicon_hits(posts, lexicon, limit=0)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
