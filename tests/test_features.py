import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postlab import session
from postlab.operators import features as X
from postlab.plans import feature_queries

DOCS = {"1": ["a", "b", "a"], "2": ["b", "c"], "3": [], "4": ["a", "d", "d", "d"], "5": None}


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(list(DOCS.items()), "id string, tokens array<string>")


def expected_weights(min_percent):
    n = len(DOCS)
    df = Counter(t for d in DOCS.values() for t in set(d or []))
    kept = {t: c for t, c in df.items() if c * 100 >= min_percent * n}
    return {
        (i, t): c * (math.log((1 + n) / (1 + kept[t])) + 1)
        for i, d in DOCS.items() for t, c in Counter(d or []).items() if t in kept}


@pytest.mark.parametrize("percent", [0, 1, 40])
def test_tfidf_long_form(posts, percent):
    got = {(r.id, r.term): r.tfidf for r in X.tfidf(posts, min_df_percent=percent).collect()}
    assert got == pytest.approx(expected_weights(percent))


def test_tfidf_edge_of_min_df_is_kept(spark):
    # Exactly 1 of 100 posts: 0.01 * 100 must not decide by a float product.
    df = spark.range(100).select(
        F.col("id").cast("string"),
        F.when(F.col("id") == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("tokens"))
    assert {r.term for r in X.bag_of_words(df).select("term").distinct().collect()} == {"x", "y"}
    more = df.union(spark.range(100, 101).select(
        F.col("id").cast("string"), F.array(F.lit("y")).alias("tokens")))
    assert {r.term for r in X.bag_of_words(more).select("term").distinct().collect()} == {"y"}


def test_vector_form_equals_long_form(posts):
    filled = posts.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    model = X.fit_tfidf(filled, min_df=0.4)
    vocabulary = model.stages[0].vocabulary
    got = {}
    for r in model.transform(filled).select("id", vector_to_array("features").alias("v")).collect():
        got.update({(r.id, t): w for t, w in zip(vocabulary, r.v) if w})
    assert got == pytest.approx(expected_weights(40))


def test_salted_join_gives_the_same_rows(spark, monkeypatch):
    big = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.col("id").cast("string")).alias("term"))
    small = spark.createDataFrame([("hot", 1), ("7", 2), ("zz", 3)], "term string, v int")
    for how in ("inner", "left"):
        one = session.join_sized(big, small, "term", how)
        two = session.join_sized(big, small, "term", how, limit=0)
        assert "BroadcastHashJoin" in one._jdf.queryExecution().toString()
        assert "_salt" in two._jdf.queryExecution().toString()
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_tables_too_large_to_broadcast_are_merged(spark, monkeypatch):
    """Files are small beside their rows, so Spark would send them, and copies of them, by the driver."""
    big = spark.range(300).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string"))
        .alias("term"))
    small = session.settle(spark.createDataFrame(
        [("hot", 1), ("hot", 4), ("7", 2), ("zz", 3), (None, 5)], "term string, v int"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        wanted = sorted(map(tuple, big.join(small, "term", how).collect()), key=str)
        for most, copied in ((10_000, False), (50, True)):
            monkeypatch.setattr(session, "HOT_ROWS", most)
            joined = session.join_sized(big, small, "term", how, limit=0)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and ("Generate" in plan) == ("BroadcastHashJoin" in plan) == copied
            assert joined.columns == big.join(small, "term", how).columns
            assert sorted(map(tuple, joined.collect()), key=str) == wanted


def test_one_exchange_of_tokens(posts):
    """Grouping by post and term adds no exchange after the posts are spread."""
    plan = X.tfidf(posts)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("BroadcastExchange")[0]
    assert main.count("Exchange hashpartitioning") == 1


def test_svd_scores(posts):
    filled = posts.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    ids, terms = sorted(DOCS), ["a", "b", "c", "d"]
    weights = expected_weights(1)
    matrix = np.array([[weights.get((i, t), 0.0) for t in terms] for i in ids])
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    got = {r.id: r.scores for r in X.svd_scores(filled, 2).collect()}
    scores = np.array([got[i] for i in ids])
    assert np.allclose(np.abs(scores), np.abs(u[:, :2] * s[:2]))


def test_impute_scale_encode(spark):
    df = spark.createDataFrame([("1", 1.0, 5.0, None), ("2", 3.0, 5.0, "x")],
                               "id string, n double, k double, c string")
    assert [r.c for r in X.impute_constant(df).orderBy("id").collect()] == ["NA", "x"]
    scaled = X.standard_scale(df, ["n", "k"]).orderBy("id").collect()
    assert [(r.n, r.k) for r in scaled] == [(-1.0, 0.0), (1.0, 0.0)]
    seen = spark.createDataFrame([("9", "x"), ("8", "y")], "id string, c string")
    hot = X.one_hot(seen, df, ["c"]).collect()
    assert [(r.id, r.feature, r.value, r.weight) for r in hot] == [("2", "c", "x", 1)]


def test_vector_one_hot_leaves_unseen_values_at_zero(spark):
    from pyspark.ml import Pipeline

    seen = spark.createDataFrame([("x",), ("y",)], "c string")
    model = Pipeline(stages=X.one_hot_stages(["c"])).fit(seen)
    other = spark.createDataFrame([("y",), ("z",)], "c string")
    rows = {r.c: r.c_hot.toArray().tolist() for r in model.transform(other).collect()}
    assert sorted(rows["y"]) == [0, 1] and rows["z"] == [0, 0]


def test_feature_union_switches(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "n double, c string")
    widths = []
    for kwargs in ({"numbers": ["n"]}, {"categories": ["c"]}, {"numbers": ["n"], "categories": ["c"]}):
        joined = X.feature_union(**kwargs).fit(df).transform(df)
        widths.append(len(joined.first().features))
    assert widths == [1, 2, 3]
    with pytest.raises(ValueError):
        X.feature_union()


def test_encode_sequence(posts):
    vocabulary = X.build_vocabulary(posts, size=3)
    assert {r.term: r.term_id for r in vocabulary.collect()} == {"a": 4, "d": 5, "b": 6}
    rows = {r.id: r for r in X.encode_sequence(posts, vocabulary, max_length=5).collect()}
    assert rows["1"].input_ids == [2, 4, 6, 4, 3]
    assert rows["2"].input_ids == [2, 6, 1, 3, 0]
    assert rows["2"].attention_mask == [1, 1, 1, 1, 0]
    assert rows["3"].input_ids == rows["5"].input_ids == [2, 3, 0, 0, 0]
    assert rows["4"].input_ids == [2, 4, 5, 5, 3]


def test_rows_of_one_id_keep_their_own_sequences_and_scores(spark):
    """Null and repeated ids, null and empty lists; sequences the same by look-up and by join."""
    rows = [(None, ["a", "b"]), (None, ["b"]), ("1", ["c"]), ("1", ["a", "zz", "a"]), ("2", []), ("3", None)]
    df = spark.createDataFrame(rows, "id string, tokens array<string>")
    vocabulary = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "term string, term_id int")
    number = {"a": 4, "b": 5, "c": 6}
    wanted = []
    for i, tokens in rows:
        ids = [X.START, *[number.get(t, X.UNKNOWN) for t in (tokens or [])[:3]], X.END]
        wanted.append((i, ids + [X.PAD] * (5 - len(ids)), [1] * len(ids) + [0] * (5 - len(ids))))
    for limit in (0, X.TABLE_BYTES):
        got = [tuple(r) for r in X.encode_sequence(df, vocabulary, 5, limit=limit).collect()]
        assert sorted(got, key=repr) == sorted(wanted, key=repr)
    full = df.filter("tokens IS NOT NULL")
    scores = X.svd_scores(full, k=1, min_df=0.0).collect()
    assert len(scores) == 5
    by_id = sorted(round(abs(r.scores[0]), 6) for r in scores if r.id is None)
    assert len(by_id) == 2 and by_id[0] != by_id[1]


def test_svd_cleans_its_texts_once(spark):
    rows = [(str(i), ["a", "b"] if i % 2 else ["b", "c", f"w{i}"]) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(tokens):
        seen.add(1)
        return tokens

    df = spark.createDataFrame(rows, "id string, tokens array<string>").withColumn("tokens", cut("tokens"))
    assert len(X.svd_scores(df, 2).collect()) == len(rows)
    assert seen.value == len(rows)


def test_the_fit_counts_no_term_that_cannot_be_kept(spark, monkeypatch):
    """The library's count of the whole vocabulary is used only without a share."""
    rows = [(["a", "b", "b", f"own{i}"] if i % 2 else ["a", f"own{i}"],) for i in range(200)]
    posts = spark.createDataFrame(rows, "tokens array<string>")
    wanted = X.CountVectorizer(inputCol="tokens", outputCol="_tf", minDF=0.01, vocabSize=X.NO_LIMIT).fit(posts)
    idf = X.IDF(inputCol="_tf", outputCol="_idf").fit(wanted.transform(posts)).idf.toArray() + 1

    def never(*args):
        raise AssertionError("all terms counted")

    with monkeypatch.context() as patch:
        patch.setattr(X, "_all_terms", never)
        counts, scale = X.fit_tfidf(posts).stages
    got = dict(zip(counts.vocabulary, scale.getScalingVec().toArray()))
    assert set(got) == {"a", "b"}
    assert got == pytest.approx(dict(zip(wanted.vocabulary, idf)))
    # A number of posts instead of a share.
    assert set(X.fit_tfidf(posts, min_df=101).stages[0].vocabulary) == {"a"}


def test_repeated_and_null_ids_share_counts_of_cut_posts(spark):
    posts = spark.createDataFrame(
        [("1", ["a", "a", "b"]), ("1", ["a"]), (None, ["b"]), (None, ["b", None]), ("2", None)],
        "id string, tokens array<string>")
    got = {(r.id, r.term): (r.tf, r.df) for r in X.bag_of_words(posts).collect()}
    assert got == {("1", "a"): (3, 2), ("1", "b"): (1, 3), (None, "b"): (2, 3)}


def test_encoding_cuts_its_texts_once(spark, sf, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return text.split()

    monkeypatch.setattr(feature_queries.K, "tokenize", cut)
    assert len(feature_queries.f8_encode_sequence(spark, sf).collect()) == seen.value


def test_large_vocabularies_are_not_copied_for_sequences(posts, monkeypatch):
    def copied(*args, **kwargs):
        raise AssertionError("joined with copies")

    vocabulary = X.build_vocabulary(posts)
    monkeypatch.setattr(X, "join_sized", copied)
    rows = {r.id: r.input_ids for r in X.encode_sequence(posts, vocabulary, 5, limit=0).collect()}
    assert rows == {r.id: r.input_ids for r in X.encode_sequence(posts, vocabulary, 5).collect()}
