"""L1-L9: lexicon features."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postlab.functions import text as T
from postlab.functions import tokens as K
from postlab.operators import lexicon as L
from postlab.operators.features import NO_LIMIT
from postlab.plans import checksql as S
from postlab.plans import views
from postlab.plans.registry import query
from postlab.session import cached

CHOSEN = ("c0", "c1")
CHOSEN_SQL = "l.level = 'conservative' AND l.category IN ('c0', 'c1')"
POSITIVE = "inclusive"


def _terms(spark, sf, filtered=True):
    return L.select_lexicon(
        views.lexicon(spark, sf), categories=CHOSEN, filtered=filtered)


def _hits(words: str, condition: str = "true") -> str:
    """Per post: number of hits and of words, zero-hit posts included."""
    return (f"SELECT id, (SELECT count(*) FROM (SELECT unnest(w) AS term) t JOIN v_lexicon l "
            f"ON t.term = l.term WHERE {condition}) AS n_hits, cast(len(w) AS bigint) AS n_words "
            f"FROM (SELECT id, {words} AS w FROM v_posts) p")


def _flag(words: str, condition: str = "true") -> str:
    return S.with_views(
        f"SELECT id, cast(n_hits > 0 AS bigint) AS flag FROM ({_hits(words, condition)}) h",
        S.POSTS, S.LEXICON)


def _count(words: str, condition: str = "true") -> str:
    return S.with_views(
        f"SELECT id, n_hits, n_words - n_hits AS n_rest FROM ({_hits(words, condition)}) h",
        S.POSTS, S.LEXICON)


PLAIN = S.words("lower(text)")
# Cleaned with everything on, tokenised, noise dropped, joined with single spaces.
FULL = S.words(
    "lower(array_to_string("
    + S.no_noise(S.slang_replaced(S.tokens(f"rtrim({S.preset_full('text')})"))) + ", ' '))")
LIGHT = S.words(S.preset_light("text"))


def _full_text(c):
    cleaned = T.clean_text(c, T.LEXICON_FULL)
    return K.join_tokens(K.tokenize_for_lexicon(cleaned, views.SLANG))


def _light_text(c):
    return T.clean_text(c, T.LEXICON_LIGHT)


def _flagged(spark, sf, terms, prepare=lambda c: c):
    prepared = views.posts(spark, sf).select("id", prepare(F.col("text")).alias("text"))
    return L.lexicon_hits(prepared, terms).select(
        "id", L.lexicon_flag(F.col("hits")).cast("bigint").alias("flag"))


def _counted(spark, sf, terms, prepare=lambda c: c, limit=L.TABLE_BYTES):
    prepared = views.posts(spark, sf).select("id", prepare(F.col("text")).alias("text"))
    counted = prepared.withColumn("n_words", K.word_count(F.col("text")).cast("bigint"))
    return L.lexicon_hits(counted, terms, limit=limit).select(
        "id", F.size("hits").cast("bigint").alias("n_hits"),
        (F.col("n_words") - F.size("hits")).alias("n_rest"))


@query(S.with_views(f"SELECT DISTINCT term FROM v_lexicon l WHERE {CHOSEN_SQL}", S.LEXICON))
def l1_select_lexicon(spark, sf):
    return _terms(spark, sf)


@query(_flag(PLAIN, CHOSEN_SQL))
def l2_has_category_term(spark, sf):
    return _flagged(spark, sf, _terms(spark, sf))


@query(_flag(PLAIN, "l.level = 'inclusive'"))
def l2_has_polar_term(spark, sf):
    polar = views.lexicon(spark, sf).filter(F.col("level") == POSITIVE)
    return _flagged(spark, sf, polar)


@query(_flag(PLAIN, "l.category IN ('c0', 'c2')"))
def l2_has_vocabulary_term(spark, sf):
    """Two vocabularies united, as for word lists kept per language."""
    lexicon = views.lexicon(spark, sf)
    both = lexicon.filter(F.col("category") == "c0").union(
        lexicon.filter(F.col("category") == "c2"))
    return _flagged(spark, sf, both)


@query(_flag(FULL))
def l2_has_topic_term_full(spark, sf):
    return _flagged(spark, sf, views.lexicon(spark, sf), _full_text)


@query(_flag(LIGHT))
def l2_has_topic_term_light(spark, sf):
    return _flagged(spark, sf, views.lexicon(spark, sf), _light_text)


@query(_count(PLAIN, CHOSEN_SQL))
def l3_count_category_terms(spark, sf):
    return _counted(spark, sf, _terms(spark, sf))


@query(_count(PLAIN))
def l3_count_all_terms(spark, sf):
    """The unfiltered lexicon."""
    return _counted(spark, sf, _terms(spark, sf, filtered=False))


@query(_count(FULL))
def l3_count_topic_terms_full(spark, sf):
    return _counted(spark, sf, views.lexicon(spark, sf), _full_text)


@query(_count(LIGHT))
def l3_count_topic_terms_light(spark, sf):
    return _counted(spark, sf, views.lexicon(spark, sf), _light_text)


@query(_count(PLAIN))
def l3_count_terms_join(spark, sf):
    """The same counts by the join route, forced."""
    return _counted(spark, sf, views.lexicon(spark, sf), limit=0)


# Every word of four letters and more: thousands of terms, beyond what travels in a plan.
LARGE = S.with_views(
    f"SELECT id, count(t.term) AS n_hits FROM (SELECT p.id, l.term FROM v_posts p LEFT JOIN "
    f"(SELECT id, unnest({PLAIN}) AS term FROM v_posts) w ON p.id = w.id LEFT JOIN lex_df l "
    "ON w.term = l.term) t GROUP BY id", S.POSTS, S.LEXICON)


@query(LARGE)
def l3_count_large_lexicon(spark, sf):
    matched = L.lexicon_hits(
        views.posts(spark, sf).select("id", "text"), views.whole_lexicon(spark, sf))
    return matched.select("id", F.size("hits").cast("bigint").alias("n_hits"))


@query(LARGE.replace("count(t.term) AS n_hits", "cast(count(t.term) > 0 AS bigint) AS flag"))
def l2_has_large_lexicon_term(spark, sf):
    return _flagged(spark, sf, views.whole_lexicon(spark, sf))


PHRASE_HITS = f"""
post_cut AS (SELECT id, regexp_extract_all(lower(text), '{S.WORD}|[^\\p{{L}}\\p{{N}}_]+') AS p FROM v_posts),
spots AS (SELECT id, i, p[i-1] || ' ' || p[i+1] AS term FROM
  (SELECT id, p, unnest(generate_series(2, len(p) - 1)) AS i FROM post_cut) s WHERE p[i] = ' '),
found AS (SELECT id, i, spots.term, i // 2 AS word FROM spots JOIN v_phrases USING (term)),
runs AS (SELECT *, word - row_number() OVER (PARTITION BY id ORDER BY word) AS run FROM found),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY word) AS k FROM runs) r
  WHERE k % 2 = 1)"""
PHRASE_COUNT = S.with_views(
    "SELECT p.id, count(k.term) AS n_hits FROM v_posts p LEFT JOIN kept k ON p.id = k.id GROUP BY p.id",
    S.POSTS, S.PHRASE_VIEW, PHRASE_HITS)


@query(PHRASE_COUNT)
def l3_count_phrases(spark, sf):
    matched = L.lexicon_hits(
        views.posts(spark, sf).select("id", "text"), views.phrases(spark, sf))
    return matched.select("id", F.size("hits").cast("bigint").alias("n_hits"))


@query(PHRASE_COUNT)
def l3_count_phrases_join(spark, sf):
    matched = L.lexicon_hits(
        views.posts(spark, sf).select("id", "text"), views.phrases(spark, sf), limit=0)
    return matched.select("id", F.size("hits").cast("bigint").alias("n_hits"))


PAIRS = (f"SELECT DISTINCT t.id, t.term FROM (SELECT id, unnest({PLAIN}) AS term FROM v_posts) t "
         "JOIN v_lexicon l ON t.term = l.term")


def _matched(spark, sf):
    return L.lexicon_hits(
        views.posts(spark, sf).select("id", "text"), views.lexicon(spark, sf)).drop("text")


@query(S.with_views(f"SELECT id, term, cast(1 AS bigint) AS weight FROM ({PAIRS}) x",
                    S.POSTS, S.LEXICON))
def l4_lexicon_vector(spark, sf):
    return L.lexicon_vector(_matched(spark, sf)).withColumn("weight", F.lit(1).cast("bigint"))


@query(S.with_views(
    f"SELECT id, term, round((SELECT count(*) FROM v_posts) / count(*) OVER (PARTITION BY term), 6) "
    f"AS weight FROM ({PAIRS}) x", S.POSTS, S.LEXICON))
def l5_weighted_lexicon_vector(spark, sf):
    return (L.weighted_lexicon_vector(_matched(spark, sf))
            .withColumn("weight", F.round("weight", 6)))


@query()
def l6_reduce_vector(spark, sf):
    matched = _matched(spark, sf)
    terms = L.term_list(views.lexicon(spark, sf))
    vectors = L.vectorise_hits(matched, terms).select("id", "lexicon")
    reduced = L.reduce_vector(vectors, 5)
    parts = vector_to_array("reduced")
    return reduced.select("id", *[F.round(parts[i], 6).alias(f"pc{i + 1}") for i in range(5)])


@query(S.with_views(
    f"SELECT term, round(count(*) / (SELECT count(*) FROM v_posts), 6) AS value FROM ("
    f"SELECT DISTINCT id, unnest({PLAIN}) AS term FROM v_posts) x GROUP BY term", S.POSTS))
def l7_token_document_frequency(spark, sf):
    posts = views.posts(spark, sf).select(K.words(F.lower("text")).alias("tokens"))
    return L.token_document_frequency(posts).withColumn("value", F.round("value", 6))


LANGUAGE_WEIGHTS = (f"SELECT language AS topic, term, count(*) AS weight FROM (SELECT DISTINCT id, "
                    f"language, unnest({PLAIN}) AS term FROM v_posts) x GROUP BY language, term")


def _weights(spark, sf):
    return (views.posts(spark, sf)
            .select(F.col("language").alias("topic"),
                    F.explode(F.array_distinct(K.words(F.lower("text")))).alias("term"))
            .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("weight")))


@query(S.with_views(
    "SELECT topic, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic "
    f"ORDER BY weight DESC, term) AS rank FROM ({LANGUAGE_WEIGHTS}) w) r WHERE rank <= 100", S.POSTS))
def l8_top_words(spark, sf):
    return L.top_words(_weights(spark, sf), 100).withColumn("rank", F.col("rank").cast("bigint"))


@query(S.with_views(
    "SELECT DISTINCT term FROM (SELECT *, row_number() OVER (PARTITION BY topic "
    f"ORDER BY weight DESC, term) AS rank FROM ({LANGUAGE_WEIGHTS}) w) r "
    "WHERE rank <= 150 AND topic IN ('es', 'fr')", S.POSTS))
def l8_topic_lexicon(spark, sf):
    return L.topic_lexicon(_weights(spark, sf), 150, ["es", "fr"])


@query()
def l8_topic_top_words(spark, sf):
    """Top words of a topic model fitted on the posts."""
    posts = views.posts(spark, sf).select(
        K.tokenize(T.clean_text(F.col("text"), T.TRAIN)).alias("tokens"))
    with cached(posts):
        counts = CountVectorizer(inputCol="tokens", outputCol="features", minDF=0.01, vocabSize=NO_LIMIT).fit(posts)
        model = LDA(k=10, seed=123).fit(counts.transform(posts))
    weights = L.topic_weights(model, counts.vocabulary, 50)
    return L.top_words(weights, 10).withColumn("weight", F.round("weight", 6))


CLASS_COUNTS = (f"SELECT term, count(*) FILTER (language = 'es') AS df, "
                f"count(*) FILTER (language <> 'es') AS df_other FROM (SELECT DISTINCT id, language, "
                f"unnest({PLAIN}) AS term FROM v_posts) x GROUP BY term")


def _class_tokens(spark, sf):
    return views.posts(spark, sf).select("language", K.words(F.lower("text")).alias("tokens"))


@query(S.with_views(
    f"SELECT term, df FROM ({CLASS_COUNTS}) c WHERE df > 0 ORDER BY df DESC, term LIMIT 250", S.POSTS))
def l9_class_lexicon(spark, sf):
    return L.class_lexicon(_class_tokens(spark, sf), "language", "es", 250, disjoint=False)


@query(S.with_views(
    f"SELECT term, df FROM ({CLASS_COUNTS}) c WHERE df > 0 AND df_other = 0 "
    "ORDER BY df DESC, term LIMIT 100", S.POSTS))
def l9_class_lexicon_disjoint(spark, sf):
    return L.class_lexicon(_class_tokens(spark, sf), "language", "es", 100)
