"""S, P, J, U and B: sources, projections, joins, set operations, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.functions.tokens import words
from postlab.operators import sampling as B
from postlab.operators import tables as P
from postlab.operators.lexicon import match_lexicon
from postlab.plans import checksql as S
from postlab.plans import views
from postlab.plans.registry import query
from postlab.session import workspace
from postlab.sources.lexicons import read_lexicon
from postlab.sources.posts import (
    read_aux_features, read_aux_labels, read_posts, write_delimited)
from postlab.sources.predictions import (
    prediction_path, write_predictions, write_two_heads)

POST_COLUMNS = ["test_case", "id", "source", "language", "text", "task1", "task2"]
POST_LIST = ", ".join(POST_COLUMNS)


def _posts(select: str, where: str = "") -> str:
    return S.with_views(f"SELECT {select} FROM v_posts {where}", S.POSTS)


# Sources and sinks ---------------------------------------------------------

@query(_posts(POST_LIST))
def s1_read_posts(spark, sf):
    path = write_delimited(
        views.posts(spark, sf).select(*POST_COLUMNS), workspace(spark), "\t")
    return read_posts(spark, path)


@query(_posts(POST_LIST))
def s1_read_posts_split(spark, sf):
    """The same files, cut into byte ranges in spite of quoted newlines."""
    path = write_delimited(
        views.posts(spark, sf).select(*POST_COLUMNS), workspace(spark), "\t")
    return read_posts(spark, path, split=True)


AUX_ROWS = S.with_views(
    "SELECT f.status_id, f.text, l.categoria FROM v_aux_features f "
    "JOIN v_aux_labels l ON f.status_id = l.status_id", S.AUX_LABELS, S.AUX_FEATURES)


def _read_aux(spark, sf, split):
    labels = write_delimited(views.aux_labels(spark, sf), workspace(spark), ";")
    features = write_delimited(views.aux_features(spark, sf), workspace(spark), ",")
    return P.join_labels(read_aux_features(spark, features, split=split),
                         read_aux_labels(spark, labels))


@query(AUX_ROWS)
def s2_read_aux(spark, sf):
    return _read_aux(spark, sf, False)


@query(AUX_ROWS)
def s2_read_aux_split(spark, sf):
    return _read_aux(spark, sf, True)


@query(S.with_views(
    "SELECT 'category' AS name, category, level, term, cast(NULL AS varchar) AS replacement FROM v_lexicon "
    "UNION ALL SELECT 'category_plain', category, NULL, term, NULL FROM v_lexicon "
    "UNION ALL SELECT 'polarity', NULL, NULL, term, NULL FROM v_lexicon "
    "UNION ALL SELECT 'terms', NULL, NULL, term, NULL FROM v_lexicon "
    "UNION ALL SELECT 'terms_tab', NULL, NULL, term || ', ' || category, NULL FROM v_lexicon "
    "UNION ALL SELECT 'slang', NULL, NULL, term, category FROM v_lexicon", S.LEXICON))
def s3_read_lexicon(spark, sf):
    """All six layouts, written from one lexicon and read back."""
    source = views.lexicon(spark, sf).persist()
    layouts = {
        "category": (source.select("category", "level", F.col("term").alias("lemma")), "\t", True),
        "category_plain": (source.select("category", "level", "term"), "\t", False),
        "polarity": (source.select(F.col("term").alias("Words")), "\t", True),
        "terms": (source.select("term"), ",", True),
        "terms_tab": (source.select(F.concat_ws(", ", "term", "category").alias("term"), "level"),
                      "\t", True),
        "slang": (source.select("term", "category"), "\t", False),
    }
    read = [
        read_lexicon(spark, write_delimited(df, workspace(spark), sep, header), name, name)
        for name, (df, sep, header) in layouts.items()]
    source.unpersist()
    return P.append_rows(*read)


# A category for every post, from what the scored table has of it.
SCORED = "CASE WHEN n_words % 2 = 0 THEN 'toxic' ELSE 'non-toxic' END"


def _scored(spark, sf):
    even = F.size(words("text")) % 2 == 0
    return views.posts(spark, sf).withColumns({
        "task1": F.when(even, "toxic").otherwise("non-toxic"),
        "task2": F.when(even, "kind1").otherwise("non-toxic")})


@query(S.with_views(
    f"SELECT test_case, id, {SCORED} AS category FROM (SELECT *, len({S.words('text')}) AS n_words "
    "FROM v_posts) p", S.POSTS))
def s4_write_predictions(spark, sf):
    scored = _scored(spark, sf)
    path = prediction_path(workspace(spark) + "/out.tsv", "task1")
    write_predictions(scored.withColumnRenamed("task1", "category"), path)
    return spark.read.schema("test_case string, id string, category string").csv(
        path, sep="\t", header=True)


@query(S.with_views(
    f"SELECT 'task1' AS task, test_case, id, {SCORED} AS category FROM worded UNION ALL "
    f"SELECT 'task2', test_case, id, {SCORED.replace("'toxic'", "'kind1'")} FROM worded",
    S.POSTS, f"worded AS (SELECT *, len({S.words('text')}) AS n_words FROM v_posts)"))
def s4_write_two_heads(spark, sf):
    scored = _scored(spark, sf)
    paths = write_two_heads(scored, workspace(spark) + "/out.tsv", "task1", "task2")
    schema = "test_case string, id string, category string"
    return P.append_rows(*[
        spark.read.schema(schema).csv(p, sep="\t", header=True).withColumn("task", F.lit(t))
        for p, t in zip(paths, ("task1", "task2"))])


# Projections, filters, casts -----------------------------------------------

@query(_posts(POST_LIST, "WHERE language = 'es'"))
def p1_filter_language(spark, sf):
    return P.filter_language(views.posts(spark, sf), "es").select(*POST_COLUMNS)


@query(_posts("id, text"))
def p2_select_columns(spark, sf):
    return P.select_columns(views.posts(spark, sf), ["id", "text"])


@query(S.with_views("SELECT favorite_count, followers_count FROM v_aux_features", S.AUX_FEATURES))
def p3_select_type(spark, sf):
    return P.select_type(views.aux_features(spark, sf), "number")


@query(S.with_views(
    "SELECT status_id, cast(favorite_count AS varchar) AS favorite_count, "
    "cast(followers_count AS double) AS followers_count FROM v_aux_features", S.AUX_FEATURES))
def p4_change_dtypes(spark, sf):
    cast = P.change_dtypes(
        views.aux_features(spark, sf), {"favorite_count": "string", "followers_count": "double"})
    return cast.select("status_id", "favorite_count", "followers_count")


# Codes are compared as text: NULL codes turn integer columns into floats in pandas.
ENCODED = ("CASE task1 WHEN 'non-toxic' THEN '0' WHEN 'toxic' THEN '1' END AS task1, "
           "CASE task2 WHEN 'non-toxic' THEN '0' WHEN 'kind1' THEN '1' WHEN 'kind2' THEN '2' "
           "WHEN 'kind3' THEN '3' WHEN 'kind4' THEN '4' WHEN 'kind5' THEN '5' END AS task2")


@query(_posts(f"id, {ENCODED}"))
def p5_encode_labels(spark, sf):
    coded = P.encode_labels(
        views.posts(spark, sf).select("id", "task1", "task2"), views.TASK1, views.TASK2)
    return P.change_dtypes(coded, {"task1": "string", "task2": "string"})


@query(_posts("id, task2 AS category"))
def p6_decode_labels(spark, sf):
    coded = P.encode_labels(
        views.posts(spark, sf).select("id", "task1", "task2"), views.TASK1, views.TASK2)
    return P.decode_labels(coded, "task2", views.TASK2).select("id", "category")


ALIGNED = ("SELECT 'CASE1' AS test_case, f.status_id AS id, 'twitter' AS source, 'es' AS language, "
           "f.text, CASE l.categoria WHEN 'neg' THEN 'non-toxic' WHEN 'pos' THEN 'toxic' END AS task1, "
           "{task2} AS task2 FROM v_aux_features f JOIN v_aux_labels l ON f.status_id = l.status_id "
           "WHERE l.categoria <> 'doubtful'")
CLASSES = {"neg": "non-toxic", "pos": "toxic"}


def _aux(spark, sf):
    joined = P.join_labels(
        views.aux_features(spark, sf).select("status_id", "text"), views.aux_labels(spark, sf))
    return P.drop_class(joined, "categoria", "doubtful")


@query(S.with_views(ALIGNED.format(task2="-1"), S.AUX_LABELS, S.AUX_FEATURES))
def p7_align_aux_schema(spark, sf):
    return P.align_aux_schema(_aux(spark, sf), views.CASE, CLASSES, encoded=True)


@query(S.with_views(
    "SELECT f.status_id, l.categoria FROM v_aux_features f LEFT JOIN v_aux_labels l "
    "ON f.status_id = l.status_id WHERE l.categoria IS DISTINCT FROM 'doubtful'",
    S.AUX_LABELS, S.AUX_FEATURES))
def p8_drop_class(spark, sf):
    """Rows without a class stay."""
    texts = views.aux_features(spark, sf).select("status_id")
    return P.drop_class(
        texts.join(views.aux_labels(spark, sf), "status_id", "left"), "categoria", "doubtful")


@query(S.with_views(
    "SELECT status_id, CASE WHEN reply_to_status_id IS NULL THEN 'no' ELSE 'si' END AS reply, "
    "CASE WHEN media_type IS NULL THEN 'no' ELSE 'si' END AS media FROM v_aux_features",
    S.AUX_FEATURES))
def p9_presence_flags(spark, sf):
    return P.presence_flags(
        views.aux_features(spark, sf), {"reply": "reply_to_status_id", "media": "media_type"},
    ).select("status_id", "reply", "media")


@query(S.with_views(
    "SELECT status_id, CASE categoria WHEN 'doubtful' THEN 'pos' ELSE categoria END AS categoria "
    "FROM v_aux_labels", S.AUX_LABELS))
def p10_merge_class(spark, sf):
    return P.merge_class(views.aux_labels(spark, sf), "categoria", {"doubtful": "pos"})


@query(_posts(
    "id, language, text, (SELECT count(*) FROM v_posts) AS n_rows, cast(3 AS bigint) AS n_columns",
    "ORDER BY id LIMIT 5"))
def p11_preview(spark, sf):
    return P.preview(views.posts(spark, sf).select("id", "language", "text"))


# Joins ---------------------------------------------------------------------

@query(S.with_views(
    "SELECT f.status_id, f.text, l.categoria FROM v_aux_features f "
    "JOIN v_aux_labels l ON f.status_id = l.status_id", S.AUX_LABELS, S.AUX_FEATURES))
def j1_join_labels(spark, sf):
    return P.join_labels(
        views.aux_features(spark, sf).select("status_id", "text"), views.aux_labels(spark, sf))


@query(S.with_views(
    "SELECT p.test_case, p.id, CASE WHEN len(regexp_extract_all(q.text, '!')) % 2 = 0 "
    "THEN 'non-toxic' ELSE 'toxic' END AS category "
    "FROM v_posts p JOIN v_posts q ON p.id = q.id", S.POSTS))
def j2_attach_predictions(spark, sf):
    """Predictions made elsewhere, carried back by id instead of by position."""
    posts = views.posts(spark, sf)
    marks = F.regexp_count("text", F.lit("!"))
    predicted = posts.select(
        "id", F.when(marks % 2 == 0, "non-toxic").otherwise("toxic").alias("category"))
    return P.attach_predictions(posts.select("test_case", "id"), predicted)


HIT_COUNTS = (
    f"SELECT id, t.term, count(*) AS n_hits FROM (SELECT id, unnest({S.words('lower(text)')}) AS term "
    "FROM v_posts) t JOIN v_lexicon l ON t.term = l.term GROUP BY id, t.term")


@query(S.with_views(HIT_COUNTS, S.POSTS, S.LEXICON))
def j3_match_lexicon(spark, sf):
    """The join route, which takes lexicons of any size."""
    found = match_lexicon(views.posts(spark, sf), views.lexicon(spark, sf))
    return found.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n_hits"))


# Set operations ------------------------------------------------------------

@query(S.with_views(
    f"SELECT {POST_LIST} FROM v_posts WHERE split = 'train' UNION ALL "
    + ALIGNED.format(task2="NULL"), S.POSTS, S.AUX_LABELS, S.AUX_FEATURES))
def u1_append_aux_corpus(spark, sf):
    train = views.posts(spark, sf).filter(F.col("split") == "train").select(*POST_COLUMNS)
    return P.append_rows(train, P.align_aux_schema(_aux(spark, sf), views.CASE, CLASSES))


@query(_posts("id, language, task1", "WHERE language IS NOT NULL"))
def u2_concat_language_results(spark, sf):
    posts = views.posts(spark, sf).select("id", "language", "task1")
    return P.append_rows(*[P.filter_language(posts, x) for x in P.languages(posts)])


@query(S.with_views(
    "SELECT term FROM v_lexicon WHERE category IN ('c0', 'c1') "
    "UNION SELECT term FROM v_lexicon WHERE level = 'conservative'", S.LEXICON))
def u3_union_lexicons(spark, sf):
    lexicon = views.lexicon(spark, sf)
    return P.union_terms(
        lexicon.filter(F.col("category").isin("c0", "c1")),
        lexicon.filter(F.col("level") == "conservative"))


@query(S.with_views(
    f"SELECT DISTINCT t.id, t.term FROM (SELECT id, unnest({S.words('lower(text)')}) AS term "
    "FROM v_posts) t JOIN v_lexicon l ON t.term = l.term WHERE l.category IN ('c0', 'c1')",
    S.POSTS, S.LEXICON))
def u4_intersect_tokens(spark, sf):
    chosen = views.lexicon(spark, sf).filter(F.col("category").isin("c0", "c1"))
    posts = views.posts(spark, sf).select("id", words(F.lower("text")).alias("tokens"))
    return P.intersect_tokens(posts, chosen)


@query(S.with_views(
    f"SELECT DISTINCT t.id, t.term FROM (SELECT id, unnest({S.words('lower(text)')}) AS term "
    "FROM v_posts) t JOIN lex_df l ON t.term = l.term", S.POSTS, S.LEXICON))
def u4_intersect_large_lexicon(spark, sf):
    posts = views.posts(spark, sf).select("id", words(F.lower("text")).alias("tokens"))
    return P.intersect_tokens(posts, views.whole_lexicon(spark, sf))


# Sampling and balancing ----------------------------------------------------

def _hash(seed: int = 123, key: str = "id") -> str:
    return f"md5(concat('{seed}|', {key}))"


@query(S.with_views(
    f"SELECT id, language FROM (SELECT *, row_number() OVER (ORDER BY {_hash()}, id) AS rn, "
    "count(*) OVER () AS n FROM v_posts) x WHERE rn <= round_even(0.01::double * n, 0)", S.POSTS))
def b1_sample_fraction(spark, sf):
    return B.sample_fraction(views.posts(spark, sf)).select("id", "language")


@query(S.with_views(
    f"SELECT id, task1 FROM (SELECT *, row_number() OVER (PARTITION BY task1 ORDER BY {_hash()}, id) AS rn "
    "FROM v_posts WHERE task1 IS NOT NULL) x WHERE task1 <> 'non-toxic' OR rn <= 20", S.POSTS))
def b2_downsample(spark, sf):
    labelled = views.posts(spark, sf).filter(F.col("task1").isNotNull())
    return B.downsample(labelled, "task1", "non-toxic", 20).select("id", "task1")


@query(S.with_views("SELECT categoria, count(*) AS n FROM v_aux_labels GROUP BY categoria",
                    S.AUX_LABELS))
def b3_class_counts(spark, sf):
    return B.class_counts(views.aux_labels(spark, sf), "categoria")


@query(S.with_views(
    f"SELECT id, task1 FROM (SELECT *, row_number() OVER (PARTITION BY task1 ORDER BY {_hash()}, id) AS rn "
    "FROM v_posts WHERE task1 IS NOT NULL) x WHERE task1 = 'toxic' "
    "OR rn <= (SELECT count(*) FROM v_posts WHERE task1 = 'toxic')", S.POSTS))
def b4_balance_to_minority(spark, sf):
    labelled = views.posts(spark, sf).filter(F.col("task1").isNotNull())
    return B.balance_to_minority(labelled, "task1", "non-toxic", "toxic").select("id", "task1")


@query(S.with_views(
    f"SELECT id, row_number() OVER (ORDER BY {_hash()}, id) AS position, "
    f"(row_number() OVER (ORDER BY {_hash()}, id) - 1) // 16 AS batch_id FROM v_posts", S.POSTS))
def b5_shuffle(spark, sf):
    return B.shuffle(views.posts(spark, sf)).select("id", "position", "batch_id")
