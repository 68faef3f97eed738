"""F1-F8: term weights, imputing, scaling, encoding, feature assembly."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.functions import text as T
from postlab.functions import tokens as K
from postlab.operators import features as X
from postlab.operators import lexicon as L
from postlab.operators.tables import presence_flags
from postlab.plans import checksql as S
from postlab.plans import views
from postlab.plans.registry import query
from postlab.session import settle

TOKENS = S.tokens("lower(text)")


def _tokens(spark, sf, *keep):
    """Posts as the vectoriser sees them: lower-cased before they are tokenised."""
    return views.posts(spark, sf).select(
        "id", *keep, K.tokenize(F.lower("text")).alias("tokens"))


COUNTED = f"""tf AS (SELECT id, term, count(*) AS tf FROM
  (SELECT id, unnest({TOKENS}) AS term FROM v_posts) t GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
  HAVING 100 * count(*) >= (SELECT count(*) FROM v_posts))"""


@query(S.with_views(
    "SELECT id, term, tf, df, round(tf * (ln((1 + (SELECT count(*) FROM v_posts)) / (1 + df)) + 1), 6) "
    "AS tfidf FROM tf JOIN df USING (term)", S.POSTS, COUNTED))
def f1_tfidf(spark, sf):
    return X.tfidf(_tokens(spark, sf)).withColumn("tfidf", F.round("tfidf", 6))


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


@query(S.with_views(
    "SELECT p.id, round(coalesce(sum(tf * (ln((1 + (SELECT count(*) FROM v_posts)) / (1 + df)) + 1)), 0), 4) "
    "AS total_weight FROM v_posts p LEFT JOIN (SELECT * FROM tf JOIN df USING (term)) w ON p.id = w.id "
    "GROUP BY p.id", S.POSTS, COUNTED))
def f1_tfidf_vector(spark, sf):
    """The vector form; per post the sum of its weights, comparable with the long form."""
    # Texts are cut once, for this file; the fit and the scores read the tokens.
    posts = settle(_tokens(spark, sf))
    weighed = X.fit_tfidf(posts, keep=False).transform(posts)
    return weighed.select("id", F.round(_sum(F.unwrap_udt("features")["values"]), 4).alias("total_weight"))


@query(S.with_views("SELECT id, term, tf, df FROM tf JOIN df USING (term)", S.POSTS, COUNTED))
def f2_bag_of_words(spark, sf):
    return X.bag_of_words(_tokens(spark, sf))


@query()
def f3_svd_scores(spark, sf):
    scores = X.svd_scores(_tokens(spark, sf), 10)
    return scores.select("id", *[F.round(F.col("scores")[i], 4).alias(f"s{i}") for i in range(10)])


@query(S.with_views(
    "SELECT f.status_id, coalesce(f.media_type, 'NA') AS media_type, coalesce(l.categoria, 'NA') AS categoria, "
    "coalesce(CASE WHEN l.status_id IS NOT NULL THEN f.favorite_count END, 0) AS labelled_count "
    "FROM v_aux_features f LEFT JOIN v_aux_labels l ON f.status_id = l.status_id",
    S.AUX_FEATURES, S.AUX_LABELS))
def f4_impute_constant(spark, sf):
    joined = views.aux_features(spark, sf).join(views.aux_labels(spark, sf), "status_id", "left")
    return X.impute_constant(joined.select(
        "status_id", "media_type", "categoria",
        F.when(F.col("categoria").isNotNull(), F.col("favorite_count")).alias("labelled_count")))


@query(S.with_views(
    "SELECT status_id, round((favorite_count - avg(favorite_count) OVER ()) / "
    "stddev_pop(favorite_count) OVER (), 6) AS favorite_count, "
    "round((followers_count - avg(followers_count) OVER ()) / stddev_pop(followers_count) OVER (), 6) "
    "AS followers_count FROM v_aux_features", S.AUX_FEATURES))
def f5_standard_scale(spark, sf):
    counts = ["favorite_count", "followers_count"]
    scaled = X.standard_scale(views.aux_features(spark, sf).select("status_id", *counts), counts)
    return scaled.withColumns({c: F.round(c, 6) for c in counts})


@query(S.with_views(
    "SELECT id, 'source' AS feature, source AS value, cast(1 AS bigint) AS weight FROM v_posts WHERE split <> 'train' "
    "AND source IN (SELECT source FROM v_posts WHERE split = 'train') "
    "UNION ALL SELECT id, 'language', language, cast(1 AS bigint) FROM v_posts WHERE split <> 'train' "
    "AND language IN (SELECT language FROM v_posts WHERE split = 'train')", S.POSTS))
def f6_one_hot(spark, sf):
    """Values learned from the training split, applied to the other splits."""
    posts = views.posts(spark, sf).select("id", "source", "language", "split")
    training = F.col("split") == "train"
    hot = X.one_hot(posts.filter(training), posts.filter(~training), ["source", "language"])
    return hot.withColumn("weight", F.col("weight").cast("bigint"))


WIDE_TOKENS = S.tokens("lower(text)")


@query(S.with_views(f"""SELECT a.status_id, round(coalesce(t.w, 0) + coalesce(h.n, 0) + a.fav + a.fol + 2, 4) AS total,
  (SELECT count(*) FROM df) + (SELECT count(*) FROM v_lexicon) + 2
  + (SELECT count(DISTINCT coalesce(media_type, 'NA')) FROM v_aux_features)
  + (SELECT count(DISTINCT reply_to_status_id IS NULL) FROM v_aux_features) AS width
FROM scaled a LEFT JOIN hits h USING (status_id) LEFT JOIN weights t USING (status_id)""",
                    S.AUX_FEATURES, S.LEXICON, f"""
tf AS (SELECT status_id, term, count(*) AS tf FROM
  (SELECT status_id, unnest({WIDE_TOKENS}) AS term FROM v_aux_features) t GROUP BY status_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
  HAVING 100 * count(*) >= (SELECT count(*) FROM v_aux_features)),
weights AS (SELECT status_id, sum(tf * (ln((1 + (SELECT count(*) FROM v_aux_features)) / (1 + df)) + 1)) AS w
  FROM tf JOIN df USING (term) GROUP BY status_id),
hits AS (SELECT status_id, count(DISTINCT t.term) AS n FROM (SELECT status_id, unnest({S.words('lower(text)')}) AS term
  FROM v_aux_features) t JOIN v_lexicon l ON t.term = l.term GROUP BY status_id),
scaled AS (SELECT status_id,
  (favorite_count - avg(favorite_count) OVER ()) / stddev_pop(favorite_count) OVER () AS fav,
  (followers_count - avg(followers_count) OVER ()) / stddev_pop(followers_count) OVER () AS fol FROM v_aux_features)"""))
def f7_feature_union(spark, sf):
    """Text, lexicon, number and category features in one vector."""
    posts = views.aux_features(spark, sf)
    flagged = presence_flags(posts, {"reply": "reply_to_status_id"})
    plain = X.impute_constant(flagged.select(
        "status_id", "text", "media_type", "reply", "favorite_count", "followers_count"))
    scaled = X.standard_scale(plain, ["favorite_count", "followers_count"])
    lexicon = views.lexicon(spark, sf)
    matched = L.lexicon_hits(scaled, lexicon, key="status_id")
    # Matched and cut once, for this file; the fits and the vectors read it.
    ready = settle(L.vectorise_hits(matched, L.term_list(lexicon)).withColumn(
        "tokens", K.tokenize(F.lower("text"))).drop("text", "hits"))
    text = X.fit_tfidf(ready, output="tfidf", keep=False).transform(ready)
    union = X.feature_union(
        numbers=["favorite_count", "followers_count"], categories=["media_type", "reply"],
        vectors=["tfidf", "lexicon"])
    joined = union.fit(text).transform(text)
    # Of a sparse vector the values that are not zero.
    vector = F.unwrap_udt("features")
    return joined.select(
        "status_id", F.coalesce(vector["size"], F.size(vector["values"])).cast("bigint").alias("width"),
        F.round(_sum(vector["values"]), 4).alias("total"))


LIST = "SELECT id, {0} AS tokens FROM v_posts".format(TOKENS)


@query(S.with_views("""SELECT p.id,
  array_to_string(list_concat([2], coalesce(b.body, []), [3], list_transform(generate_series(1, 126 - len(coalesce(b.body, []))), lambda x: 0)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(generate_series(1, 2 + len(coalesce(b.body, []))), lambda x: 1), list_transform(generate_series(1, 126 - len(coalesce(b.body, []))), lambda x: 0)), ',') AS attention_mask
FROM toks p LEFT JOIN body b ON p.id = b.id""", S.POSTS, f"""toks AS ({LIST}),
vocab AS (SELECT term, 3 + row_number() OVER (ORDER BY n DESC, term) AS term_id FROM
  (SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM toks) t GROUP BY term) v),
head AS (SELECT id, unnest(tokens[1:126]) AS term, unnest(generate_series(1, least(126, len(tokens)))) AS pos FROM toks),
body AS (SELECT id, list(coalesce(term_id, 1) ORDER BY pos) AS body FROM head LEFT JOIN vocab USING (term) GROUP BY id)"""))
def f8_encode_sequence(spark, sf):
    # Cut once, for this file; the vocabulary and the sequences read it.
    posts = settle(_tokens(spark, sf))
    encoded = X.encode_sequence(posts, X.build_vocabulary(posts))
    return encoded.select("id", *[
        F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
        for c in ("input_ids", "attention_mask")])


CLEANED = S.tokens(f"lower({S.preset_train('text')})")


@query(S.with_views("""SELECT language, term, weight, rank FROM (
SELECT *, row_number() OVER (PARTITION BY language ORDER BY weight DESC, term) AS rank FROM (
  SELECT language, term, round(sum(tf * (ln((1 + (SELECT count(*) FROM v_posts)) / (1 + df)) + 1)), 4) AS weight
  FROM tf JOIN df USING (term) JOIN v_posts USING (id) GROUP BY language, term) w) r WHERE rank <= 20""",
                    S.POSTS, COUNTED.replace(TOKENS, CLEANED)))
def f1_top_terms_per_language(spark, sf):
    """Cleaned posts, TF-IDF, the heaviest terms of every language."""
    posts = views.posts(spark, sf).select(
        "id", "language",
        K.tokenize(F.lower(T.clean_text(F.col("text"), T.TRAIN))).alias("tokens"))
    weights = (X.tfidf(posts, keep=("language",)).groupBy("language", "term")
               .agg(F.round(F.sum("tfidf"), 4).alias("weight")))
    best = Window.partitionBy("language").orderBy(F.desc("weight"), "term")
    return (weights.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= 20)
            .select("language", "term", "weight", F.col("rank").cast("bigint").alias("rank")))


top_terms_per_language = f1_top_terms_per_language
