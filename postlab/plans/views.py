"""Post, lexicon, logit and metric-log tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.functions.binding import let
from postlab.functions.matching import pieces
from postlab.functions.tokens import words
from postlab.session import join_sized, spread

# Marks the documents do not have but the cleaning rules are about.
TAIL = " ñ@cd x@bar @@ab #NiUna @foo_bar 😀😀 ❤"
LEXICON_SIZE = 200
CASE = "CASE1"
SLANG = {"the": "teh", "que": "q", "der": "d", "les": "l"}
TASK1 = {"non-toxic": 0, "toxic": 1}
TASK2 = {"non-toxic": 0, "kind1": 1, "kind2": 2, "kind3": 3, "kind4": 4, "kind5": 5}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "toxic", F.lit(True).alias("labelled"))
    # Labels of a checked size are broadcast, so that no text is shuffled for them.
    d = join_sized(documents(spark, sf), labels, "doc_id", "left").alias("d")
    digits = F.col("d.doc_id").cast("string")
    toxic = F.col("d.toxic")
    return d.select(
        F.lit(CASE).alias("test_case"),
        F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")).alias("id"),
        F.col("d.source").alias("source"),
        F.col("d.lang").alias("language"),
        F.concat(
            F.lit("@"), "d.source", F.lit(" "), "d.text", F.lit("\n#Topic"),
            (F.col("d.doc_id") % 10).cast("string"), F.lit(" https://ex.org/"), digits,
            F.lit("?q=1#frag ¿"), "d.lang", F.lit("?? ¡Ya!!! sooooo" + TAIL)).alias("text"),
        F.when(toxic == 1, "toxic").when(toxic == 0, "non-toxic").alias("task1"),
        F.when(toxic == 1, F.concat(F.lit("kind"), (F.col("d.n_chars") % 5 + 1).cast("string")))
        .when(toxic == 0, "non-toxic").alias("task2"),
        F.when(F.col("d.labelled").isNull(), "test").otherwise("train").alias("split"))


def aux_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("status_id"),
        F.when(F.col("doc_id") % 7 == 0, "doubtful").when(F.col("quality") == 1, "neg")
        .otherwise("pos").alias("categoria"))


def aux_features(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return documents(spark, sf).select(
        d.cast("string").alias("status_id"), "text",
        (F.col("n_chars") % 100).alias("favorite_count"),
        (F.col("n_chars") % 1000).alias("followers_count"),
        F.when(d % 3 == 0, "photo").when(d % 3 == 1, "video").alias("media_type"),
        (d % 2 == 0).alias("verified"),
        F.when(d % 4 == 0, (d + 1).cast("string")).alias("reply_to_status_id"))


def _frequent(terms: DataFrame, size: int) -> DataFrame:
    """``(term, rk)``: the terms most documents contain, ranked after the cut."""
    top = (terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
           .orderBy(F.desc("df"), "term").limit(size))
    return top.select(
        "term", F.row_number().over(Window.orderBy(F.desc("df"), "term")).alias("rk"))


def whole_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of four letters and more, a lexicon that grows with the corpus."""
    return documents(spark, sf).select(
        F.explode(F.array_distinct(words(F.lower("text")))).alias("term")).filter(
            F.char_length("term") >= 4).distinct()


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    terms = documents(spark, sf).select(
        F.explode(F.array_distinct(words(F.lower("text")))).alias("term"))
    ranked = _frequent(terms.filter(F.char_length("term") >= 4), LEXICON_SIZE)
    code = F.col("rk") % 8
    return ranked.select(
        "term",
        F.when(code == 0, "c0").when(code == 1, "c1").when(code == 2, "c2")
        .otherwise("c3").alias("category"),
        F.when(F.col("rk") % 3 == 0, "conservative").otherwise("inclusive").alias("level"))


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of words with one space between them, a phrase lexicon that grows with the corpus."""
    def pairs(parts):
        return F.filter(
            F.transform(parts, lambda p, i: F.when(
                (p == " ") & (i > 0),
                F.concat(F.get(parts, i - 1), p, F.get(parts, i + 1)))),
            lambda x: x.isNotNull())

    return documents(spark, sf).select(
        F.explode(F.array_distinct(let(pieces(F.col("text")), pairs))).alias("term")).distinct()


def slang(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SLANG.items()), "term string, replacement string")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("id"), F.slice(e, 11, 2).alias("logits1"), F.slice(e, 1, 6).alias("logits2"),
        F.when(F.col("label") % 6 == 0, 0).otherwise(1).alias("gold1"),
        F.when(v % 7 == 0, -1).otherwise(F.col("label") % 6).alias("gold2"),
        F.floor(v / 16).alias("batch_id"))


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (table(spark, sf, "events")
            .withColumn("epoch", F.row_number().over(order)).filter(F.col("epoch") <= 20)
            .select(F.col("user_id").alias("run_id"), "epoch", F.col("value").alias("loss"),
                    (F.col("value") / (1 + F.abs("value"))).alias("macro_f1")))
