"""Term weights, scaling, encoding and feature assembly."""

from __future__ import annotations

import math
from contextlib import nullcontext

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, OneHotEncoder, StringIndexer,
    VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.binding import let
from postlab.functions.dictionary import TABLE_BYTES, Dictionary, fits
from postlab.functions.tokens import each_token
from postlab.operators.chunks import LIST, mapped
from postlab.operators.heavy import candidates
from postlab.session import cached, join_sized, numbered, settle

# Share of posts a term must occur in, as a percentage: the edge test then stays
# in integers.
MIN_DF_PERCENT = 1

PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_TERM_ID = 4
NO_LIMIT = 2**31 - 1


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery; equal ones are computed once."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def kept_terms(df: DataFrame, total: Column, tokens: str = "tokens",
               min_df_percent: int = MIN_DF_PERCENT) -> DataFrame:
    """``(term, df)`` of terms in at least that percentage of ``total`` posts."""
    return (df.select(F.explode(F.array_distinct(tokens)).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .filter(F.col("df") * 100 >= total * min_df_percent))


def narrowed(df: DataFrame, tokens: str, min_df_percent: int, keep: tuple[str, ...],
             limit: int = TABLE_BYTES) -> DataFrame:
    """The columns ``keep`` and ``_cells``: ``(term, n)`` of terms that may reach the percentage,
    counted row by row and written once.

    Without a percentage, or with more candidates than may travel with the plan, all
    tokens stay, each as a cell.
    """
    kept = df.select(*keep, F.coalesce(tokens, F.array()).alias("_tokens"))
    if min_df_percent > 0:
        likely = settle(candidates(df, tokens, min_df_percent))
        if fits(likely, limit):
            ordered = likely.agg(F.array_sort(F.collect_list("term")).alias("t"))
            if terms := ordered.first().t:
                counts = CountVectorizerModel.from_vocabulary(
                    terms, inputCol="_tokens", outputCol="_tf").transform(kept)
                vector = F.unwrap_udt("_tf")
                cells = let(F.col("_names"), lambda names: F.zip_with(
                    vector["indices"], vector["values"], lambda i, n: F.struct(
                        F.get(names, i).alias("term"), n.cast("bigint").alias("n"))))
                return settle(counts.withColumn("_names", ordered.scalar()).select(*keep, cells.alias("_cells")))
    return settle(kept.select(*keep, F.transform("_tokens", lambda t: F.struct(
        t.alias("term"), F.lit(1).cast("bigint").alias("n"))).alias("_cells")))


def bag_of_words(df: DataFrame, tokens: str = "tokens", key: str = "id",
                 min_df_percent: int = MIN_DF_PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, term, tf, df)`` in long form, plus post columns to ``keep``.

    Bounded summaries of the tasks tell the terms that can be kept; posts are cut to counts of
    those row by row, so neither the shuffle of the counts nor that of the posts depends on
    the vocabulary. The table of kept terms is broadcast if it measures small enough.
    """
    total = row_count(df)
    rows = narrowed(df, tokens, min_df_percent, (key, *keep))
    frequency = settle(kept_terms(
        rows.select(F.col("_cells.term").alias("_terms")), total, "_terms", min_df_percent))
    occurrences = rows.select(key, *keep, F.explode("_cells").alias("_cell")).select(
        key, *keep, F.col("_cell.term").alias("term"), F.col("_cell.n").alias("_n"))
    return (join_sized(occurrences, frequency, "term")
            .groupBy(key, *keep, "term", "df").agg(F.sum("_n").alias("tf"))
            .select(key, *keep, "term", "tf", "df"))


def tfidf(df: DataFrame, tokens: str = "tokens", key: str = "id",
          min_df_percent: int = MIN_DF_PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """``tf * (ln((1 + n) / (1 + df)) + 1)``, not normalised, in long form."""
    idf = F.log((1 + row_count(df)) / (1 + F.col("df"))) + 1
    counted = bag_of_words(df, tokens, key, min_df_percent, keep)
    return counted.withColumn("tfidf", F.col("tf") * idf)


def fit_tfidf(df: DataFrame, tokens: str = "tokens", output: str = "features",
              min_df: float = MIN_DF_PERCENT / 100, keep: bool = True) -> PipelineModel:
    """The vector form as a fitted, saveable model.

    Weights are ``ln((1 + n) / (1 + df)) + 1`` per occurrence. Tokens are passed over twice: bounded
    summaries of the tasks tell the terms that can reach ``min_df``, then those alone are
    counted. ``keep`` caches the tokens in between, which frames on files or cached ones do not need.
    """
    own = df.storageLevel
    posts = df.select(tokens)
    with cached(posts) if keep and not (own.useMemory or own.useDisk) else nullcontext(posts) as rows:
        terms, idf = _frequent_terms(rows, tokens, min_df) or _all_terms(rows, tokens, min_df)
    counts = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol="_tf")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([x + 1.0 for x in idf]), inputCol="_tf", outputCol=output)
    return PipelineModel([counts, scale])


def _frequent_terms(posts: DataFrame, tokens: str, min_df: float) -> tuple[list[str], list[float]] | None:
    """Terms in a share of ``min_df`` of the posts, the most frequent first, and their weights.

    Nothing where no term can reach the share, or where the share is a count or below one percent.
    """
    percent = int(min_df * 100) if min_df < 1 else 0
    # At most 200 / percent times the tokens of a post: a model of such width anyway.
    likely = sorted(r.term for r in candidates(posts, tokens, percent).collect()) if percent else []
    if not likely:
        return None
    counts = CountVectorizerModel.from_vocabulary(likely, inputCol=tokens, outputCol="_tf").transform(posts)
    found = counts.select(Summarizer.metrics("count", "numNonZeros", "sum").summary(F.col("_tf")).alias("s")).first().s
    reached = [(-n, term, df) for term, df, n in zip(likely, found.numNonZeros, found.sum)
               if df >= min_df * found["count"]]
    if not reached:
        return None
    reached.sort()
    return ([term for _, term, _ in reached],
            [math.log((found["count"] + 1.0) / (df + 1.0)) for _, _, df in reached])


def _all_terms(posts: DataFrame, tokens: str, min_df: float) -> tuple[list[str], list[float]]:
    counts = CountVectorizer(
        inputCol=tokens, outputCol="_tf", minDF=min_df, vocabSize=NO_LIMIT).fit(posts)
    return counts.vocabulary, IDF(inputCol="_tf", outputCol="_idf").fit(counts.transform(posts)).idf


def svd_scores(df: DataFrame, k: int = 10, tokens: str = "tokens", key: str = "id",
               min_df: float = MIN_DF_PERCENT / 100) -> DataFrame:
    """Scores of a truncated SVD of TF-IDF as ``(key, scores)``.

    The right vectors are terms x k and small. A post's score is the sum, over its
    token occurrences, of the term's weighted right vector: a broadcast join and
    one aggregate, with no dense post vector anywhere.
    """
    # Rows get a key of their own, so that repeated and null ids keep their own scores. Texts are
    # cleaned and cut once, for this file; the decomposition passes over kept vectors many times.
    rows = settle(df.select(key, tokens).withColumn("_row", F.monotonically_increasing_id()))
    model = fit_tfidf(rows, tokens, min_df=min_df, keep=False)
    counts, scale = model.stages
    with cached(MLUtils.convertVectorColumnsFromML(
            model.transform(rows.select(tokens)).select("features"), "features")) as vectors:
        right = RowMatrix(vectors).computeSVD(k, computeU=False).V.toArray()
    weighted = right * scale.getScalingVec().toArray()[:, None]
    table = df.sparkSession.createDataFrame(
        pd.DataFrame({"term": counts.vocabulary, "direction": weighted.tolist()}),
        "term string, direction array<double>")
    sums = F.array(*[F.sum(F.col("direction")[i]) for i in range(k)])
    found = (rows.select("_row", each_token(tokens).alias("term"))
             .transform(join_sized, table, "term").groupBy("_row").agg(sums.alias("scores")))
    nothing = F.array_repeat(F.lit(0.0), k)
    return (rows.select(key, "_row").join(found, "_row", "left")
            .select(key, F.coalesce("scores", nothing).alias("scores")))


def impute_constant(df: DataFrame) -> DataFrame:
    """Numbers: NULL -> 0. Strings: NULL -> 'NA'."""
    return df.fillna(0).fillna("NA")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - mean) / population deviation``; a constant column becomes zero."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("dev")).alias(c)
        for c in columns]).alias("s")).scalar()
    with_stats = df.withColumn("_stats", stats)
    scaled = {}
    for c in columns:
        mean, dev = F.col(f"_stats.{c}.mean"), F.col(f"_stats.{c}.dev")
        scaled[c] = (F.col(c) - mean) / F.when(dev == 0, 1.0).otherwise(dev)
    return with_stats.withColumns(scaled).drop("_stats")


def one_hot(train: DataFrame, df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``(key, feature, value, weight)`` for values seen in ``train``; others give no row."""
    def long_form(frame: DataFrame, *keep: str) -> DataFrame:
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
            for c in columns])).alias("c")
        return frame.select(*keep, cells).select(*keep, "c.feature", "c.value")

    seen = settle(long_form(train).distinct())
    return (join_sized(long_form(df, key), seen, ["feature", "value"])
            .select(key, "feature", "value", F.lit(1).alias("weight")))


def one_hot_stages(columns: list[str]) -> list:
    """The vector form. The indexer numbers unseen values last; that slot is dropped."""
    index = StringIndexer(
        inputCols=columns, outputCols=[f"{c}_index" for c in columns], handleInvalid="keep")
    encode = OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_hot" for c in columns],
        dropLast=True)
    return [index, encode]


def feature_union(numbers: list[str] = (), categories: list[str] = (),
                  vectors: list[str] = (), output: str = "features") -> Pipeline:
    """Concatenate vector, number and category features into one column.

    A group that is left out is simply not passed.
    """
    stages = one_hot_stages(list(categories)) if categories else []
    inputs = [*vectors, *numbers, *[f"{c}_hot" for c in categories]]
    if not inputs:
        raise ValueError("no features chosen")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol=output)])


def build_vocabulary(df: DataFrame, size: int | None = None, tokens: str = "tokens") -> DataFrame:
    """``(term, term_id)``: all terms, the most frequent first, numbered from 4.

    ``size`` keeps only that many of the most frequent ones.
    """
    counts = (df.select(each_token(tokens).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    ranked = numbered(counts, F.desc("n"), F.col("term"))
    if size is not None:
        ranked = ranked.filter(F.col("position") < size)
    return ranked.select("term", (F.col("position") + FIRST_TERM_ID).cast("int").alias("term_id"))


def encode_sequence(df: DataFrame, vocabulary: DataFrame, max_length: int = 128,
                    tokens: str = "tokens", key: str = "id", limit: int = TABLE_BYTES) -> DataFrame:
    """``(key, input_ids, attention_mask)`` per row, both exactly ``max_length`` wide.

    Start mark, ids, end mark, padding. Sequences are truncated to fit; terms outside the
    vocabulary get the id of the unknown term, a NULL list is empty. Rows that share an id, or have
    none, keep their own sequences. A vocabulary that measures within ``limit`` bytes is looked
    up row by row, without a shuffle; of a larger one rows meet in chunks with the terms they use, with
    the same result.
    """
    room = max_length - 2
    known = settle(vocabulary.select("term", "term_id"))
    heads = df.select(key, F.slice(tokens, 1, room).alias(LIST))
    if fits(known, limit):
        coded = Dictionary(known, "term", "term_id").add(heads, "_body", lambda look: F.transform(
            LIST, lambda t: F.coalesce(look(t), F.lit(UNKNOWN))))
    else:
        coded = mapped(heads, F.col(LIST), known, F.col("term_id"), "_body").withColumn(
            "_body", F.transform("_body", lambda i: F.coalesce(i, F.lit(UNKNOWN))))
    body = F.coalesce("_body", F.array().cast("array<int>"))
    marked = coded.select(key, F.concat(F.array(F.lit(START)), body, F.array(F.lit(END))).alias("_ids"))
    gap = F.lit(max_length) - F.size("_ids")
    return marked.select(
        key,
        F.concat("_ids", F.array_repeat(F.lit(PAD), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_ids")),
                 F.array_repeat(F.lit(0), gap)).alias("attention_mask"))
