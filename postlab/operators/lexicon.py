"""Lexicon selection, matching on frames, term vectors and lexicon building."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlab.functions.binding import let
from postlab.functions.dictionary import TABLE_BYTES, Dictionary, fits
from postlab.functions.matching import MORE, PLACE, WHOLE, hits_of, pieces, places, prefixes
from postlab.functions.tokens import each_token, word_count
from postlab.operators.chunks import CHUNK, TERM, VALUE, answers, chunked, right_type, with_answers
from postlab.operators.subspace import principal_directions, projected
from postlab.session import cached, join_sized, removed, settle

# The level and the category codes of the filtered lexicon.
LEVEL = "conservative"
CATEGORIES = ("pa", "dmc", "asm", "asf", "pr", "om", "qas", "cds")

PARTS, FIRST, PLACES = "_parts", "_first", PLACE
NARROW = 1_000  # columns whose covariance matrix is small
WORD_START = r"^[\p{L}\p{N}_]"


def select_lexicon(lexicon: DataFrame, level: str = LEVEL,
                   categories: tuple[str, ...] = CATEGORIES,
                   filtered: bool = True) -> DataFrame:
    if filtered:
        lexicon = lexicon.filter(
            (F.col("level") == level) & F.col("category").isin(list(categories)))
    return lexicon.select("term").distinct()


def lexicon_terms(lexicon: DataFrame) -> DataFrame:
    """Distinct lower-cased terms; NULLs and terms that do not start and end with a word
    character can match no whole word and are left out, whatever route follows."""
    whole = r"(?s)^[\p{L}\p{N}_](?:.*[\p{L}\p{N}_])?$"
    return lexicon.select(F.lower("term").alias("term")).filter(F.col("term").rlike(whole)).distinct()


def term_list(lexicon: DataFrame) -> list[str]:
    """The terms in order, for a vector with one place per term: a model of that width anyway."""
    return sorted(r.term for r in lexicon_terms(lexicon).collect())


def _longest(known: DataFrame) -> int:
    """Length in pieces of the longest term."""
    return known.agg(F.max("length")).first()[0] or 1


def match_lexicon(posts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text",
                  limit: int = TABLE_BYTES) -> DataFrame:
    """``(key, start, length, term)``: every place where a term occurs in a post, per row.

    ``start`` and ``length`` count pieces. A lexicon that measures within ``limit`` is looked up
    row by row without a shuffle; a larger one chunk by chunk, with the same result.
    """
    known = settle(prefixes(lexicon_terms(lexicon)))
    longest = _longest(known)
    if fits(known, limit):
        found = Dictionary(known, "run", "kind").add(
            posts.select(key, text), "_places", lambda look: places(F.col(text), look, longest))
    else:
        found = _chunked(posts.select(key, text), known, longest, text, "_places", PLACES, list)
    return found.select(key, each_token("_places").alias("p")).select(
        key, "p.start", "p.length", "p.term")


def _run_key(run: Column) -> Column:
    """A run of under 16 bytes itself, else its 128-bit hash."""
    return F.when(F.octet_length(run) < 16, run.cast("binary")).otherwise(F.unhex(F.md5(run)))


def _run_bytes(run: str) -> bytes:
    """The same in Python."""
    raw = run.encode()
    return raw if len(raw) < 16 else hashlib.md5(raw, usedforsecurity=False).digest()


class _Kinds(dict):
    """Kinds of words, each hashed once per chunk."""

    def __init__(self, look: dict):
        super().__init__()
        self.look = look

    def __missing__(self, word: str) -> int | None:
        kind = self[word] = self.look.get(_run_bytes(word))
        return kind


def _walk(parts: list[str], first: int, words: _Kinds) -> list[tuple[int, int, str, int | None]]:
    """``start, length, run, kind`` of all runs from a word on whose prefixes go on; unknown: None."""
    runs, look, size = [], words.look, len(parts)
    for start in range(first, size, 2):
        run, length = parts[start], 1
        kind = words[run]
        runs.append((start, length, run, kind))
        while kind and kind & MORE and start + length + 1 < size:
            end = start + length
            run, length = run + parts[end] + parts[end + 1], length + 2
            kind = look.get(_run_bytes(run))
            runs.append((start, length, run, kind))
    return runs


def _cut_rows(left: pa.Table) -> Iterator[tuple[list[str], int]]:
    """Pieces and place of the first word, row by row; no text, no pieces."""
    for batch in left.select([PARTS, FIRST]).to_batches():
        lists = batch.column(0)
        pieces_ = lists.values.to_numpy(zero_copy_only=False)
        ends, missing = lists.offsets.to_pylist(), lists.is_null().to_pylist()
        for i, first in enumerate(batch.column(1).to_pylist()):
            yield [] if missing[i] else pieces_[ends[i]:ends[i + 1]].tolist(), first


def _hits(found: list[tuple[int, int, str]]) -> list[str]:
    """Of all places the longest at each start, overlaps dropped."""
    hits, free = [], 0
    for i, (start, length, term) in enumerate(found):
        if start >= free and not (i + 1 < len(found) and found[i + 1][0] == start):
            hits.append(term)
            free = start + length
    return hits


def _chunked(posts: DataFrame, known: DataFrame, longest: int, text: str, output: str, kind: str,
             result: Callable[[list], list]) -> DataFrame:
    """Posts with ``output``: ``result`` of the places of terms, for prefixes of any number.

    Chunks ask for their distinct words and pairs of words first, then for longer runs, one length
    after another, as far as prefixes are known.
    """
    table = known.select(_run_key(F.col("run")).alias(TERM), F.col("kind").alias(VALUE))
    rows = chunked(posts, F.coalesce(F.octet_length(text), F.lit(0)))
    parts = pieces(F.col(text))

    def runs(parts: Column) -> Column:
        def of_word(word: Column, i: Column) -> Column:
            pair = F.when(i + 3 <= F.size(parts), F.concat(word, F.get(parts, i + 1), F.get(parts, i + 2)))
            return F.when(word.rlike(WORD_START), F.array(word, pair))

        if longest == 1:
            return F.array_distinct(parts)  # what is no word is in no table
        return F.array_distinct(F.array_compact(F.flatten(F.array_compact(F.transform(parts, of_word)))))

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn(PARTS, parts).withColumn(
            FIRST, F.when(F.get(PARTS, F.lit(0)).rlike(WORD_START), 0).otherwise(1))

    met = settle(answers(rows.select(CHUNK, F.explode(let(parts, runs)).alias("run")).select(
        CHUNK, _run_key(F.col("run")).alias(TERM)), table))
    for wanted in range(5, longest + 1, 2):
        def longer(left: pa.Table, look: dict, wanted=wanted) -> pa.Table:
            words = _Kinds(look)
            asked = {_run_bytes(run) for x, first in _cut_rows(left)
                     for _, length, run, _ in _walk(x, first, words) if length == wanted}
            return pa.table({CHUNK: pa.array([left[CHUNK][0].as_py()] * len(asked), pa.int64()),
                             TERM: pa.array(list(asked), pa.binary())})

        asked = with_answers(rows.select(CHUNK, text), met, cut, longer, f"{CHUNK} long, {TERM} binary")
        more = settle(answers(asked, table))
        if more.isEmpty():
            break
        met = met.unionByName(more)
    names, schema = posts.columns, T.StructType([*posts.schema.fields, T.StructField(output, T.DataType.fromDDL(kind))])
    arrow = schema[output].dataType

    def place(left: pa.Table, look: dict) -> pa.Table:
        words = _Kinds(look)
        found = [result([(start, length, run) for start, length, run, k in _walk(x, first, words)
                         if k and k & WHOLE])
                 for x, first in _cut_rows(left)]
        return left.select(names).append_column(output, right_type(found, arrow))

    done = settle(with_answers(rows, met, cut, place, schema))
    removed(rows)
    return done


def lexicon_hits(posts: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text",
                 limit: int = TABLE_BYTES) -> DataFrame:
    """Posts with ``hits``: the non-overlapping hits in text order, [] without any.

    Every row keeps its own hits, with null and repeated ids as well; ``key`` is not used to
    find them. A lexicon that measures within ``limit`` bytes is looked up row by row,
    without a shuffle; for a larger one texts and the prefixes they hold meet in chunks, with
    the same result.
    """
    known = settle(prefixes(lexicon_terms(lexicon)))
    longest = _longest(known)
    if fits(known, limit):
        return Dictionary(known, "run", "kind").add(
            posts, "hits", lambda look: hits_of(F.col(text), look, longest))
    return _chunked(posts, known, longest, text, "hits", "array<string>", _hits)


def lexicon_flag(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, 1).otherwise(0)


def lexicon_counts(hits: Column, text: Column) -> dict[str, Column]:
    """Number of hits and the words that are left when hits are taken off."""
    return {"n_hits": F.size(hits), "n_rest": word_count(text) - F.size(hits)}


def lexicon_vector(matched: DataFrame, key: str = "id") -> DataFrame:
    """Multi-hot vector in long form: one row per post and distinct term."""
    return matched.select(
        key, F.explode(F.array_distinct("hits")).alias("term"), F.lit(1).alias("weight"))


def weighted_lexicon_vector(matched: DataFrame, key: str = "id",
                            lexicon_terms: int | None = None) -> DataFrame:
    """Long form with ``number of posts / document frequency`` as weight.

    Terms no post contains have no rows, which is weight zero. ``lexicon_terms``, if
    known, bounds the frequency table, which is measured otherwise.
    """
    pairs = lexicon_vector(matched, key).drop("weight")
    frequency = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = matched.agg(F.count(F.lit(1)).alias("n")).scalar()
    if lexicon_terms is None:
        frequency = settle(frequency)
    return join_sized(pairs, frequency, "term", small_rows=lexicon_terms).select(
        key, "term", (total / F.col("df")).alias("weight"))


def vectorise_hits(matched: DataFrame, terms: list[str], output: str = "lexicon",
                   weights: dict[str, float] | None = None) -> DataFrame:
    """The same vectors as one sparse ``lexicon`` column, term order as given."""
    model = CountVectorizerModel.from_vocabulary(
        terms, inputCol="hits", outputCol="_binary" if weights else output, binary=True)
    vectors = model.transform(matched)
    if not weights:
        return vectors
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([weights.get(t, 0.0) for t in terms]),
        inputCol="_binary", outputCol=output)
    return scale.transform(vectors).drop("_binary")


def reduce_vector(df: DataFrame, k: int, column: str = "lexicon",
                  output: str = "reduced", narrow: int = NARROW) -> DataFrame:
    """Principal components of a vector column; ``k = 0`` leaves it alone.

    Up to ``narrow`` columns the covariance matrix is solved; beyond that no matrix of columns x
    columns is made, and the directions come from passes over the rows, equal up to their sign. There
    NULL vectors stay NULL.
    """
    if k == 0:
        return df.withColumn(output, F.col(column))
    with cached(df) as kept:
        first = kept.filter(F.col(column).isNotNull()).select(column).first()
        if first is not None and first[0].size > narrow:
            directions, middle = principal_directions(kept, k, first[0].size, column)
            scores = projected(F.col(column), directions, middle)
            return df.withColumn(output, scores).withColumn(
                output, F.when(F.col(output).isNotNull(), array_to_vector(output)))
        model = PCA(k=k, inputCol=column, outputCol="_raw").fit(kept)
        mean = StandardScaler(withMean=True, withStd=False, inputCol=column, outputCol="_centred")
        middle = mean.fit(kept).mean.toArray()
    # The covariance is centred already; taking the mean's own scores off the result keeps
    # every vector sparse.
    shift = middle @ model.pc.toArray()
    scores = F.zip_with(vector_to_array("_raw"), F.array(*[F.lit(float(x)) for x in shift]),
                        lambda a, b: a - b)
    return model.transform(df).withColumn(output, array_to_vector(scores)).drop("_raw")


def token_document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Share of posts that contain each token, most frequent first."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (df.select(F.explode(F.array_distinct(tokens)).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .select("term", (F.col("df") / total).alias("value"))
            .orderBy(F.desc("value"), "term"))


def top_words(weights: DataFrame, n: int) -> DataFrame:
    """Top ``n`` terms per topic of a ``(topic, term, weight)`` table."""
    best = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def topic_lexicon(weights: DataFrame, n: int, topics: list) -> DataFrame:
    """The top words of chosen topics as one new term list."""
    return (top_words(weights.filter(F.col("topic").isin(topics)), n)
            .select("term").distinct())


def topic_weights(model, vocabulary: list[str], n: int) -> DataFrame:
    """``(topic, term, weight)`` of a fitted topic model's ``n`` heaviest terms."""
    topics = (model.describeTopics(n)
              .select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("w"))
              .select("topic", F.col("w.termIndices").alias("index"),
                      F.col("w.termWeights").alias("weight")))
    named = topics.sparkSession.createDataFrame(
        pd.DataFrame({"index": range(len(vocabulary)), "term": vocabulary}),
        "index int, term string")
    # Topics times n rows, both given by the caller of the fit.
    return named.join(F.broadcast(topics), "index").select("topic", "term", "weight")


def class_lexicon(df: DataFrame, label: str, value: str, n: int, tokens: str = "tokens",
                  disjoint: bool = True) -> DataFrame:
    """The ``n`` terms most posts of one class contain.

    With ``disjoint``, only terms no post of another class contains. One
    aggregate counts inside and outside the class together.
    """
    inside = F.col(label) == value
    counts = (
        df.filter(F.col(label).isNotNull())
        .select(inside.cast("int").alias("_in"), F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.sum("_in").alias("df"), F.sum(1 - F.col("_in")).alias("df_other")))
    kept = counts.filter(F.col("df") > 0)
    if disjoint:
        kept = kept.filter(F.col("df_other") == 0)
    return kept.select("term", "df").orderBy(F.desc("df"), "term").limit(n)
