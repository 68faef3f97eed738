"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded with
a boundary) by rank. A text's own profile is compared to each language's: the
out-of-place distance sums how far each n-gram's rank is from its rank in the
language, with the profile length as the penalty for an absent one. The nearest
language wins; equal distances go to the first name.

Profiles are learned from at most ``TRAIN_ROWS`` labelled texts per language, the
ones with the smallest id hashes; counting is a shuffle of (language, n-gram, count)
after partial counts per batch. Only profiles (``PROFILE`` rows per language) meet on
the driver. Prediction is row-local over whole texts.

Texts that are null or without a letter get ``und`` and score 0. Without any
labelled text all get ``und``. Repeated rows are predicted alike. Columns of the input
are kept; ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.session import join_sized, ship_package

PROFILE = 300
TRAIN_ROWS = 2_000
BUCKETS = 256
ORDERS = (1, 2, 3)
GRAM_BITS = 40
CHUNK_TEXTS = 1 << 15
CHUNK_POINTS = 1 << 18
UNDETERMINED = "und"
# The cutoff of a language (`least_scores`) lies MARGIN under its least held-out score, and the closer
# to LEAST_SCORE the fewer texts tell: with FEW texts, halfway.
LEAST_SCORE = 0.2
MARGIN = 0.1
FEW = 50


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, gram, count`` of a few texts, by text and gram; grams are 40-bit hashes."""
    joined = "".join(t + "\n" for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    # Lower-casing may change lengths, so texts are told apart after it.
    lengths = [len(t.lower()) + 1 for t in texts]
    owner = np.repeat(np.arange(len(texts)), lengths)[:len(points)]
    letter = _letters()[points]
    if not letter.any():
        return (np.zeros(0, np.int64),) * 3
    # Letters, and one boundary after each word; another one opens the first text.
    keep = letter | np.append(False, letter[:-1])
    text = np.concatenate([owner[:1], owner[keep]])
    code = np.concatenate([[0], np.where(letter, points, 0)[keep]]).astype(np.uint64)
    packed = []
    for order in ORDERS:
        size = len(code) - order + 1
        gram = np.zeros(max(size, 0), np.uint64)
        inside = np.ones(len(gram), bool)
        for i in range(order):
            part = code[i:i + len(gram)]
            gram = gram << np.uint64(21) | part
            if 0 < i < order - 1 or order == 1:
                inside &= part != 0  # a boundary stands at either end only
        # The last letter or closing boundary tells the text; boundaries precede words too.
        last = text[order - 1:]
        mixed = gram[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order << 50)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        packed.append((last[inside].astype(np.uint64) << np.uint64(GRAM_BITS))
                      | (mixed >> np.uint64(64 - GRAM_BITS)))
    found = np.sort(np.concatenate(packed))
    first = np.flatnonzero(np.diff(found, prepend=found[0] + np.uint64(1)))
    count = np.diff(np.append(first, len(found)))
    key = found[first]
    return ((key >> np.uint64(GRAM_BITS)).astype(np.int64),
            (key & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64), count)


def top_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, gram, rank`` of each text's most frequent n-grams."""
    text, gram, count = gram_counts(texts)
    order = np.lexsort((gram, -count, text)) if len(text) >= 1 << 26 else _by_count(text, count)
    text, gram = text[order], gram[order]
    start = np.searchsorted(text, text)
    rank = np.arange(len(text)) - start
    top = rank < PROFILE
    return text[top], gram[top], rank[top]


def _by_count(text: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order by text, falling count, then gram: positions are already in gram order."""
    if not len(text):
        return np.zeros(0, np.int64)
    most = np.int64(count.max())
    bits = int(len(text)).bit_length()
    high = text * (most + 1) + (most - count)
    if int(high.max()).bit_length() + bits > 63:
        return np.lexsort((-count, text))
    return np.sort(high << bits | np.arange(len(text))) & ((1 << bits) - 1)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text) + 1
        if held >= CHUNK_POINTS or len(some) >= CHUNK_TEXTS:
            yield some
            some, held = [], 0
    if some:
        yield some


class Profiles:
    """Rank of every profile n-gram in every language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), PROFILE, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.names.index(lang)] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        text, gram, rank = top_grams(texts)
        if not len(text):
            return names, scores
        at = np.searchsorted(self.grams, gram)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == gram
        known_ranks = self.ranks[np.where(known, at, len(self.grams))]
        away = np.where(known_ranks == PROFILE, PROFILE, np.abs(known_ranks - rank[:, None]))
        first = np.flatnonzero(np.diff(text, prepend=-1))
        sums = np.add.reduceat(away, first, axis=0)
        size = np.diff(np.append(first, len(text)))
        best = sums.argmin(1)
        score = 1 - sums[np.arange(len(best)), best] / (size * PROFILE)
        for i, b, s in zip(text[first].tolist(), best.tolist(), score.tolist()):
            names[i], scores[i] = self.names[b], s
        return names, scores


def sampled_ids(labelled: DataFrame, rows: int) -> DataFrame:
    """``id, lang``: the ``rows`` ids of each language with the smallest hashes.

    Bucket counts tell how far to read, so ranking a common language gets few more
    rows than it returns.
    """
    keyed = labelled.withColumns({"hash": F.xxhash64("id"),
                                  "bucket": F.pmod(F.xxhash64("id"), F.lit(BUCKETS))})
    sizes = keyed.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket")
                             .rowsBetween(Window.unboundedPreceding, -1))
    open_ = sizes.withColumn("before", F.coalesce(before, F.lit(0))).filter(
        F.col("before") < rows).groupBy("lang").agg(F.max("bucket").alias("border"))
    ranked = join_sized(keyed, open_, "lang").filter("bucket <= border").withColumn(
        "n", F.row_number().over(Window.partitionBy("lang").orderBy("bucket", "hash", "id")))
    return ranked.filter(F.col("n") <= rows).select("id", "lang").distinct()


def sampled_texts(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id",
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, lang, text``: at most ``rows`` texts of each language in ``lang``."""
    labelled = df.select(F.col(id).alias("id"), F.col(lang).alias("lang"),
                         F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return join_sized(labelled, sampled_ids(labelled.select("id", "lang"), rows), ["id", "lang"],
                      "left_semi")


def labelled_texts(df: DataFrame, text: str = "text", lang: str = "lang",
                   id: str = "doc_id") -> DataFrame:
    """``id, lang, text``: every text with a language in ``lang``."""
    return df.select(F.col(id).alias("id"), F.col(lang).alias("lang"),
                     F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")


def halves() -> Column:
    """0 or 1 by the id, the half in which a text is counted."""
    return F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")


def gram_totals(sample: DataFrame) -> DataFrame:
    """``lang, half, gram, n``: n-grams counted over all rows of ``id, lang, text``."""
    ship_package(sample.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (name, half), group in batch.groupby(["lang", "half"]):
                for some in chunks(group["text"].tolist()):
                    _, gram, count = gram_counts(some)
                    total = pd.Series(count).groupby(gram).sum()
                    yield pd.DataFrame({"lang": name, "half": np.int32(half), "gram": total.index.to_numpy(np.int64),
                                        "n": total.to_numpy(np.int64)})

    return (sample.select("lang", halves().alias("half"), "text")
            .mapInPandas(counted, "lang string, half int, gram long, n long")
            .groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")))


def profiles_of(totals: DataFrame) -> Profiles:
    """Profiles of all languages of ``gram_totals``."""
    counts = totals.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= PROFILE)
    return Profiles([(r.lang, r.gram, r["rank"] - 1) for r in ranked.collect()])


def learn(sample: DataFrame) -> Profiles:
    """Profiles of all languages of ``sampled_texts`` or ``labelled_texts``."""
    return profiles_of(gram_totals(sample))


def train(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id",
          rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles of all languages in ``lang``, from at most ``rows`` texts of each."""
    return learn(sampled_texts(df, text, lang, id, rows))


def least_scores(sample: DataFrame, totals: DataFrame | None = None) -> dict[str, float]:
    """Cutoff per language from labelled texts; below it a text is in none of the languages.

    Either half of the texts is scored by profiles of the other half; texts that are not
    recognised there do not count, and a language without any has no cutoff here. ``totals``
    are the texts' `gram_totals`, where they are known.
    """
    totals = gram_totals(sample) if totals is None else totals
    scored = [predict(sample.filter(halves() == own), profiles_of(totals.filter(F.col("half") != own)))
              for own in (0, 1)]
    least = scored[0].unionByName(scored[1]).filter("lang_pred = lang").groupBy("lang").agg(
        F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    return {r.lang: LEAST_SCORE + max(0, (1 - MARGIN) * r.least - LEAST_SCORE) * r.n / (r.n + FEW)
            for r in least.collect()}


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``, the closeness to the nearest profile from 0 to 1."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for some in chunks(batch.tolist()):
                a, b = sent.value.predict(some)
                names += a
                scores += b
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = df.drop("lang_pred", "score")
    return (found.withColumn("_nearest", nearest(F.coalesce(F.col(text), F.lit(""))))
            .withColumns({c: F.col(f"_nearest.{c}") for c in ("lang_pred", "score")})
            .drop("_nearest"))


def held_out(id: Column) -> Column:
    """A third of all documents, by the checksum of the id, on which nothing is learned."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
