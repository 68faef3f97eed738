"""Quality grades by ordinal regression on hashed text.

Grades are ordered levels 0, 1, ... A cumulative-link (logit) model has one weight
vector for all levels and ordered thresholds: P(grade > k) = logistic(w.x - t_k).
Features are the presence of each lower-cased word without marks, hashed, and the shares of words
that repeat the one before, are in capitals, or end in an exclamation mark.

The model is fitted on at most ``TRAIN_ROWS`` graded texts per grade, those with the
smallest id hashes, weighted back to the grades' real shares; their features go to
one task (the bound is the parameter). Words of fewer than ``LEAST_TEXTS`` of these texts (a
parameter as well) have no weight, as they would be learned by heart. Scoring is row-local over whole texts. It gives the
expected grade and the probability of the top grade, by which texts are selected.

Null and empty texts have no features and get what the thresholds say. Repeated
graded rows count once per id, with the lowest grade; of differing texts of an id the first in
byte order is learned from, so repeated documents add nothing to the task. Without graded texts all scores
are null. Other columns are kept; the result columns are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.language import sampled_ids
from postlab.session import join_sized, ship_package

BITS = 18
SHARES = 3
TRAIN_ROWS = 3_000
STEPS = 150
RATE = 0.1
RIDGE = 1e-3
LEAST_TEXTS = 5
MARKS = ".,;:!?\"'()[]"
SELECT = 0.5


class WordBuckets(dict):
    """Bucket of each word; forgets everything when full, so its memory is bounded."""

    MOST = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = bucket = zlib.crc32(word.strip(MARKS).lower().encode()) >> (32 - BITS)
        return bucket


BUCKETS = WordBuckets()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets, and the shares that follow them in the weight vector."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(SHARES)
    buckets = np.array(list({BUCKETS[w] for w in set(words)}), np.int64)
    shares = np.array([sum(map(eq, words, words[1:])), sum(map(str.isupper, words)),
                       text.count("!")], np.float64) / len(words)
    return buckets, np.minimum(shares, 1.0)


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for every threshold."""
        buckets, shares = features(text)
        value = self.weights[buckets].sum() + self.weights[-SHARES:] @ shares
        return 1 / (1 + np.exp(np.clip(self.thresholds - value, -30, 30)))


def cumulative_link(buckets: list[np.ndarray], shares: np.ndarray, grade: np.ndarray,
                    weight: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch Adam on the ordinal likelihood; gaps between thresholds stay positive."""
    size = (1 << BITS) + SHARES
    row = np.repeat(np.arange(len(grade)), [len(b) for b in buckets])
    column = np.concatenate([*buckets, np.zeros(0, np.int64)]).astype(np.int64)
    used, column = np.unique(column, return_inverse=True)
    n, rows = len(used), len(grade)
    share = weight / weight.sum()
    below = np.array([share[grade <= k].sum() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log(below / (1 - below))
    p = np.concatenate([np.zeros(n + SHARES), start[:1],
                        np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        w, raw = p[:n + SHARES], p[n + SHARES:]
        cuts = np.cumsum(np.append(raw[:1], np.exp(raw[1:])))
        edge = np.concatenate([[-40.0], cuts, [40.0]])
        value = np.bincount(row, w[column], rows) + shares @ w[n:]
        high = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - value, -30, 30)))
        low = 1 / (1 + np.exp(-np.clip(edge[grade] - value, -30, 30)))
        mass = np.maximum(high - low, 1e-9)
        dhigh, dlow = high * (1 - high) / mass, low * (1 - low) / mass
        dvalue = share * (dhigh - dlow)  # of minus the log-likelihood
        dcuts = (np.bincount(grade + 1, -share * dhigh, levels + 1)
                 + np.bincount(grade, share * dlow, levels + 1))[1:levels]
        tail = np.cumsum(dcuts[::-1])[::-1]
        slope = np.concatenate([np.bincount(column, dvalue[row], n), shares.T @ dvalue,
                                tail[:1], tail[1:] * np.exp(raw[1:])])
        slope[:n + SHARES] += RIDGE * w
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        p -= RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(size)
    weights[used], weights[-SHARES:] = p[:n], p[n:n + SHARES]
    return weights, np.cumsum(np.append(p[n + SHARES], np.exp(p[n + SHARES + 1:])))


def train(docs: DataFrame, grades: DataFrame, id: str = "doc_id", text: str = "text",
          rows: int = TRAIN_ROWS, least_texts: int = LEAST_TEXTS) -> Model | None:
    """Fit on documents with a ``grade`` (0, 1, ...) in ``grades``."""
    ship_package(docs.sparkSession)
    graded = grades.select(F.col(id).alias("id"), F.col("grade").cast("int").alias("lang")).dropna()
    graded = graded.groupBy("id").agg(F.min("lang").alias("lang"))
    counts = {r["lang"]: r["n"] for r in graded.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per grade
    levels = max(counts, default=0) + 1
    if levels < 2:
        return None
    chosen = sampled_ids(graded, rows)
    texts = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # One text per id before anything is gathered; copies are cut in each task already.
    sample = join_sized(texts, chosen, "id").groupBy("id", "lang").agg(F.min("text").alias("text"))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"grade": batch["lang"], "id": batch["id"],
                                "buckets": [b for b, _ in made], "shares": [s for _, s in made]})

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        grade = group["grade"].to_numpy(np.int64)
        texts = np.bincount(np.concatenate(group["buckets"].tolist()), minlength=1 << BITS)
        buckets = [b[texts[b] >= least_texts] for b in group["buckets"]]
        seen = np.bincount(grade, minlength=levels)
        weight = np.array([counts.get(g, 0) / max(seen[g], 1) for g in grade])
        weights, cuts = cumulative_link(buckets, np.stack(group["shares"]), grade,
                                        weight, levels)
        at = np.flatnonzero(weights)
        return pd.DataFrame({"place": np.append(at, -1 - np.arange(len(cuts))),
                             "value": np.append(weights[at], cuts)})

    kind = docs.schema[id].dataType.simpleString()
    found = (sample.mapInPandas(extracted, f"grade int, id {kind}, buckets array<long>, "
                                "shares array<double>")
             .groupBy().applyInPandas(fitted, "place long, value double").collect())
    if not found:
        return None
    weights, cuts = np.zeros((1 << BITS) + SHARES), np.zeros(levels - 1)
    for r in found:  # at most one row per weight and threshold
        if r.place >= 0:
            weights[r.place] = r.value
        else:
            cuts[-1 - r.place] = r.value
    return Model(weights, cuts)


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Append ``expected_grade``, ``tail_probability`` (of the top grade) and ``selected``."""
    if model is None:
        return df.withColumns({"expected_grade": F.lit(None).cast("double"),
                               "tail_probability": F.lit(None).cast("double"),
                               "selected": F.lit(None).cast("boolean")})
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def graded(texts: pd.Series) -> pd.DataFrame:
        above = np.array([sent.value.above(t) for t in texts]).reshape(len(texts), -1)
        return pd.DataFrame({"expected_grade": above.sum(1), "tail_probability": above[:, -1]})

    return (df.withColumn("_graded", graded(F.coalesce(F.col(text), F.lit(""))))
            .withColumns({c: F.col(f"_graded.{c}") for c in ("expected_grade", "tail_probability")})
            .drop("_graded").withColumn("selected", F.col("tail_probability") >= SELECT))
