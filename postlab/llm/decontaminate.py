"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the items.

Every text is cut into overlapping passages; a passage is twice as long as the
longest item and starts every item length, so each stretch of an item's length lies
inside one. A passage is a query against the index of items. Impacts are scaled by
the item's score against itself, so one threshold (``RETRIEVE``) holds for all.

Search per passage, vectorised over many passages: terms are numbered by their
largest impact, so the distinct terms of a passage come in that order; those that
cannot reach the threshold together are not essential (the WAND pivot). The posting
blocks of the essential terms, by their block maxima, open the blocks that can still
reach it with all that the other terms could add; the block maxima of the other terms
bound the open blocks, and the items of those that remain are scored in full.
Nothing that reaches the threshold is lost.

A retrieved item counts as leaked if the passage holds at least ``OVERLAP`` of the
five-word shingles of its question and of its answer. An item's answer is its last
sentence, its question the rest; an item of one sentence is both.

Postings, document frequencies and lengths are counted by Spark and written to the
shared folder. The index is searched in parts of consecutive items: a part has at most
``PART_ITEMS`` items and at most ``PART_BYTES`` bytes even if all were as long as the
longest one (a single item may exceed that). The driver holds one part at a time; the
documents are scanned once per part, with the same result for any parts.

Null and empty texts, items without text or id match nothing; repeated rows of an id
give one row per item, as do all rows without an id; an empty benchmark gives no rows.
Words are runs of letters, digits and underscores, lower-cased.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.session import numbered, settle, ship_package

RETRIEVE = 0.35
OVERLAP = 0.8
SHINGLE_WORDS = 5
BLOCK_ITEMS = 4
PART_ITEMS = 20_000
PART_BYTES = 1 << 25
K1, B = 1.2, 0.75
CHUNK_WORDS = 1 << 16
CELLS = 1 << 19  # cells of passages by blocks, and postings, that are held at once
WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    cuts = [m.end() for m in SENTENCE_END.finditer(text)]
    question, answer = (text[:cuts[-1]], text[cuts[-1]:]) if cuts else (text, text)
    question, answer = words_of(question), words_of(answer)
    return question or answer, answer or question


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(size))))


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of a part's shingles that a passage has; a shorter part is one shingle."""
    size = min(SHINGLE_WORDS, len(part))
    wanted = shingles(part, size)
    return len(wanted & shingles(passage, size)) / len(wanted) if wanted else 0.0


class Index:
    """Blocked postings of some items, with impacts relative to each item's own score."""

    def __init__(self, items: list[tuple[int, str]], total: int, average: float,
                 frequency: dict[str, int]):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        numbers: dict[str, int] = {}
        rows = []
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            weights = {}
            for word, n in Counter(words).items():
                df = frequency[word]
                idf = math.log(1 + (total - df + 0.5) / (df + 0.5))
                norm = K1 * (1 - B + B * len(words) / average)
                weights[word] = idf * n * (K1 + 1) / (n + norm)
            own = sum(weights.values())
            rows += [(numbers.setdefault(w, len(numbers)), number, x / own)
                     for w, x in weights.items()]
        term, item, impact = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, int),) * 3
        most = np.zeros(len(numbers))
        np.maximum.at(most, term, impact)
        # Terms are renumbered in the order of their largest impact.
        place = np.empty(len(numbers), np.int64)
        place[np.argsort(most, kind="stable")] = np.arange(len(numbers))
        self.terms = {w: int(place[n]) for w, n in numbers.items()}
        self.term_most = np.sort(most, kind="stable")
        term = place[term]
        order = np.lexsort((item, term))
        self.term, self.item = term[order].astype(np.int64), item[order].astype(np.int64)
        self.impact = impact[order].astype(np.float64)
        self.blocks = max(-(-len(items) // BLOCK_ITEMS), 1)
        cell = self.term * self.blocks + self.item // BLOCK_ITEMS
        self.cell_first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell = cell[self.cell_first]  # a term's postings within a block
        self.cell_block = self.cell % self.blocks
        self.cell_last = np.append(self.cell_first[1:], len(cell))
        self.cell_most = (np.maximum.reduceat(self.impact, self.cell_first) if len(cell)
                          else np.zeros(0))
        self.term_first = np.searchsorted(self.cell, np.arange(len(self.terms) + 1) * self.blocks)

    SLACK = 1e-9  # bounds are sums in another order than scores

    def search(self, passage: np.ndarray, term: np.ndarray,
               least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``passage, item, score`` of all pairs that reach ``least``.

        ``passage, term`` are distinct and sorted.
        """
        first, size = runs(passage)
        # Passages in slices of bounded tables: blocks of each, cells of their terms.
        cells = np.concatenate([[0], np.cumsum(self.term_first[term + 1] - self.term_first[term])])
        cost = np.maximum(self.blocks, cells[first + size] - cells[first])
        bins = np.cumsum(cost) // CELLS
        found = [self._search(passage[first[a]:first[b - 1] + size[b - 1]],
                              term[first[a]:first[b - 1] + size[b - 1]], least)
                 for a, b in zip(*cuts(bins))]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(column) for column in zip(*found))

    def _search(self, passage: np.ndarray, term: np.ndarray, least: float) -> tuple:
        most = self.term_most[term]
        first, size = runs(passage)
        number = np.repeat(np.arange(len(first)), size)
        along = np.cumsum(most)
        along -= np.repeat(along[first] - most[first], size)
        essential = along >= least - self.SLACK
        others = np.add.reduceat(np.where(essential, 0.0, most), first)
        table = len(first) * self.blocks
        # Blocks that the essential terms open, with all that the others could add.
        who, cell = self._cells(np.flatnonzero(essential), term)
        at = number[who] * self.blocks + self.cell_block[cell]
        bound = sums(at, self.cell_most[cell], table)
        opened = (bound > 0) & (bound + np.repeat(others, self.blocks) >= least - self.SLACK)
        # What the others do add in the open blocks.
        who_2, cell_2 = self._cells(np.flatnonzero(~essential), term)
        at_2 = number[who_2] * self.blocks + self.cell_block[cell_2]
        bound += sums(at_2, self.cell_most[cell_2], table)
        opened &= bound >= least - self.SLACK
        pair = np.cumsum(opened) - 1  # number of an open block among the open ones
        at, cell = np.concatenate([at, at_2]), np.concatenate([cell, cell_2])
        inside = opened[at]
        which, posting = expand(pair[at[inside]], self.cell_first[cell[inside]],
                                self.cell_last[cell[inside]])
        slot = which * BLOCK_ITEMS + self.item[posting] % BLOCK_ITEMS
        score = sums(slot, self.impact[posting], int(opened.sum()) * BLOCK_ITEMS)
        good = np.flatnonzero(score >= least)
        place = np.flatnonzero(opened)[good // BLOCK_ITEMS]
        return (passage[first[place // self.blocks]],
                place % self.blocks * BLOCK_ITEMS + good % BLOCK_ITEMS, score[good])

    def _cells(self, rows: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All posting blocks of the terms of some rows, with the row of each."""
        return expand(rows, self.term_first[term[rows]], self.term_first[term[rows] + 1])

    def leaks(self, texts: list[list[str]], span: int,
              least: float) -> Iterator[tuple[int, int, float, float, float]]:
        """``text, item, score, question, answer``: retrieved and verified, best passage each."""
        lengths = np.array([len(words) for words in texts])
        term = np.fromiter(map(self.terms.get, chain.from_iterable(texts), repeat(-1)), np.int64,
                           lengths.sum())
        owner = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hit = term >= 0
        term, owner, place = term[hit], owner[hit], place[hit]
        # Passage p covers words [p * span, (p + 2) * span): every word is in one or two.
        steps = np.maximum(-(-lengths // span) - 1, 1)
        base = np.cumsum(steps) - steps
        late = place // span
        pairs = [np.stack([base[owner][ok] + p[ok], term[ok]]) for p in (late, late - 1)
                 for ok in [(p >= 0) & (p < steps[owner])]]
        passage, term = np.concatenate(pairs, axis=1)
        packed = distinct(passage * len(self.terms) + term)
        best: dict[tuple[int, int], tuple] = {}
        for passage, item, score in zip(*self.search(packed // max(len(self.terms), 1),
                                                     packed % max(len(self.terms), 1), least)):
            text = int(np.searchsorted(base, passage, "right")) - 1
            start = (passage - base[text]) * span
            words = texts[text][start:start + 2 * span]
            question, answer = self.parts[item]
            asked, answered = overlap(question, words), overlap(answer, words)
            if asked >= OVERLAP and answered >= OVERLAP:
                one = (float(score), asked, answered)
                best[text, item] = max(best.get((text, item), one), one)
        for (text, item), one in best.items():
            yield text, self.ids[item], *one


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return first, np.diff(np.append(first, len(sorted_keys)))


def cuts(bins: np.ndarray) -> tuple[list[int], list[int]]:
    """Begin and end of each run of equal values."""
    inner = (np.flatnonzero(np.diff(bins)) + 1).tolist()
    return ([0, *inner], [*inner, len(bins)]) if len(bins) else ([], [])


def sums(place: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Weights summed by place, in doubles; ``np.bincount`` of no places gives integers."""
    return np.bincount(place, weights, size).astype(np.float64, copy=False)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting integers beats the hashing that ``np.unique`` does."""
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


def expand(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of each range, with the range's owner."""
    size = last - first
    return np.repeat(owner, size), np.arange(size.sum()) + np.repeat(
        first - (np.cumsum(size) - size), size)


def postings(items: DataFrame) -> DataFrame:
    """``position, word, n, words``: how often an item has a word, and how many it has in all."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for position, text in zip(batch["position"], batch["text"]):
                words = words_of(text)
                rows += [(position, w, n, len(words)) for w, n in Counter(words).items()]
            yield pd.DataFrame(rows, columns=["position", "word", "n", "words"])

    return items.select("position", "text").mapInPandas(
        count, "position long, word string, n long, words long")


def build(items: DataFrame, id: str = "item_id", text: str = "text") -> tuple[Iterator[Index], int]:
    """The index in parts, made one by one, and the length of the longest item."""
    ship_package(items.sparkSession)
    named = items.select(F.col(id).alias("id"), F.col(text).alias("text")).dropna().distinct()
    table = settle(numbered(named, F.col("id"), F.col("text")))
    counted = settle(postings(table))
    frequency = settle(counted.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    lengths = counted.select("position", "words").distinct()
    total, average, longest = lengths.agg(
        F.count(F.lit(1)), F.avg("words"), F.max("words")).first()
    rows, widest = table.agg(F.max("position"), F.max(F.octet_length("text"))).first()
    step = max(min(PART_ITEMS, PART_BYTES // max(widest or 0, 1)), 1)

    def parts() -> Iterator[Index]:
        for start in range(0, (rows if rows is not None else -1) + 1, step):
            inside = F.col("position").between(start, start + step - 1)
            # A part is bounded by its step: texts, and the frequencies of its words.
            texts = [(r["id"], r["text"]) for r in table.filter(inside).orderBy("position").collect()]
            words = counted.filter(inside).select("word").distinct()
            known = {r["word"]: r["df"] for r in frequency.join(words, "word", "left_semi").collect()}
            texts = [(i, t) for i, t in texts if words_of(t)]
            if texts:
                yield Index(texts, total, average, known)

    return parts(), longest or 0


def find_leaks(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
               least: float = RETRIEVE) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of leaked items."""
    spark = df.sparkSession
    ship_package(spark)
    indexes, longest = build(items)
    kind = df.schema[id].dataType.simpleString()
    # Ids travel as text: pandas would turn integers beside nulls into floats.
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    schema = ("doc_id string, item_id long, score double, question_overlap double, "
              "answer_overlap double")
    rows = df.select(F.col(id).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    found = None
    for index in indexes:
        sent = spark.sparkContext.broadcast(index)

        def searched(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows, ids, some, held = [], [], [], 0
                for key, content in zip(batch["id"], batch["text"]):
                    ids.append(key)
                    some.append(words_of(content))
                    held += len(some[-1]) + 1
                    if held >= CHUNK_WORDS:
                        rows += [(ids[t], *x) for t, *x in sent.value.leaks(some, longest, least)]
                        ids, some, held = [], [], 0
                if some:
                    rows += [(ids[t], *x) for t, *x in sent.value.leaks(some, longest, least)]
                yield pd.DataFrame(rows, columns=names)

        # Written at once, so that no more than one part is alive.
        part = settle(rows.mapInPandas(searched, schema))
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.groupBy(F.col("doc_id").cast(kind).alias("doc_id"), "item_id").agg(
        *(F.max(c).alias(c) for c in names[2:]))
