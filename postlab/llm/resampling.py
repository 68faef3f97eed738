"""Importance resampling towards a target corpus by hashed word n-grams.

Words are runs of letters A-Z (lower-cased), digits and code points beyond ASCII; features
are all runs of one and two consecutive words, joined by one space, repeats counted. A
feature's bucket is the CRC-32 of its bytes modulo ``buckets``.

Each stretch of texts gets an Aho-Corasick automaton over its distinct words, bounded by
a delimiter on both sides; a word carries its CRC and length as payload. The scan emits the
payloads in text order, and two adjacent payloads compose to the CRC of the pair, as CRCs are
linear: the left one is moved on by the right one's length and added. No pair is ever
built as a string. A stretch is bounded in bytes, so are its automaton and its memory,
whatever the vocabulary of the corpus; a word longer than ``LONG`` is scanned under a
short stand-in with the same payload.

The buckets of each text are written once and read twice: counts per bucket are summed in
each task and then over tasks (``buckets`` rows reach the driver, a fixed number), and
the gains of all buckets go back to score the texts. A text's weight is the floored mean
gain of its features; a Gumbel variable of its id makes the highest scores a
draw without replacement. Ranks come from range partitions and their sizes.

Null texts have no words: weight 0, never drawn. A null id counts as the empty string in
the draw and comes last among equals. Repeated rows are scored alike and each takes its
own rank. An empty target or table is no error. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.session import numbered, settle, ship_package

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
STRETCH = 1 << 19
LONG = 256
LOW_LENGTHS = 64

PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """CRC states moved on by 0 to 63 zero bytes, and by 64 times each power of two.

    A state is the sum of its four bytes, so a move is four table look-ups.
    """
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):  # the reflected polynomial of zlib's CRC-32
        byte = np.where(byte & 1, np.uint32(0xEDB88320) ^ (byte >> 1), byte >> 1)
    now = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    low = []
    for _ in range(LOW_LENGTHS):
        low.append(now)
        now = (now >> 8) ^ byte[now & 0xFF]
    high = [now]
    for _ in range(34):
        high.append(_apply(high[-1], high[-1]))
    return np.stack(low), np.stack(high)


def _apply(move: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (move[0][state & 0xFF] ^ move[1][state >> 8 & 0xFF]
            ^ move[2][state >> 16 & 0xFF] ^ move[3][state >> 24])


LOW, HIGH = _moves()


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs as they stand after ``length`` more zero bytes."""
    low, rest = length % LOW_LENGTHS, length // LOW_LENGTHS
    out = (LOW[low, 0, crc & 0xFF] ^ LOW[low, 1, crc >> 8 & 0xFF]
           ^ LOW[low, 2, crc >> 16 & 0xFF] ^ LOW[low, 3, crc >> 24])
    for k in range(int(rest.max(initial=0)).bit_length()):
        at = np.flatnonzero(rest >> k & 1)
        out[at] = _apply(HIGH[k], out[at])
    return out


def normal(text: str | None) -> str:
    """The text's bytes with a space for every delimiter and around it, one character each."""
    return " " + (text or "").encode().translate(PLAIN).decode("latin-1") + " "


def pieces(text: str) -> Iterator[str]:
    """A normal text in pieces of about a stretch that begin and end with a delimiter."""
    at = 0
    while at < len(text) - 1:
        end = text.find(" ", min(at + STRETCH, len(text) - 1))
        yield text[at:end + 1]
        at = end


class Dictionary:
    """Automaton over the distinct words of some pieces, with their payloads."""

    def __init__(self, pieces: list[str]):
        import ahocorasick

        words = set()
        for piece in pieces:
            words.update(piece.split(" "))
        words.discard("")
        words = list(words)
        raw = [w.encode("latin-1") for w in words]
        self.crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        # No word holds a control character, so a stand-in cannot be one.
        self.stand_in = {w: f"\x01{i}" for i, w in enumerate(words) if len(w) > LONG}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {self.stand_in.get(word, word)} ", i)
        if words:
            self.automaton.make_automaton()

    def scan(self, piece: str) -> list[int]:
        """The words of a piece in order, by number."""
        if not len(self.crc):
            return []
        if self.stand_in:
            piece = " ".join(self.stand_in.get(w, w) for w in piece.split(" "))
        return [word for _, word in self.automaton.iter(piece)]


def payloads(texts: list[str]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each normal text the CRCs and lengths of its words."""
    held, size = [], 0  # (text, piece)
    out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush() -> None:
        words = Dictionary([p for _, p in held])
        for i, piece in held:
            found = np.array(words.scan(piece), np.int64)
            out.setdefault(i, []).append((words.crc[found], words.length[found]))

    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append((i, piece))
            size += len(piece)
            if size >= STRETCH:
                flush()
                held, size = [], 0
    if held:
        flush()
    for i in range(len(texts)):
        yield out.get(i, [])


def bucket_lists(texts: list[str | None], buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text and the buckets of its features: words, then adjacent pairs."""
    parts = list(payloads([normal(t) for t in texts]))
    counts = np.array([sum(len(c) for c, _ in p) for p in parts], np.int64)
    crc = np.concatenate([np.zeros(0, np.uint32), *(c for p in parts for c, _ in p)])
    length = np.concatenate([np.zeros(0, np.int64), *(n for p in parts for _, n in p)])
    # crc(a + " " + b): both the space and b move a on; their own CRC is composed the same way.
    spaced = moved(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    pair = moved(crc[:-1], length[1:] + 1) ^ spaced[1:]
    single, double = crc % np.uint32(buckets), pair % np.uint32(buckets)
    first = np.cumsum(counts) - counts
    return counts, [np.concatenate([single[a:a + n], double[a:a + max(n - 1, 0)]])
                    for a, n in zip(first.tolist(), counts.tolist())]


def stored(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featurise(df: DataFrame, buckets: int = BUCKETS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, features``: the buckets of every whole text as packed integers."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = stored(buckets)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                # As many texts as make a stretch, one at least.
                size, end = 0, at
                while end < whole.num_rows and size < STRETCH:
                    size += len(whole.column(1)[end].as_buffer() or b"") if whole.column(1)[end].is_valid else 0
                    end += 1
                batch = whole.slice(at, end - at)
                counts, lists = bucket_lists(batch.column(1).to_pylist(), buckets)
                packed = [x.astype(kind).tobytes() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts), pa.array(packed, pa.binary())],
                    ["doc_id", "n_words", "features"])
                at = end

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("features", T.BinaryType())])
    return rows.mapInArrow(read, schema)


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column and the number in each row."""
    rows = column.to_pylist()
    sizes = np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind), sizes


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket."""
    kind = stored(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of each bucket."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(
        (t + 1) * (all_source + buckets) / ((s + 1) * (all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain, 0 without features."""
    sent, kind = features.sparkSession.sparkContext.broadcast(gain), stored(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = unpacked(batch.column(2), kind)
            sums = np.concatenate([[0], np.cumsum(sent.value[flat])])
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    schema = T.StructType([*features.schema.fields[:2], T.StructField("n_features", T.LongType()),
                           T.StructField("weight", T.LongType())])
    return features.mapInArrow(weigh, schema)


def gumbel(id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variable of an id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(df: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text",
             target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; rank is null where not drawn."""
    features = settle(featurise(df, buckets, id, text))
    wanted = target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text"))
    gain = gains(bucket_counts(features, buckets), bucket_counts(featurise(wanted, buckets), buckets))
    scored = settle(weighed(features, gain).withColumns({
        "score": F.col("weight") + gumbel(F.col("doc_id"), seed),
        "able": F.col("n_words") >= least_words,
        # Rows of equal keys are interchangeable; this lets them part over range partitions.
        "tie": F.monotonically_increasing_id()}))
    drawn = scored.filter("able").count() * percent // 100
    ranked = numbered(scored, F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"))
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))
