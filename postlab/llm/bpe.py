"""Byte-level BPE encoding and decoding of whole texts.

``encode`` cuts every text into pieces (``pretoken``), merges the byte pairs of
each distinct piece once per worker (a bounded cache keeps the results) and
returns the ids with the byte offset of every token. ``decode`` places the bytes
of each token at its offset. Both are row-local: no shuffle, nothing is
collected, and a lost executor only costs its own tasks.

Null and empty texts have no tokens and decode to no bytes. Rows are never
merged, so repeated rows give repeated results. Other columns of the input are
kept, but for the text, which its ids replace; one whose name is that of a result
column is replaced too.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from postlab.llm import pretoken
from postlab.session import ship_package

CACHED_PIECES = 200_000
# Pieces of more bytes are merged one by one with a heap, and not kept.
ROUNDS = 64
# Bytes of text that are worked on at once, so that arrays and results stay small.
CHUNK = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge adjacent pairs, lowest rank first and leftmost on ties, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # ends[i]: where the part that starts at i ends; 0: gone
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n:
            continue
        end = ends[middle]
        if ranks.get(piece[i:end]) != rank:
            continue  # one of the two parts has grown since
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            grown = ranks.get(piece[i:ends[end]])
            if grown is not None:
                heapq.heappush(heap, (grown, i))
        if i:
            left = before[i]
            grown = ranks.get(piece[left:end])
            if grown is not None:
                heapq.heappush(heap, (grown, left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return ids


class PairTable:
    """The rank of every pair of tokens whose joined bytes are a token."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.fromiter(found.keys(), np.int64, len(found))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(-1))
        self.ranks = np.append(np.fromiter(found.values(), np.int64, len(found))[order], self.NONE)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)


def merge_many(pieces: list[bytes], pairs: PairTable) -> list[bytes]:
    """``merge`` for many pieces at once, packed: each round joins every piece's best pair."""
    out = [b""] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    token = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), sizes)

    def ranks_at(i: np.ndarray) -> np.ndarray:
        after = np.minimum(i + 1, len(token) - 1)
        same = (after > i) & (piece[i] == piece[after])
        return np.where(same, pairs.rank(token[i], token[after]), pairs.NONE)

    rank = ranks_at(np.arange(len(token)))
    while len(token):
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        best = np.minimum.reduceat(rank, starts)
        if (best == pairs.NONE).any():
            stops = np.append(starts[1:], len(token))
            done = best == pairs.NONE
            keep = np.repeat(~done, stops - starts)
            packed = token[~keep].astype("<u4").tobytes()
            ends = np.cumsum(4 * (stops - starts)[done]).tolist()
            for i, a, b in zip(piece[starts[done]].tolist(), [0, *ends], ends):
                out[i] = packed[a:b]
            token, piece, rank = token[keep], piece[keep], rank[keep]
            continue
        hits = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(starts, len(token)))))
        hits = hits[np.diff(piece[hits], prepend=-1) != 0]  # the leftmost of each piece
        token[hits] = rank[hits]
        keep = np.ones(len(token), bool)
        keep[hits + 1] = False
        token, piece, rank = token[keep], piece[keep], rank[keep]
        hits = hits - np.arange(len(hits))
        changed = np.concatenate([hits, hits[hits > 0] - 1])
        rank[changed] = ranks_at(changed)
    return out


class MergedPieces(dict):
    """Packed ids by piece; forgets everything when full, so its memory is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.new.append(piece)
        self[piece] = None

    def look_up(self, pieces: list[str]) -> list[bytes]:
        if len(self) >= CACHED_PIECES:
            self.clear()
        packed = list(map(self.__getitem__, pieces))
        if self.new:
            self.merge_new()
            for i in [i for i, ids in enumerate(packed) if ids is None]:
                packed[i] = self[pieces[i]]
            for piece in self.new:
                if len(piece) > ROUNDS:
                    del self[piece]
            self.new = []
        return packed

    def merge_new(self) -> None:
        short = []
        for piece in self.new:
            content = piece.encode()
            whole = self.ranks.get(content)
            if whole is not None:
                self[piece] = whole.to_bytes(4, "little")
            elif len(content) <= ROUNDS:
                short.append((piece, content))
            else:
                self[piece] = np.array(merge(content, self.ranks), "<u4").tobytes()
        for (piece, _), ids in zip(short, merge_many([c for _, c in short], self.pairs)):
            self[piece] = ids


class Encoder:
    """Worker-side tables that turn texts into ids."""

    def __init__(self, rank_file: bytes, classes: bytes):
        self.ranks = read_ranks(rank_file)
        self.classes = np.frombuffer(classes, np.uint8)
        self.merged = MergedPieces(self.ranks)
        self.lengths = token_lengths(self.ranks)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids and packed byte offsets of each text."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends[:-1]] = pretoken.END_POINT
        first, last = pretoken.piece_bounds(points, self.classes)
        # Only slices are taken here; a piece seen before costs one look-up.
        packed = self.merged.look_up(
            [joined[a:b] for a, b in zip(first.tolist(), last.tolist())])
        ids, offsets, start = [], [], 0
        for cut in np.searchsorted(first, ends).tolist():
            one = b"".join(packed[start:cut])
            sizes = self.lengths[np.frombuffer(one, "<u4")]
            ids.append(one)
            offsets.append((np.cumsum(sizes) - sizes).astype("<u4").tobytes())
            start = cut
        return ids, offsets


class Decoder:
    """Worker-side tables that turn ids into bytes."""

    def __init__(self, rank_file: bytes):
        ranks = read_ranks(rank_file)
        self.lengths = token_lengths(ranks)
        tokens = [b""] * len(self.lengths)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        """Every token's bytes, each placed at its offset."""
        number = np.frombuffer(ids, "<u4")
        lengths = self.lengths[number]
        shift = self.starts[number] - np.frombuffer(offsets, "<u4")
        return self.flat[np.arange(lengths.sum()) + np.repeat(shift, lengths)].tobytes()


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in rank_file.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def token_lengths(ranks: dict[bytes, int]) -> np.ndarray:
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(token) for token in ranks]
    return lengths


class Vocabulary:
    """A rank file, read once on the driver and sent to the workers (a few megabytes at most)."""

    LIMIT = 64 * 1024 * 1024

    def __init__(self, spark: SparkSession, path: str):
        ship_package(spark)
        with open(path, "rb") as f:
            content = f.read(self.LIMIT + 1)
        if len(content) > self.LIMIT:
            raise ValueError(f"{path}: a vocabulary of over {self.LIMIT} bytes is not sent")
        self.key = hashlib.sha256(content).hexdigest()
        self.ranks = spark.sparkContext.broadcast(content)
        self.classes = spark.sparkContext.broadcast(pretoken.class_table())


# Worker processes are reused, so tables are built once in each.
_BUILT: dict[tuple, Encoder | Decoder] = {}


def _encoder(key: str, ranks: Broadcast, classes: Broadcast) -> Encoder:
    if ("encode", key) not in _BUILT:
        _BUILT["encode", key] = Encoder(ranks.value, classes.value)
    return _BUILT["encode", key]


def _decoder(key: str, ranks: Broadcast) -> Decoder:
    if ("decode", key) not in _BUILT:
        _BUILT["decode", key] = Decoder(ranks.value)
    return _BUILT["decode", key]


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes in a column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // size, prepend=0)) + 1
    start = 0
    for cut in [*cuts.tolist(), batch.num_rows]:
        if cut > start:
            yield batch.slice(start, cut - start)
            start = cut


def _mapped(df: DataFrame, read: list[str], drop: list[str], new: dict[str, str], run) -> DataFrame:
    """Replace ``drop`` by the ``new`` columns that ``run`` makes of the columns ``read``."""
    kept = [f for f in df.schema.fields if f.name not in {*drop, *new}]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t))
                                    for n, t in new.items())])
    names = [f.name for f in kept]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read[0], CHUNK):
                made = run(*(part.column(c).to_pylist() for c in read))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), *made], [*names, *new])

    return df.select(*dict.fromkeys([*names, *read])).mapInArrow(mapped, schema)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Put ``ids`` (little-endian unsigned 32-bit), ``offsets`` (bytes, the same form) and
    ``n_tokens`` in the place of the text."""
    key, ranks, classes = vocabulary.key, vocabulary.ranks, vocabulary.classes

    def run(texts: list[str | None]) -> list[pa.Array]:
        ids, offsets = _encoder(key, ranks, classes).encode([t or "" for t in texts])
        return [pa.array(ids, pa.binary()), pa.array(offsets, pa.binary()),
                pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _mapped(df, [text], [text],
                   {"ids": "binary", "offsets": "binary", "n_tokens": "bigint"}, run)


def decode(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Append ``decoded``, the bytes that ``ids`` and ``offsets`` stand for."""
    key, ranks = vocabulary.key, vocabulary.ranks

    def run(ids: list[bytes], offsets: list[bytes]) -> list[pa.Array]:
        decoder = _decoder(key, ranks)
        return [pa.array([decoder.decode(a, b) for a, b in zip(ids, offsets)], pa.binary())]

    return _mapped(df, ["ids", "offsets"], [], {"decoded": "binary"}, run)
