"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A fingerprint has a bit where more than half of the shingle hashes have it. Two
fingerprints are linked if at most ``max_bits`` (4) of 64 bits differ; documents
form the components of those links.

Exactness. Cut 64 bits into four blocks of 16. Two fingerprints within 4 bits
cannot differ by 2 or more bits in three blocks, so at least two blocks differ by
at most 1. Hence one of the first three blocks does, together with a later one.
Each of the first three blocks gets a vantage-point tree over its Hamming distance:
a node holds the block values within its radius of the vantage value on one side,
the others on the other side. A fingerprint lives in the leaf of its own value; as
a query with radius 1 it also visits every leaf that the triangle bound cannot
exclude. Leaves are the shards; inside one, values of the tree's block and of a
later block within 1 bit each give the candidates, and the whole distance decides.

The trees are balanced by an exact histogram of block values (at most 65,536 per
tree, whatever the table's size). A leaf with too many residents or visitors is cut
into a grid of smaller tasks, so no task is unbounded and no pair is lost. A
shard returns a spanning forest of its links, not all pairs; the components follow
from alternating star steps on the links of distinct fingerprints.

Null, empty and white-space texts have fingerprint zero, linked like any other.
Repeated rows share a fingerprint and count once in the search; every row comes
back. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.session import join_sized, settle, ship_package

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
BLOCK_BITS = 16
TREES = 3
LEAVES = 96
LEAF_LEAST = 2_000
SHARD_MOST = 400_000
VISITORS_MOST = 2_000_000
CANDIDATES = 1 << 22
ONE_BIT = np.array([0, *(1 << i for i in range(BLOCK_BITS))], np.uint32)


def bit_majority(text: str) -> int:
    """Fingerprint of one text: majority of each bit over all shingle hashes."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [line[a:b] for a, b in zip(starts.tolist(), ends[SHINGLE_WORDS - 1:].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        octets = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, bits``: the fingerprint as a signed 64-bit integer."""
    ship_package(df.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([bit_majority(t) for t in texts], np.uint64).view(np.int64))

    return df.select(F.col(id).alias("doc_id"),
                     simhash(F.coalesce(F.col(text), F.lit(""))).alias("bits"))


def block(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, BLOCK_BITS * i).bitwiseAND(0xFFFF)


class VantageTree:
    """A vantage-point tree over the 16-bit block values, cut off at leaves of bounded weight."""

    def __init__(self, weights: np.ndarray, most: float, seed: int):
        universe = 1 << BLOCK_BITS
        random = np.random.default_rng(seed)
        self.home = np.zeros(universe, np.int32)
        self.leaves = 0
        visits: list[tuple[np.ndarray, int]] = []
        everything = np.arange(universe, dtype=np.uint32)
        todo = [(everything, everything)]  # values that live below a node, values that query it
        while todo:
            members, visitors = todo.pop()
            split = None
            if weights[members].sum() > most and np.count_nonzero(weights[members]) > 1:
                split = self._split(members, weights, random)
            if split is None:
                self.home[members] = self.leaves
                visits.append((visitors, self.leaves))
                self.leaves += 1
                continue
            vantage, radius = split
            inside = np.bitwise_count(members ^ vantage) <= radius
            away = np.bitwise_count(visitors ^ vantage)
            # Triangle bound: a value within 1 of the query is inside only if the query
            # is within radius + 1, and outside only if the query is beyond radius - 1.
            todo.append((members[inside], visitors[away <= radius + 1]))
            todo.append((members[~inside], visitors[away >= radius]))
        values = np.concatenate([v for v, _ in visits])
        leaf = np.concatenate([np.full(len(v), i, np.int32) for v, i in visits])
        order = np.argsort(values, kind="stable")
        self.visited = leaf[order]
        self.first = np.searchsorted(values[order], np.arange(universe + 1))

    @staticmethod
    def _split(members: np.ndarray, weights: np.ndarray, random) -> tuple | None:
        """The heaviest value or a random one as vantage, the weighted median as radius."""
        heavy = members[np.argmax(weights[members])]
        for vantage in (random.choice(members), heavy):
            away = np.bitwise_count(members ^ vantage)
            mass = np.cumsum(np.bincount(away, weights[members], minlength=BLOCK_BITS + 1))
            radius = int(np.argmin(np.abs(mass - mass[-1] / 2)))
            if 0 < mass[radius] < mass[-1]:
                return vantage, radius
        return None


def grid_of(tree: VantageTree, weights: np.ndarray) -> np.ndarray:
    """Per leaf, the columns its residents are cut into and the rows of its visitors."""
    held = np.bincount(tree.home, weights, minlength=tree.leaves)
    asked = np.bincount(tree.visited, np.repeat(weights, np.diff(tree.first)), minlength=tree.leaves)
    return np.stack([np.ceil(np.maximum(held, 1) / SHARD_MOST),
                     np.ceil(np.maximum(asked, 1) / VISITORS_MOST)], axis=1).astype(np.int64)


def plan_trees(distinct: DataFrame) -> tuple[list[VantageTree], list[np.ndarray]]:
    """One tree per leading block and the grid that each of its leaves is cut into."""
    counts = distinct.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("tree"), block(F.col("bits"), i).alias("value"))
        for i in range(TREES)])).alias("x")).groupBy("x.tree", "x.value").count()
    weights = np.zeros((TREES, 1 << BLOCK_BITS))
    for row in counts.collect():  # at most TREES x 65,536 rows
        weights[row["tree"], row["value"]] = row["count"]
    trees, parts = [], []
    for i in range(TREES):
        tree = VantageTree(weights[i], max(LEAF_LEAST, weights[i].sum() / LEAVES), seed=i)
        trees.append(tree)
        parts.append(grid_of(tree, weights[i]))
    return trees, parts


def route(values: np.ndarray, trees: list[VantageTree], parts: list[np.ndarray]) -> pd.DataFrame:
    """A row per fingerprint, tree and shard that it lives in or visits."""
    out = []
    for number, (tree, cut) in enumerate(zip(trees, parts)):
        own = ((values >> np.uint64(BLOCK_BITS * number)) & np.uint64(0xFFFF)).astype(np.int64)
        first, count = tree.first[own], tree.first[own + 1] - tree.first[own]
        who = np.repeat(np.arange(len(values)), count)
        at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        leaf = tree.visited[at]
        home = leaf == tree.home[own[who]]
        # A large leaf is a grid: residents lie in one column, visitors in one row.
        columns, rows = cut[leaf].T
        spot = (values[who] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        for resident in (True, False):
            here = np.flatnonzero(home) if resident else np.arange(len(who))
            copies = (rows if resident else columns)[here]
            again = np.repeat(here, copies)
            step = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, column = (step, spot[again] % columns[again]) if resident else (
                spot[again] % rows[again], step)
            cell = row * columns[again] + column
            out.append(pd.DataFrame({
                "shard": (np.int64(number) << 48) + (leaf[again].astype(np.int64) << 24) + cell,
                "bits": values[who[again]].view(np.int64), "resident": resident}))
    return pd.concat(out, ignore_index=True)


class Forest:
    """Union-find over positions, with labels that numpy can read at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links that join two trees; the others are already implied."""
        kept = np.zeros(len(a), bool)
        while True:
            ra, rb = self.roots(a), self.roots(b)
            open_ = np.flatnonzero(ra != rb)
            if not len(open_):
                return a[kept], b[kept]
            low, high = np.minimum(ra, rb)[open_], np.maximum(ra, rb)[open_]
            # One link per larger root, so no cycle can arise in a round.
            _, one = np.unique(high, return_index=True)
            self.parent[high[one]] = low[one]
            kept[open_[one]] = True

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent[x]
            self.parent = up


def shard_links(residents: np.ndarray, visitors: np.ndarray, tree: int,
                max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one shard's fingerprints."""
    residents, visitors = np.unique(residents), np.unique(visitors)
    everyone = np.union1d(residents, visitors)
    forest, found = Forest(len(everyone)), []

    def cut(values: np.ndarray, i: int) -> np.ndarray:
        return ((values >> np.uint64(BLOCK_BITS * i)) & np.uint64(0xFFFF)).astype(np.uint32)

    own = cut(visitors, tree)
    present = np.zeros(1 << BLOCK_BITS, bool)
    present[cut(residents, tree)] = True
    for later in range(tree + 1, 64 // BLOCK_BITS):
        key = cut(residents, tree) << np.uint32(BLOCK_BITS) | cut(residents, later)
        order = np.argsort(key, kind="stable")
        key, by_key = key[order], residents[order]
        other = cut(visitors, later)
        for flip in ONE_BIT:
            asks = np.flatnonzero(present[own ^ flip])
            if not len(asks):
                continue
            near = (own[asks] ^ flip) << np.uint32(BLOCK_BITS)
            for flop in ONE_BIT:
                wanted = near | (other[asks] ^ flop)
                first = np.searchsorted(key, wanted)
                hit = np.flatnonzero(key[np.minimum(first, len(key) - 1)] == wanted)
                first = first[hit]
                count = np.searchsorted(key, wanted[hit], "right") - first
                for a, b in runs_of(count, CANDIDATES):
                    c = count[a:b]
                    left = np.repeat(visitors[asks[hit[a:b]]], c)
                    at = np.arange(c.sum()) + np.repeat(first[a:b] - (np.cumsum(c) - c), c)
                    right = by_key[at]
                    good = (left != right) & (np.bitwise_count(left ^ right) <= max_bits)
                    if good.any():
                        x, y = forest.add(np.searchsorted(everyone, left[good]),
                                          np.searchsorted(everyone, right[good]))
                        found.append((everyone[x], everyone[y]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def runs_of(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose counts add up to about ``most``."""
    if not len(counts):
        return
    bins = np.cumsum(counts) // most
    cuts = np.flatnonzero(np.diff(bins)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that span the components of distinct fingerprints (column ``bits``)."""
    if max_bits > MAX_BITS:
        raise ValueError(f"four blocks prove links of up to {MAX_BITS} bits")
    trees, parts = plan_trees(distinct)
    sent = distinct.sparkSession.sparkContext.broadcast((trees, parts))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["bits"].to_numpy(np.int64).view(np.uint64)
            for i in range(0, len(values), 1 << 14):
                yield route(values[i:i + (1 << 14)], *sent.value)

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        values = group["bits"].to_numpy(np.int64).view(np.uint64)
        lives = group["resident"].to_numpy(bool)
        a, b = shard_links(values[lives], values[~lives], int(group["shard"].iloc[0]) >> 48, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (distinct.select("bits")
            .mapInPandas(routed, "shard long, bits long, resident boolean")
            .groupBy("shard").applyInPandas(searched, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all linked nodes by alternating large-star and small-star steps.

    Each step is written to the shared folder. The smallest neighbour of a node is
    an aggregate, reduced before its shuffle, and joins a hub's many edges by a
    broadcast of proven or measured size, or else salted.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    def fresh(e: DataFrame) -> DataFrame:
        return settle(e.filter("a != b").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                           F.sum(F.hash("a", "b").cast("bigint"))).first())

    current, before = fresh(edges.select("a", "b")), None
    while (now := state(current)) != before:
        before, nodes = now, 2 * now[0]
        pairs = current.unionByName(
            current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = join_sized(pairs, least(pairs), "a", small_rows=nodes)
        large = fresh(joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        joined = join_sized(down, least(down), "a", small_rows=nodes)
        current = fresh(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))))
    stars = current.groupBy(F.greatest("a", "b").alias("node")).agg(
        F.min(F.least("a", "b")).alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def owners(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``bits, component_id``: the smallest ``doc_id`` reachable by links, per fingerprint."""
    classes = settle(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    linked = settle(components(links(classes, max_bits)).join(
        classes.withColumnRenamed("bits", "node"), "node"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Most classes have no link; the others take the smallest id of their component.
    shared = join_sized(linked, smallest, "root").select(
        F.col("node").alias("bits"), "component_id")
    return settle(classes.join(shared, "bits", "left").select(
        "bits", F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text",
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, bits, component_id``: the smallest id reachable by links, per row."""
    prints = settle(fingerprints(df, id, text))
    # A fingerprint that many rows share is split by the adaptive skew join.
    return prints.join(owners(prints, max_bits), "bits").select("doc_id", "bits", "component_id")


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` per component: the smallest id, and of that id the smallest text hash.

    Rows are told apart by id and text, so texts that share an id, or have none, are
    decided on one by one. Rows without an id stay only if no row of their component has
    one. Of rows equal in id and text one stays.
    """
    key = F.struct(F.col(id).isNull(), F.col(id), F.unhex(F.sha2(text, 256)))
    keyed = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), key.alias("_key"))
    kept = owners(settle(fingerprints(keyed, "_key", "_text"))).select(
        F.col("component_id").alias("_key")).distinct()
    # The join leaves rows in the order of their keys; the window shuffles and sorts nothing more.
    first = Window.partitionBy("_key").orderBy(F.lit(0))
    stays = keyed.drop("_text").join(kept, "_key", "left_semi")
    return stays.withColumn("_n", F.row_number().over(first)).filter(
        F.col("_n") == 1).select("_row.*")
