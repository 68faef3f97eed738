"""Jaccard join of word n-grams over a token-group matrix.

A document's set holds its distinct five-word shingles (64-bit hashes). Two sets link
if their intersection is at least 80 percent of their union; documents form the
components of those links.

Equal sets are one class. All sets keep their tokens in one order, that of the hashes. If
two sets share ``both`` tokens, their first ``n - both + l`` tokens share at least ``l``,
for any ``l``. So only leading tokens are shuffled, about a quarter of each set, and ``l``
is a twentieth of it: the smaller set of a linked pair must meet that many of its leading
tokens elsewhere. A text that shares but a passage with others falls out here; rounds of
counting go on with the classes that are left.

These form groups: classes that share their rarest leading tokens with the same class; too
large a group is cut. The token-group matrix says which groups hold which leading
token. A class asks the groups that hold enough of its own, counted without the most
frequent ones, for sets of its size and larger ones. There, the whole token union of the
group bounds the overlap with any member: a query with less than eight ninths of its tokens
in the union (what a linked set of its size or larger has) leaves the group unopened. An
opened group compares query and members in full, by the prefix rule in the order of the
group's own frequencies, and skips sets that are linked already. Groups are searched on their
own first; then one class of each component asks for all, and the others only for what is
not linked by then. Any grouping gives the same links; a good one opens few groups.

Null, empty and white-space texts have the empty set, linked with nothing; their
component is their own id. Repeated rows are one class. Null ids are linked like any
others, and a component takes the smallest id that is not null. Very long texts are
hashed in pieces. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlab.llm.simhash import components
from postlab.session import (
    BROADCAST_BYTES, join_sized, measured_bytes, removed, settle, ship_package)

SHINGLE_WORDS = 5
PERCENT = 80
PIECE = 1 << 20
STRETCH = 1 << 21  # tokens that are compared at once
GROUP_TOKENS = 1 << 22
EXTRA = 5  # percent of a set by which its leading tokens exceed what one meeting takes
ROUNDS = 2  # of counting shared tokens
SPREADS = 3  # rounds in which groups grow
GAP = re.compile(rb"[\x20\x09-\x0d]")
# Odd multipliers of the words of a shingle, from a fixed seed.
FACTORS = np.random.default_rng(13).integers(0, 1 << 63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    data, at, found = text.encode().lower(), 0, []
    while at < len(data):
        cut = GAP.search(data, min(at + PIECE, len(data)))
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle are one shingle."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(SHINGLE_WORDS, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, size, np.uint64)
    for i in range(size):
        mixed += words[i:i + count] * FACTORS[i]
    mixed ^= mixed >> np.uint64(31)
    mixed = np.sort(mixed * FACTORS[0])
    return mixed[np.insert(mixed[1:] != mixed[:-1], 0, True)]


def at_least(n, percent: int = PERCENT):
    """Tokens that a set of ``n`` shares with any set it is linked to."""
    return -(-percent * n // 100)


def at_least_larger(n, percent: int = PERCENT):
    """Tokens that a set of ``n`` shares with a linked set of its size or larger."""
    return -(-2 * percent * n // (100 + percent))


def meetings(n):
    """Leading tokens that a set of ``n`` must meet in a linked set of its size or larger."""
    return EXTRA * n // 100 + 1


def read_sets(rows: DataFrame, percent: int) -> DataFrame:
    """``id, row, n, print, lead`` of rows ``id, row, text``: size, digest and leading tokens."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, prints, leads = [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py())
                n = len(tokens)
                sizes.append(n)
                prints.append(xxhash.xxh3_128_digest(tokens.tobytes()) if n else None)
                leads.append(tokens[:n - at_least(n, percent) + meetings(n) if n else 0])
            ends = np.cumsum([0, *map(len, leads)]).astype(np.int32)
            flat = np.concatenate(leads) if leads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                ["id", "row", "n", "print", "lead"])

    schema = T.StructType([rows.schema["id"], rows.schema["row"], T.StructField("n", T.LongType()),
                           T.StructField("print", T.BinaryType()),
                           T.StructField("lead", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(read, schema)


def share(n: Column, percent: int, whole: int) -> Column:
    """``ceil(n * percent / whole)`` in integers."""
    return F.floor((n * percent + (whole - 1)) / whole)


def meetings_column(n: Column) -> Column:
    return F.floor(n * EXTRA / 100) + 1


def shared_tokens(classes: DataFrame, percent: int) -> DataFrame:
    """``token, cls, n, asks``: leading tokens that more than one class has.

    ``asks`` marks the leading tokens of the class as the smaller set of a pair.
    """
    # Size and place travel as one number, as this is the widest shuffle.
    each = classes.select("cls", "n", F.posexplode("lead").alias("at", "token")).select(
        "token", "cls", (F.shiftleft("n", 32) + F.col("at")).alias("packed"))
    beside = Window.partitionBy("token").orderBy("cls")
    both = each.withColumns({
        "_before": F.lag("cls").over(beside), "_after": F.lead("cls").over(beside)}).filter(
            "_before IS NOT NULL OR _after IS NOT NULL")
    n, at = F.shiftright("packed", 32), F.col("packed").bitwiseAND((1 << 32) - 1)
    return both.select("token", "cls", n.alias("n"), (
        at < n - share(n, 2 * percent, 100 + percent) + meetings_column(n)).alias("asks"))


def recounted(shared: DataFrame, percent: int) -> DataFrame:
    """``token, cls, n, asks, df`` of the classes that meet enough tokens of others.

    A class asks on if it meets ``meetings`` tokens as the smaller set of a pair, and answers on if
    it meets as many as the smallest set it can be linked to must.
    """
    n = F.col("n")
    for _ in range(ROUNDS):
        enough = shared.groupBy("cls").agg(
            F.first("n").alias("n"), F.count(F.lit(1)).alias("met"),
            F.count(F.when(F.col("asks"), 1)).alias("asked")).filter(
                F.col("met") >= meetings_column(share(n, percent, 100))).select(
                    "cls", (F.col("asked") >= meetings_column(n)).alias("able"))
        left = settle(shared.join(enough, "cls").select(
            "token", "cls", "n", (F.col("asks") & F.col("able")).alias("asks")))
        frequency = left.groupBy("token").agg(
            F.count(F.lit(1)).alias("df"), F.max("asks").alias("asked")).filter("df > 1 AND asked")
        earlier, shared = shared, settle(left.join(frequency.select("token", "df"), "token"))
        removed(left)
        removed(earlier)
    return shared


def cut(placed: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """Number the slices of each group of ``keys`` that holds too many tokens, by a hash."""
    wide = settle(placed.groupBy(*keys).agg(F.sum("n").alias("held")).filter(F.col("held") > GROUP_TOKENS))
    slices = F.ceil(F.coalesce("held", F.lit(1)) / GROUP_TOKENS)
    return join_sized(placed, wide, keys, "left").withColumn(
        name, F.pmod(F.xxhash64(by), slices)).drop("held")


def grouped(shared: DataFrame) -> DataFrame:
    """``cls, n, group``: classes that share rare leading tokens with one another.

    A class takes the smallest label that it or a class beside it has, over and again. The most
    frequent fifth of a class' tokens spreads no label, so a passage does not. Too large a group
    is cut by the rarest token, which near copies have in common, and what is then still too
    large by class.
    """
    by_frequency = Window.partitionBy("cls").orderBy("df", "token")
    rare = settle(shared.withColumn("rank", F.percent_rank().over(by_frequency)).filter(
        "rank <= 0.8").select("token", "cls"))
    labels = rare.select("cls", F.col("cls").alias("label")).distinct()
    for _ in range(SPREADS):
        by_token = rare.join(labels, "cls").groupBy("token").agg(F.min("label").alias("label"))
        labels = settle(rare.join(by_token, "token").groupBy("cls").agg(F.min("label").alias("label")))
    placed = settle(shared.groupBy("cls").agg(
        F.first("n").alias("n"), F.min(F.struct("df", "token")).alias("first")).join(labels, "cls").select(
            "cls", "n", "label", F.col("first.token").alias("token")))
    parts = cut(cut(placed, ["label"], "token", "part"), ["label", "part"], "cls", "slice")
    # Two groups of one hash would be one group, with the same links.
    return parts.select("cls", "n", F.xxhash64("label", "part", "slice").alias("group"))


def questions(placed: DataFrame, percent: int) -> DataFrame:
    """``cls, n, group``: other groups that may hold a new link to a set of the same size or larger.

    ``placed`` holds shared tokens with their class' group, label and whether it may ask. Half of
    the tokens that must be met may be any, so the most frequent ones are not looked up; the
    other half is counted per group, but for tokens whose holders there all have the label of
    the class, that is, are linked with it already.
    """
    n = F.col("n")
    matrix = placed.groupBy("token", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("label").alias("low"), F.max("label").alias("high"))
    spare = F.floor((meetings_column(n) - 1) / 2)
    by_frequency = Window.partitionBy("cls").orderBy(F.desc("df"), "token")
    asking = placed.filter("asks AND may_ask").withColumn("k", F.row_number().over(by_frequency)).filter(
        F.col("k") > spare).select("token", "cls", "n", "label", F.col("group").alias("own"))
    return asking.join(matrix, "token").filter(
        (F.col("group") != F.col("own")) & (F.col("most") >= n)
        & (percent * F.col("least") <= 100 * n)
        & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))).groupBy(
            "cls", "n", "group").agg(F.count(F.lit(1)).alias("met")).filter(
                F.col("met") >= meetings_column(n) - spare).select("cls", "n", "group")


def bags(rows: DataFrame) -> DataFrame:
    """``cls, tokens`` of rows ``cls, print, text``; a row of another set is left out.

    Repeated rows give a class once per task at most.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = set()
        for batch in batches:
            kept, sets = [], []
            for i, (cls, print_, text) in enumerate(zip(batch.column(0).to_pylist(), *batch.columns[1:])):
                if cls in seen:
                    continue
                tokens = shingle_set(text.as_py())
                if xxhash.xxh3_128_digest(tokens.tobytes()) == print_.as_py():
                    seen.add(cls)
                    kept.append(i)
                    sets.append(tokens)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["cls", "tokens"])

    return rows.select("cls", "print", "text").mapInArrow(read, "cls long, tokens array<long>")


class Sets:
    """Sets of dense token numbers, side by side in one array."""

    def __init__(self, tokens: list[np.ndarray]):
        self.n = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.n) - self.n
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        self.known, self.flat = np.unique(flat, return_inverse=True)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of some sets, and where each set begins."""
        size = self.n[which]
        start = np.cumsum(size) - size
        return self.flat[np.arange(size.sum()) + np.repeat(self.first[which] - start, size)], start


def opened(members: list[np.ndarray], queries: list[np.ndarray], percent: int) -> np.ndarray:
    """Which queries have enough tokens in the union of the members to open their group."""
    union = np.unique(np.concatenate(members))
    sizes = np.array([len(q) for q in queries])
    flat = np.concatenate(queries)
    at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
    inside = np.add.reduceat((union[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return inside >= at_least_larger(sizes, percent)


def group_labels(tokens: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The component of each of some sets, named after one of them, by exact overlaps."""
    label = np.arange(len(tokens))
    if len(tokens) < 2:
        return label
    sets = Sets(tokens)
    owner = np.repeat(np.arange(len(tokens)), sets.n)
    frequency = np.bincount(sets.flat, minlength=len(sets.known))
    order = np.lexsort((sets.flat, frequency[sets.flat], owner))
    ranked, place = sets.flat[order], np.arange(len(owner)) - sets.first[owner]
    shared = frequency[ranked] > 1
    held = shared & (place <= (sets.n - at_least_larger(sets.n, percent))[owner])
    by_token = np.argsort(ranked[held], kind="stable")
    posted, poster = ranked[held][by_token], owner[held][by_token]
    post_first = np.searchsorted(posted, np.arange(len(sets.known) + 1))
    asks = shared & (place <= (sets.n - at_least(sets.n, percent))[owner])
    ask_token, ask_first = ranked[asks], np.searchsorted(owner[asks], np.arange(len(tokens) + 1))

    mark = np.zeros(len(sets.known), bool)
    stale, one = True, np.zeros(0, np.int64)
    some = np.flatnonzero(np.diff(post_first))
    for a in np.argsort(-sets.n, kind="stable").tolist():
        mine = ask_token[ask_first[a]:ask_first[a + 1]]
        mine = mine[post_first[mine] < post_first[mine + 1]]
        if not len(mine):
            continue
        if stale:  # the label that all holders of a token share, or -1
            one = np.full(len(sets.known), -1)
            low = np.minimum.reduceat(label[poster], post_first[some])
            high = np.maximum.reduceat(label[poster], post_first[some])
            one[some] = np.where(low == high, low, -1)
            stale = False
        mine = mine[one[mine] != label[a]]
        if not len(mine):
            continue
        size = post_first[mine + 1] - post_first[mine]
        near = poster[np.arange(size.sum()) + np.repeat(post_first[mine] - (np.cumsum(size) - size), size)]
        fits = (label[near] != label[a]) & (sets.n[near] <= sets.n[a]) & (100 * sets.n[near] >= percent * sets.n[a])
        near = np.unique(near[fits])
        if not len(near):
            continue
        own = sets.flat[sets.first[a]:sets.first[a] + sets.n[a]]
        mark[own] = True
        good = []
        volume = np.cumsum(sets.n[near]) // STRETCH
        for part in np.split(near, np.flatnonzero(np.diff(volume)) + 1):
            flat, start = sets.of(part)
            both = np.add.reduceat(mark[flat].astype(np.int64), start)
            good.append(part[100 * both >= percent * (sets.n[a] + sets.n[part] - both)])
        mark[own] = False
        for b in np.concatenate(good).tolist():
            if label[b] != label[a]:
                label[label == label[b]] = label[a]
                stale = True
    return label


def find_links(visits: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links within each task of ``task, cls, member, tokens``, as stars."""
    def of_task(cls: list[int], member: list[bool], tokens: list[np.ndarray]) -> list[tuple[int, int]]:
        inside = [i for i, m in enumerate(member) if m]
        asking = [i for i, m in enumerate(member) if not m]
        if asking:
            yes = opened([tokens[i] for i in inside], [tokens[i] for i in asking], percent)
            asking = [i for i, y in zip(asking, yes) if y]
        who = inside + asking
        label = group_labels([tokens[i] for i in who], percent).tolist()
        return [(cls[who[a]], cls[who[b]]) for a, b in enumerate(label) if a != b]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen, found = None, ([], [], []), set(), []
        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy()
            ends = lists.offsets.to_numpy()
            for i, (task, cls, member) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if task != now:
                    found += of_task(*held) if held[0] else []
                    now, held, seen = task, ([], [], []), set()
                if cls in seen:  # a repeated row
                    continue
                seen.add(cls)
                held[0].append(cls)
                held[1].append(member)
                held[2].append(flat[ends[i]:ends[i + 1]].copy())
        found += of_task(*held) if held[0] else []
        table = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])

    return (visits.select("task", "cls", "member", "tokens").repartition("task")
            .sortWithinPartitions("task").mapInArrow(search, "a long, b long"))


def visits(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """``task, cls, member``: every asked group in as many tasks as its queries need, members in each."""
    sizes = settle(asked.groupBy("group").agg(F.sum("n").alias("queries")))
    cut = F.ceil(F.col("queries") / GROUP_TOKENS).cast("long")

    def task(part: Column) -> Column:
        return F.xxhash64("group", part).alias("task")

    inside = join_sized(groups, sizes, "group").select(
        "cls", "group", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("part")).select(
            task(F.col("part")), "cls", F.lit(True).alias("member"))
    asking = join_sized(asked, sizes, "group").select(
        task(F.pmod(F.xxhash64("cls"), cut)), "cls", F.lit(False).alias("member"))
    return settle(inside.unionByName(asking))


def searched(whole: DataFrame, plan: DataFrame, percent: int) -> DataFrame:
    """The links of ``plan``'s tasks; ``whole`` has the tokens of its classes."""
    small = F.broadcast(plan) if measured_bytes(plan) <= BROADCAST_BYTES else plan
    return settle(find_links(whole.join(small, "cls"), percent))


def labelled(groups: DataFrame, links: DataFrame, met: DataFrame) -> DataFrame:
    """``cls, group, label, leads``: component of each class; the class that meets most leads it."""
    named = groups.join(links, "cls", "left").join(met, "cls").select(
        "cls", "group", "met", F.coalesce("label", "cls").alias("label"))
    best = named.groupBy("label").agg(F.max(F.struct("met", "cls"))["cls"].alias("first"))
    return named.join(best, "label").select("cls", "group", "label", (F.col("cls") == F.col("first")).alias("leads"))


def links_of(shared: DataFrame, whole: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that span all components of the classes in groups.

    Each group is searched first. Of every component found there one class asks the other
    groups; then the other classes ask, but no group that is linked with them by now.
    """
    many = settle(groups.groupBy("group").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("group"))
    own = join_sized(groups, many, "group", "left_semi").select(
        F.col("group").alias("task"), "cls", F.lit(True).alias("member"))
    links = inside = searched(whole, settle(own), percent)  # stars: a class and its label
    met = settle(shared.groupBy("cls").agg(F.count(F.lit(1)).alias("met")))
    first = settle(labelled(groups, inside.select(F.col("a").alias("cls"), F.col("b").alias("label")), met))
    now = first
    for leaders in (True, False):
        placed = settle(shared.join(now.drop("leads"), "cls").join(first.select(
            "cls", (F.col("leads") == leaders).alias("may_ask")), "cls"))
        asked = settle(questions(placed, percent))
        if not asked.isEmpty():
            links = links.unionByName(searched(whole, visits(groups, asked), percent))
            if leaders:
                linked = components(links).select(F.col("node").alias("cls"), F.col("root").alias("label"))
                now = settle(labelled(groups, linked, met))
    return links


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``df``."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(id).alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("row"),
                     F.col(text).alias("text"))
    read = settle(read_sets(rows, percent))
    sets = settle(read.select("id", "n", "print"))
    led = settle(
        read.filter("n > 0").groupBy("print").agg(
            F.min("id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"),
            F.first("lead").alias("lead"))
        .withColumn("cls", F.monotonically_increasing_id()))
    classes = settle(led.drop("lead", "n"))
    shared = settle(shared_tokens(led, percent))
    # Leading tokens are the bulk of both tables and have done their work.
    removed(read)
    removed(led)
    shared = recounted(shared, percent)
    groups = settle(grouped(shared))
    involved = settle(classes.select("cls", "row", "print").join(groups.select("cls"), "cls", "left_semi"))
    whole = settle(bags(join_sized(rows.select("row", "text"), involved, "row")))
    links = links_of(shared, whole, groups, percent)
    linked = settle(components(links).withColumnRenamed("node", "cls"))
    smallest = join_sized(classes.select("cls", "least"), linked, "cls").groupBy("root").agg(
        F.min("least").alias("component_id"))
    member = join_sized(linked, settle(smallest), "root").select("cls", "component_id")
    owners = settle(classes.select("cls", "print", "least").join(member, "cls", "left").select(
        "print", F.coalesce("component_id", "least").alias("component_id")))
    return join_sized(sets.select("id", "n", "print"), owners, "print", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
