"""Delimited text with quoted line breaks, read by all cores from few large files.

Spark's own reader makes each such file one task, as only its start tells which line
breaks lie inside quotes. Here a file is cut into byte ranges as plain text is:

1. Every line says how it ends for both possible starts (outside or inside of quotes),
   and each range composes that for its lines, two bits per line.
2. A prefix scan over the ranges of a file, one small row each, gives every range its
   true start.
3. Ranges put their lines together to records in parallel. Records that cross a cut
   meet in a small shuffle of just their fragments.

Spark's parser then splits the records into columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.session import BROADCAST_BYTES, measured_bytes, settle, ship_package

OUTSIDE, INSIDE = 0, 1
# How a line ends: bit 0 if it starts outside of quotes, bit 1 if inside.
TO_OUTSIDE, SWAP, SAME, TO_INSIDE = 0, 1, 2, 3

# Inside a line: in quotes, after a quote in quotes, where a field starts, in a plain field.
QUOTED, CLOSING, FIELD, PLAIN = 1, 2, 3, 4

RANGE = ["file", "block"]
RANGES = "file string, block bigint, from_outside int, from_inside int, closes boolean"
RECORDS = "file string, block bigint, place string, first boolean, record string"


def line_code(line: Column, sep: str) -> Column:
    """How a line ends, for both starts. A quote opens a field only where the field starts."""
    before_quotes = F.split(line, '"', -1)

    def step(mode: Column, piece: Column) -> Column:
        at = (F.when((mode == QUOTED) | (piece == ""), mode)
              .when(F.endswith(piece, F.lit(sep)), FIELD).otherwise(PLAIN))
        return (F.when(at == QUOTED, CLOSING).when(at == PLAIN, PLAIN)
                .otherwise(QUOTED))

    def end(start: int) -> Column:
        quotes = F.slice(before_quotes, F.lit(1), F.size(before_quotes) - 1)
        mode = F.aggregate(quotes, F.lit(start), step)
        return F.when(mode == QUOTED, INSIDE).otherwise(OUTSIDE)

    return (F.when(~F.contains(line, F.lit('"')), SAME)
            .otherwise(end(FIELD) + 2 * end(QUOTED)).cast("int"))


def line_ends(codes: np.ndarray, start: int) -> np.ndarray:
    """The state after each line of a run that starts in ``start``."""
    fixed = (codes == TO_OUTSIDE) | (codes == TO_INSIDE)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(codes)), -1))
    swaps = np.concatenate([[0], np.cumsum(codes == SWAP)])
    base = np.where(last >= 0, codes[last] == TO_INSIDE, start)
    return (base + swaps[1:] - np.where(last >= 0, swaps[last + 1], 0)) % 2


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple[str, int], slice]]:
    """Rows of one range are neighbours."""
    if batch.empty:
        return
    block, file = batch["block"].to_numpy(), batch["file"].to_numpy()
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(batch)]):
        yield (file[a], int(block[a])), slice(a, b)


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ranges: dict[tuple[str, int], tuple[int, int, bool]] = {}
    for batch in batches:
        codes = batch["code"].to_numpy()
        for key, rows in _runs(batch):
            outside, inside, closes = ranges.get(key, (OUTSIDE, INSIDE, False))
            ends = line_ends(codes[rows], inside)
            ranges[key] = (int(line_ends(codes[rows], outside)[-1]), int(ends[-1]),
                           closes or bool((ends == OUTSIDE).any()))
    yield pd.DataFrame([(*k, *v) for k, v in ranges.items()],
                       columns=["file", "block", "from_outside", "from_inside", "closes"])


def range_starts(ranges: DataFrame) -> DataFrame:
    """``file, block, start, opens, owner``: the true start of each range.

    ``opens`` says that a record begins in the range and goes on behind it; ``owner`` is the
    range in which the record begins that a range which starts inside of quotes goes on with.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("from_outside") == F.col("from_inside")
    swap = (F.col("from_outside") > F.col("from_inside")).cast("int")
    counted = ranges.withColumn("swaps", F.sum(swap).over(upto))
    known = F.last(F.when(fixed, F.struct("from_outside", "swaps")), True).over(before)
    told = (counted.withColumns({"known": known, "seen": F.coalesce(
                F.sum(swap).over(before), F.lit(0))})
            .withColumn("start", F.pmod(
                F.coalesce("known.from_outside", F.lit(OUTSIDE)) + F.col("seen")
                - F.coalesce("known.swaps", F.lit(0)), F.lit(2)).cast("int")))
    ends = F.when(F.col("start") == OUTSIDE, F.col("from_outside")).otherwise(F.col("from_inside"))
    opens = (ends == INSIDE) & ((F.col("start") == OUTSIDE) | F.col("closes"))
    return (told.withColumn("opens", opens)
            .withColumn("owner", F.last(F.when(F.col("opens"), F.col("block")), True).over(before))
            .select(*RANGE, "start", "opens", "owner"))


def _glue(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
    """Whole records of each range, or else its fragments of records that cross a cut."""
    key, pending, state, head, first = None, [], OUTSIDE, False, False

    def fragment() -> list[tuple]:
        if whole or not pending:
            return []
        place = "head" if head else "tail"
        return [(*key, place, first, "\n".join(pending))]

    for batch in batches:
        out: list[tuple] = []
        starts, codes = batch["start"].to_numpy(), batch["code"].to_numpy()
        for found, rows in _runs(batch):
            if found != key:
                out += fragment()
                key, pending, state = found, [], int(starts[rows.start])
                head, first = state == INSIDE, found[1] == 0
            lines = batch["line"].iloc[rows].tolist()
            ends = line_ends(codes[rows], state)
            at = 0
            for to in np.flatnonzero(ends == OUTSIDE) + 1:
                record = "\n".join([*pending, *lines[at:to]])
                if head == (not whole):
                    out.append((*key, "head" if head else "record", first, record))
                pending, at, head, first = [], to, False, False
            pending += lines[at:]
            state = int(ends[-1])
        yield pd.DataFrame(out, columns=["file", "block", "place", "first", "record"])
    yield pd.DataFrame(fragment(), columns=["file", "block", "place", "first", "record"])


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """``record, first``: raw records, ``first`` for the one a file starts with.

    None if the ranges are too many for their starts to be broadcast.
    """
    ship_package(spark)
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line")).withColumn("code", line_code(F.col("line"), sep))
    ranges = settle(lines.select(*RANGE, "code").mapInPandas(_compose, RANGES))
    starts = settle(range_starts(ranges))
    if measured_bytes(starts) > BROADCAST_BYTES:
        return None
    # A broadcast keeps the order of lines. Cuts that moved between the passes would be an error.
    placed = lines.join(F.broadcast(starts), RANGE, "left").withColumn("start", F.coalesce(
        "start", F.raise_error(F.lit("a file was cut differently in two passes")).cast("int")))
    columns = [*RANGE, "line", "start", "code"]
    whole = placed.select(*columns).mapInPandas(lambda it: _glue(it, True), RECORDS)
    crossing = (placed.filter(F.col("opens") | (F.col("start") == INSIDE)).select(*columns)
                .mapInPandas(lambda it: _glue(it, False), RECORDS)
                .join(F.broadcast(starts), RANGE))
    begun = F.when(F.col("place") == "head", F.col("owner")).otherwise(F.col("block"))
    part = F.struct("block", "record", "first")
    # One group is one record.
    joined = (crossing.withColumn("begun", begun).groupBy("file", "begun")
              .agg(F.array_sort(F.collect_list(part)).alias("parts"))
              .select(F.array_join("parts.record", "\n").alias("record"),
                      F.col("parts")[0]["first"].alias("first")))
    return whole.select("record", "first").unionByName(joined)


def parse_records(records: DataFrame, names: list[str], options: dict[str, str],
                  header: bool) -> DataFrame:
    """Records as string columns; a header that names other columns is an error."""
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    ddl = ", ".join(f"{q} string" for q in quoted)
    text = F.regexp_replace("record", r"\r\z", "")
    kept = records.withColumn("record", text).filter(F.col("record") != "")
    if header:
        own = F.from_csv("record", F.lit(", ".join(f"c{i} string" for i in range(len(names) + 1))),
                         options)
        same = F.lit(True)
        for i, name in enumerate(names):
            field = own[f"c{i}"]
            same = same & (F.lower(field).eqNullSafe(name.lower())
                           | ((field.isNull() | (field == "")) & F.lit(name == f"_c{i}")))
        same = same & own[f"c{len(names)}"].isNull()
        refuse = F.raise_error(F.concat(F.lit("another header: "), "record")).cast("boolean")
        kept = kept.filter(F.when(~F.col("first"), True).when(same, False).otherwise(refuse))
    return kept.select(F.from_csv("record", F.lit(ddl), options).alias("r")).select(
        *[F.col("r")[n].alias(n) for n in names])
