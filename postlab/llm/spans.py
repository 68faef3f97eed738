"""Positions of pattern matches as Columns, and running values along an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab.functions.binding import let

def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running value of a short array; appending copies, so its cost is quadratic."""
    return F.aggregate(
        F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1),
        lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running value of an associative function along an array.

    Blocks of about the square root of the size are run through one by one, then
    every block takes in the total of those before it.
    """
    def blocked(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        count = F.ceil(F.size(a) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: _running(
            F.slice(a, b * width + 1, width), join))

    def joined(blocks: Column) -> Column:
        totals = _running(F.transform(blocks, lambda b: F.element_at(b, -1)), join)
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(
            i == 0, b).otherwise(F.transform(b, lambda x: join(F.get(t, i - 1), x))))))

    return let(values, lambda a: F.when(F.size(a) == 0, a).otherwise(let(blocked(a), joined)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, value>>`` of leftmost non-overlapping matches, in code points.

    The text between matches comes from splitting at the same pattern, so running
    sums of lengths give the positions. A text without a match is not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                             lambda g, h: F.char_length(g) + F.char_length(h))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        return F.zip_with(
            F.zip_with(scan(lengths, lambda a, b: a + b), hits,
                       lambda end, hit: F.struct((end - F.char_length(hit)).alias("start"),
                                                 end.alias("end"))),
            values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                          v.alias("value")))

    return let(found, lambda hits: F.when(F.size(hits) == 0, empty).otherwise(placed(hits)))


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
