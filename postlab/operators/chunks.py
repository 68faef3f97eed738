"""Look-ups in tables too large to travel with the plan, a chunk of rows at a time.

Rows get a number and fall into chunks of about ``CHUNK_BYTES`` of text. Each chunk asks for its
distinct terms once, whatever their number of occurrences; the table answers by a plain join, in
which a term has at most one row per chunk, so no term is hot and nothing is broadcast. Rows and
answers of a chunk then meet in one group of bounded size, and every row looks its terms up there.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.session import settle, ship_package

ROW, CHUNK, LIST, TERM, VALUE = "_row", "_chunk", "_list", "_term", "_value"
CHUNK_BYTES = 8 * 1024 * 1024
MOST_BITS = 14  # rows of a chunk, as a power of two


def chunked(df: DataFrame, width: Column) -> DataFrame:
    """``df`` written once, with the chunk of each row; ``width`` is about the bytes of a row.

    Numbers of a partition start at a multiple of 2^33, so a chunk lies inside a partition.
    """
    rows = settle(df.withColumn(ROW, F.monotonically_increasing_id()))
    mean = rows.agg(F.avg(width)).first()[0] or 1.0
    bits = min(max(int(CHUNK_BYTES / max(mean, 1.0)), 1).bit_length() - 1, MOST_BITS)
    return rows.withColumn(CHUNK, F.shiftright(ROW, bits)).drop(ROW)


def answers(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``chunk, term, value`` of the asked ``chunk, term`` rows that the table knows."""
    return asked.distinct().join(table.hint("shuffle_merge"), TERM).select(CHUNK, TERM, VALUE)


def with_answers(rows: DataFrame, known: DataFrame, prepare: Callable[[DataFrame], DataFrame],
                 work: Callable[[pa.Table, dict], pa.Table], schema: T.StructType) -> DataFrame:
    """``work(rows, {term: value})`` per chunk; ``prepare`` adds columns after the shuffle."""
    ship_package(rows.sparkSession)
    dealt = prepare(rows.repartition(CHUNK).sortWithinPartitions(CHUNK))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, dict(zip(right[TERM].to_pylist(), right[VALUE].to_pylist())))

    return dealt.groupBy(CHUNK).cogroup(known.groupBy(CHUNK)).applyInArrow(meet, schema)


def mapped(df: DataFrame, terms: Column, table: DataFrame, value: Column, output: str) -> DataFrame:
    """``df`` with ``output``: the values of a list of terms in order, NULL for unknown ones.

    ``table`` has distinct, non-null terms in its column ``term``. A NULL list stays NULL.
    """
    listed = df.withColumn(LIST, terms)
    rows = chunked(listed, F.coalesce(F.octet_length(F.array_join(LIST, " ")), F.lit(0)))
    own = F.explode(F.array_distinct(LIST))
    known = settle(answers(rows.select(CHUNK, own.alias(TERM)),
                           table.select(F.col("term").alias(TERM), value.alias(VALUE))))
    kind = T.ArrayType(known.schema[VALUE].dataType)
    schema = T.StructType([*df.schema.fields, T.StructField(output, kind)])
    names = df.columns

    def work(left: pa.Table, look: dict) -> pa.Table:
        lists = (x.as_py() for x in left[LIST])
        found = [None if x is None else [look.get(t) for t in x] for x in lists]
        return left.select(names).append_column(output, right_type(found, kind))

    return with_answers(rows, known, lambda x: x, work, schema)


def right_type(values: list, kind: T.DataType) -> pa.Array:
    """Python values as an Arrow column of a Spark type."""
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array(values, to_arrow_type(kind))
