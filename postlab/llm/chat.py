"""Tool calls of conversations: linked to results, ordered, validated, canonical JSON.

Calls and results meet in a hash join on conversation and call identifier. A call
may name the call whose result it uses; its depth is the length of that chain, found
by pointer doubling (a chain of n calls takes log2 n joins), and the rows return in
the order of conversation, depth, turn and identifier, in which every call follows
the one it uses. Arguments are checked against the tool's schema and serialised with
sorted keys and no spare white space.

Calls that share an identifier count once, the earliest turn (then smallest
arguments) stays, and ``copies`` tells how many there were; so do results. A result
without a call is a row of status ``orphan``, a call without a result is
``unanswered``. A parent that is no call counts as none; calls on a cycle have no
depth and come first. Null arguments are invalid; null identifiers are never linked.

Arguments that no strict JSON reader takes are invalid (``$: not JSON``) and written as
``null``: NaN and infinities, numbers beyond a double or over 4,300 digits, repeated keys
of an object, half surrogates, and nesting deeper than ``DEEPEST``. A whole number is an
integer however it is written (``5.0``). A schema with an unknown type is refused at once.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.session import join_sized, settle, ship_package

DEEPEST = 100
KEY = ["conv_id", "call_id"]


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


TYPES = {
    "string": lambda v: isinstance(v, str), "number": _number, "null": lambda v: v is None,
    "integer": lambda v: _number(v) and v == int(v), "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}


def check_schema(schema: dict) -> None:
    """Raise for a type the validator does not know, wherever it stands."""
    if schema.get("type", "null") not in TYPES:
        raise ValueError(f"unknown schema type: {schema['type']!r}")
    below = list(schema.get("properties", {}).values())
    for inner in below + ([schema["items"]] if "items" in schema else []):
        check_schema(inner)


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """Violations of a JSON schema: type, enum, bounds, lengths, required and extra properties."""
    kind = schema.get("type")
    if kind and not TYPES[kind](value):
        return [f"{path}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not allowed")
    if kind in ("integer", "number"):
        if value < schema.get("minimum", -math.inf):
            found.append(f"{path}: too small")
        if value > schema.get("maximum", math.inf):
            found.append(f"{path}: too large")
    if kind == "string" and len(value) < schema.get("minLength", 0):
        found.append(f"{path}: too short")
    if kind == "array":
        for i, x in enumerate(value):
            found += problems(x, schema.get("items", {}), f"{path}[{i}]")
    if kind == "object":
        known = schema.get("properties", {})
        found += [f"{path}.{n}: missing" for n in sorted(schema.get("required", []))
                  if n not in value]
        for name in sorted(value):
            if name in known:
                found += problems(value[name], known[name], f"{path}.{name}")
            elif not schema.get("additionalProperties", True):
                found.append(f"{path}.{name}: unknown")
    return found


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def _refused(text: str):
    raise ValueError(text)


def _unique(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _depth(value) -> int:
    """Nesting of a value, without recursion; stops beyond the limit."""
    level, deep = [value], 0
    while level and deep <= DEEPEST:
        deep += 1
        level = [y for x in level if isinstance(x, (dict, list))
                 for y in (x.values() if isinstance(x, dict) else x)]
    return deep


def strict_json(text: str):
    """The value of a JSON text; ValueError, TypeError or RecursionError if there is none."""
    value = json.loads(text, parse_constant=_refused, parse_float=_finite, object_pairs_hook=_unique)
    if _depth(value) > DEEPEST:
        raise ValueError("too deep")
    canonical(value).encode()  # half surrogates have no bytes
    return value


def checked(name: str | None, arguments: str | None, schemas: dict) -> tuple[str, str]:
    """Errors, joined by ``; ``, and the canonical arguments (``null`` if they cannot be read)."""
    try:
        value = strict_json(arguments)
    except (TypeError, ValueError, RecursionError):
        return "$: not JSON", "null"
    if name not in schemas:
        return "$: unknown tool", canonical(value)
    return "; ".join(problems(value, schemas[name])), canonical(value)


def once(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per identifier, the least in ``order``, with the number of ``copies``."""
    rest = [c for c in df.columns if c not in KEY]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("least")
    return df.groupBy(*KEY).agg(least, F.count(F.lit(1)).alias("copies")).select(
        *KEY, *(F.col(f"least.{c}").alias(c) for c in rest), "copies")


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth``: length of the chain of parents; null on and behind a cycle."""
    ids = calls.select("conv_id", F.col("call_id").alias("up"))
    valid = join_sized(calls.select(*KEY, F.col("parent_id").alias("up")).filter("up IS NOT NULL"),
                       ids, ["conv_id", "up"])
    now = settle(calls.select(*KEY).join(valid.hint("shuffle_merge"), KEY, "left").withColumn(
        "depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    # After k rounds a pointer spans 2^k parents, so what is left after log2 n is a cycle.
    for _ in range(max(now.count(), 1).bit_length()):
        open_ = now.filter("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"),
                           F.col("depth").alias("more"))
        moved = join_sized(open_, above, ["conv_id", "up"]).select(
            *KEY, F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        now = settle(now.filter("up IS NULL").unionByName(moved))
    return now.select(*KEY, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def json_of(column: str) -> Column:
    """A value as JSON, null included."""
    wrapped = F.to_json(F.struct(F.col(column).alias("x")), {"ignoreNullFields": "false"})
    return wrapped.substr(F.lit(6), F.char_length(wrapped) - 6)


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call or orphan result.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), parent_id.
    ``results``: conv_id, call_id, turn, content. ``schemas``: JSON schema per tool.
    """
    ship_package(calls.sparkSession)
    for schema in schemas.values():
        check_schema(schema)
    named = calls.select(*KEY, "turn", "name", "arguments", "parent_id")
    linkable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    single = settle(once(named.filter(linkable), ["turn", "arguments"]))
    answers = once(results.select(*KEY, F.col("turn").alias("result_turn"), "content")
                   .filter(linkable), ["result_turn", "content"])
    # Both sides hold a key once, so no hash table grows with a hot one.
    both = single.join(
        answers.withColumnRenamed("copies", "result_copies").hint("shuffle_hash"), KEY, "full")
    # A few MB of files hold many times that in rows, so no size of files may decide to broadcast.
    placed = both.join(depths(single).hint("shuffle_merge"), KEY, "left")

    @F.pandas_udf("errors string, arguments_json string")
    def validated(names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checked(n, a, schemas) for n, a in zip(names, arguments)],
                            columns=["errors", "arguments_json"])

    rows = placed.withColumn("_v", validated("name", "arguments")).withColumns({
        "status": F.when(F.col("copies").isNull(), "orphan")
        .when(F.col("result_copies").isNull(), "unanswered").otherwise("answered"),
        "errors": F.when(F.col("copies").isNotNull(), F.col("_v.errors"))})
    # Keys in sorted order; the values are canonical themselves.
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce("_v.arguments_json", F.lit("null")),
        F.lit(',"id":'), json_of("call_id"), F.lit(',"name":'), json_of("name"),
        F.lit(',"parent":'), json_of("parent_id"), F.lit(',"result":'), json_of("content"),
        F.lit("}"))
    return rows.withColumn("json", line).select(
        *KEY, "turn", "name", "status", "depth", "copies", "result_copies",
        (F.col("errors") == "").alias("valid"), "errors", "json").orderBy(
            "conv_id", "depth", "turn", "call_id")
