"""Credentials in texts, and weak parts of credentials linked within a scope.

Strong spans are reported alone: ``assign`` (a named value), ``access`` (access key
identifier), ``hex`` (long hexadecimal run). Weak candidates are ``ident`` (a named
account or key identifier), ``bare`` (a long unnamed mix of letters and digits) and
``endpoint`` (a URL or a named host). A candidate counts only if complementary parts
lie within ``SCOPE`` code points of it: an identifier needs a secret, a bare secret
needs an identifier, an endpoint needs both.

All parts of a text are ordered by position. The interval join with the nearest
part of a role to the left is a running maximum of ends, to the right a running
minimum of starts, so n parts are never paired with one another. It runs only where
a text has a weak candidate.

Only DataFrame functions; one projection, no shuffle. Null text is empty and has no
spans. Rows are independent, so repeated rows give repeated results. Other columns
are kept; one named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.binding import let
from postlab.llm.spans import matches, scan

SCOPE = 256
KINDS = ["assign", "access", "hex", "ident", "bare", "endpoint"]

# The patterns of the three strong kinds. The last repeats cannot back up.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]++)""")
ACCESS = r"AKIA[A-Z0-9]{12,}+"  # a run of 16 or more starts where any longer one does
HEX = r"[0-9a-f]{32,}+"
ASSIGN_LEAST = 8

IDENT = (r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|user_?id|login)["']?"""
         r"""\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,}+)""")
BARE = r"[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = (r"""(?i:(?:https?|ftp|jdbc:[a-z0-9]{1,20}|postgres|mysql|redis|amqp)://"""
            r"""[A-Za-z0-9._~:/?#@!$&()*+;=%-]++|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?"""
            r"""[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)""")

IDENTIFIER, SECRET, PLACE = 1, 2, 3
ROLES = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "ident": IDENTIFIER,
         "bare": SECRET, "endpoint": PLACE}
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,role:int>>"


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"),
        F.lit(kind).alias("kind"), F.lit(ROLES[kind]).alias("role")))


def strong_spans(text: Column) -> Column:
    """The spans that count alone, by start and then kind."""
    assign = F.filter(matches(text, ASSIGN, 1), lambda m: F.char_length(m["value"]) >= ASSIGN_LEAST)
    return F.sort_array(F.concat(
        _of_kind(assign, "assign"), _of_kind(matches(text, ACCESS), "access"),
        _of_kind(matches(text, HEX), "hex")))


def _nearest(parts: Column, wanted) -> Column:
    """Per part, the end of the last wanted part before it and the start of the first after it."""
    def before(p: Column) -> Column:
        ends = F.transform(p, lambda x: F.when(wanted(x), x["end"]).otherwise(F.lit(-2 ** 30)))
        return scan(F.concat(F.array(F.lit(-2 ** 30)), F.slice(ends, F.lit(1), F.size(p) - 1)),
                    lambda a, b: F.greatest(a, b))

    def after(p: Column) -> Column:
        starts = F.reverse(F.transform(
            p, lambda x: F.when(wanted(x), x["start"]).otherwise(F.lit(2 ** 30))))
        return F.reverse(scan(
            F.concat(F.array(F.lit(2 ** 30)), F.slice(starts, F.lit(1), F.size(p) - 1)),
            lambda a, b: F.least(a, b)))

    return let(parts, lambda p: F.zip_with(before(p), after(p), lambda b, a: F.struct(
        b.alias("end"), a.alias("start"))))


def _within(parts: Column, wanted, distance: int) -> Column:
    """Per part, whether a wanted part begins or ends within a distance of it."""
    return let(parts, lambda p: F.zip_with(p, _nearest(p, wanted), lambda x, n: (
        (x["start"] - n["end"] <= distance) | (n["start"] - x["end"] <= distance))))


def weak_parts(text: Column, strong: Column) -> Column:
    """Candidates that overlap no strong span; a bare secret mixes letters and digits."""
    bare = F.filter(matches(text, BARE), lambda m: m["value"].rlike("[0-9]")
                    & m["value"].rlike("[A-Za-z]"))
    named = F.filter(matches(text, IDENT, 1), lambda m: F.char_length(m["value"]) > 0)
    weak = F.concat(_of_kind(named, "ident"), _of_kind(bare, "bare"),
                    _of_kind(matches(text, ENDPOINT), "endpoint"))

    def free(parts: Column) -> Column:
        covered = _within(parts, lambda x: x["rank"] < 3, -1)
        marked = F.zip_with(parts, covered, lambda x, c: F.struct(
            x.alias("part"), c.alias("covered")))
        return F.transform(F.filter(marked, lambda z: (z["part"]["rank"] >= 3) & ~z["covered"]),
                           lambda z: z["part"])

    return let(weak, lambda w: F.when(F.size(w) == 0, w).otherwise(
        let(F.sort_array(F.concat(strong, w)), free)))


def linked(strong: Column, weak: Column, scope: int = SCOPE) -> Column:
    """Strong spans and those weak ones that complementary parts in scope confirm."""
    def confirmed(parts: Column) -> Column:
        sides = F.zip_with(
            _within(parts, lambda x: x["role"] == IDENTIFIER, scope),
            _within(parts, lambda x: x["role"] == SECRET, scope),
            lambda i, s: F.struct(i.alias("identifier"), s.alias("secret")))
        near = F.zip_with(parts, sides, lambda x, n: F.struct(
            x.alias("part"), n["identifier"].alias("identifier"), n["secret"].alias("secret")))
        kept = F.filter(near, lambda z: (
            (z["part"]["rank"] < 3)
            | ((z["part"]["kind"] == "ident") & z["secret"])
            | ((z["part"]["kind"] == "bare") & z["identifier"])
            | ((z["part"]["kind"] == "endpoint") & z["identifier"] & z["secret"])))
        return F.transform(kept, lambda z: z["part"])

    return F.when(F.size(weak) == 0, strong).otherwise(
        let(F.sort_array(F.concat(strong, weak)), confirmed))


def find_secrets(df: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Append ``strong`` and ``secrets``: arrays of ``start, rank, end, kind, role``."""
    content = F.coalesce(F.col(text), F.lit(""))
    return (df.withColumn("strong", strong_spans(content).cast(SPAN))
            .withColumn("secrets", let(weak_parts(content, F.col("strong")), lambda w: linked(
                F.col("strong"), w, scope)).cast(SPAN)))
