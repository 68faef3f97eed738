"""Whole-word lexicon matching on one text, as Column expressions.

A text is cut into alternating word and non-word pieces. A term is a run of such
pieces that starts and ends with a word, so "equal run of lower-cased pieces" is
the same as a case-insensitive whole-word match of the escaped term. Matches are
taken from left to right, the longest term first, without overlaps.

The terms are known by their prefixes: every run of pieces that begins a term and ends with
a word, with a ``kind`` that says whether it is a term (``WHOLE``) and whether a longer term
begins with it (``MORE``). A run grows piece by piece only while its prefix is known, so
the work follows the hits, whatever the number and length of the terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.binding import let
from postlab.functions.tokens import words

PIECE_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
WHOLE, MORE = 1, 2
PLACE = "array<struct<start:int,length:int,term:string>>"
BLOCK = 64

Look = Callable[[Column], Column]


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE_PATTERN), F.lit(0))


def prefixes(terms: DataFrame) -> DataFrame:
    """``run, length, kind``: the word-ended prefixes of all terms, lengths in pieces."""
    def of_term(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(2)), lambda n: F.struct(
            F.array_join(F.slice(parts, 1, n), "").alias("run"), n.alias("length"),
            F.when(n == F.size(parts), WHOLE).otherwise(MORE).alias("kind")))

    each = terms.select(F.explode(let(pieces(F.col("term")), of_term)).alias("p")).select("p.*")
    return each.groupBy("run", "length").agg(F.bit_or("kind").alias("kind"))


def is_whole(kind: Column) -> Column:
    return kind.bitwiseAND(WHOLE) > 0


def has_more(kind: Column) -> Column:
    return kind.bitwiseAND(MORE) > 0


def single_words(text: Column, look: Look) -> Column:
    """The words of a text that are terms, in order; for terms of one word."""
    return F.filter(words(F.lower(text)), lambda word: look(word).isNotNull())


def places(text: Column, look: Look, longest: int) -> Column:
    """Array of ``(start, length, term)``: every occurrence of a term, in pieces, by start.

    ``look`` gives the kind of a prefix or NULL; ``longest`` is the length of the longest term.
    """
    def grown(parts: Column, i: Column) -> Column:
        nothing = F.array().cast(PLACE)

        def step(state: Column, piece: Column) -> Column:
            def counted(run: Column) -> Column:
                n = state["n"] + 1
                ends = n % 2 == 1  # runs that end with a word; the others just go on
                return let(F.when(ends, F.coalesce(look(run), F.lit(0))).otherwise(MORE), lambda kind: F.struct(
                    run.alias("run"), n.alias("n"), kind.alias("kind"),
                    F.when(ends & is_whole(kind), F.concat(state["found"], F.array(F.struct(
                        i.cast("int").alias("start"), n.alias("length"), run.alias("term"))))).otherwise(
                            state["found"]).alias("found")))

            return F.when(has_more(state["kind"]), let(
                F.concat(state["run"], piece), counted)).otherwise(state)

        start = F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), F.lit(MORE).alias("kind"),
                         nothing.alias("found"))
        return F.aggregate(F.slice(parts, i + 1, longest), start, step, lambda state: state["found"])

    return let(pieces(text), lambda parts: F.flatten(F.filter(
        F.transform(parts, lambda word, i: F.when(look(word).isNotNull(), grown(parts, i))),
        lambda found: found.isNotNull())))


def longest_first(found: Column) -> Column:
    """Of the occurrences at one start the longest; ``found`` has them by start and length."""
    return F.filter(found, lambda x, i: ~F.coalesce(
        F.get(found, i + 1)["start"] == x["start"], F.lit(False)))


def without_overlaps(found: Column) -> Column:
    """Terms of ``(start, length, term)`` in start order, overlaps dropped.

    Blocks of occurrences are settled one after the other, so an occurrence is copied with
    its block and once per later block, not once per later occurrence.
    """
    kept = "array<string>"

    def settle(state: Column, x: Column) -> Column:
        return F.when(x["start"] >= state["free"], F.struct(
            (x["start"] + x["length"]).alias("free"),
            F.concat(state["hits"], F.array(x["term"])).alias("hits"))).otherwise(state)

    def block(state: Column, one: Column) -> Column:
        inner = F.aggregate(one, F.struct(state["free"].alias("free"), F.array().cast(kept).alias("hits")), settle)
        return let(inner, lambda done: F.struct(
            done["free"].alias("free"), F.concat(state["hits"], done["hits"]).alias("hits")))

    def in_blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int"))
        cut = F.transform(starts, lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))
        first = F.struct(F.lit(0).alias("free"), F.array().cast(kept).alias("hits"))
        return F.aggregate(cut, first, block, lambda state: state["hits"])

    return let(found, in_blocks)


def normalise_terms(terms: list[str]) -> dict[int, list[str]]:
    """Lower-cased distinct terms, grouped by their number of pieces."""
    grouped: dict[int, list[str]] = {}
    for term in sorted({t.lower() for t in terms}):
        parts = re.findall(r"\w+|\W+", term)
        if not parts or not re.match(r"\w", parts[0]) or not re.match(r"\w", parts[-1]):
            raise ValueError(f"a term must start and end with a word character: {term!r}")
        grouped.setdefault(len(parts), []).append(term)
    return grouped


def _literal_look(grouped: dict[int, list[str]]) -> Look:
    """Kinds of a short term list, as literals of the plan."""
    kinds: dict[str, int] = {}
    for terms in grouped.values():
        for term in terms:
            parts = re.findall(r"\w+|\W+", term)
            for n in range(1, len(parts) + 1, 2):
                run = "".join(parts[:n])
                kinds[run] = kinds.get(run, 0) | (WHOLE if n == len(parts) else MORE)
    sets = {kind: [r for r, k in kinds.items() if k == kind] for kind in (WHOLE, MORE, WHOLE | MORE)}

    def look(run: Column) -> Column:
        out = F.lit(None).cast("int")
        for kind, runs in sets.items():
            if runs:
                out = F.when(run.isin(runs), kind).otherwise(out)
        return out

    return look


def hits_of(text: Column, look: Look, longest: int) -> Column:
    """All hits in a text, in text order; no text, no hits."""
    if longest <= 1:
        hits = single_words(text, look)
    else:
        hits = let(places(text, look, longest), lambda found: without_overlaps(longest_first(found)))
    return F.coalesce(hits, F.array().cast("array<string>"))


def term_hits(text: Column, terms: list[str]) -> Column:
    """All hits of a short term list in a text, in text order; no text, no hits.

    The terms become literals of the plan; lexicon frames go through ``operators.lexicon``.
    """
    grouped = normalise_terms(terms)
    return hits_of(text, _literal_look(grouped), max(grouped, default=1))


def has_lexicon_term(text: Column, terms: list[str]) -> Column:
    return F.when(F.size(term_hits(text, terms)) > 0, 1).otherwise(0)


def count_lexicon_terms(text: Column, terms: list[str]) -> Column:
    return F.size(term_hits(text, terms))
