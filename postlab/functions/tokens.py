"""Token functions: ``Column -> Column`` over texts and token arrays.

Tokenising contract (one pattern, first alternative wins): a URL, a hashtag, a
word that may carry inner apostrophes or hyphens, a number that may carry inner
``. , : /``, else any single non-space character. Handles are removed first and
runs of three or more equal characters are cut to three.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab.functions.stopwords import SPANISH
from postlab.functions.text import strip_accents

WORD_PATTERN = r"[\p{L}\p{N}_]+"
HANDLE_PATTERN = r"@(?<![A-Za-z0-9_!@#$%&*]@)[A-Za-z0-9_]+"
# Possessive repeats never back up, so a token of any length needs no stack.
TOKEN_PATTERN = "|".join([
    r"https?://[a-z!$-_]+",
    r"#[\p{L}\p{N}_]+",
    r"[\p{L}_][\p{L}\p{N}_]*+(?:['\-][\p{L}\p{N}_]++)*+",
    r"\p{N}++(?:[.,:/]\p{N}++)*+",
    r"[^\s]",
])

# A literal map is searched linearly per hit, so it is kept small; larger
# dictionaries go through ``operators.tables.replace_tokens_join``.
MAX_LITERAL_DICTIONARY = 500


def words(text: Column) -> Column:
    """All ``\\w+`` runs, Unicode aware."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def filter_stopwords(tokens: Column, stops: list[str] | None = None) -> Column:
    """Drop stop words, case-sensitively and without touching repeats."""
    stops = SPANISH if stops is None else stops
    return F.filter(tokens, lambda t: ~t.isin(stops))


def raw_tokens(text: Column) -> Column:
    bare = F.regexp_replace(strip_accents(text), HANDLE_PATTERN, " ")
    short = F.regexp_replace(bare, r"(.)\1{2,}", "$1$1$1")
    return F.regexp_extract_all(short, F.lit(TOKEN_PATTERN), F.lit(0))


def tokenize(text: Column, stops: list[str] | None = None) -> Column:
    return filter_stopwords(raw_tokens(text), stops)


def replace_tokens(tokens: Column, dictionary: dict[str, str]) -> Column:
    """Exact token -> replacement, order and other tokens kept."""
    if not dictionary:
        return tokens
    if len(dictionary) > MAX_LITERAL_DICTIONARY:
        raise ValueError("large dictionary: use operators.tables.replace_tokens_join or "
                         "operators.tables.tokenize_for_lexicon")
    mapping = F.create_map(*[F.lit(x) for pair in dictionary.items() for x in pair])
    known = list(dictionary)
    return F.transform(
        tokens, lambda t: F.when(t.isin(known), F.element_at(mapping, t)).otherwise(t))


def drop_noise_tokens(tokens: Column) -> Column:
    """Remove tokens that contain ``u00``, have length one or are all digits."""
    def digits(t: Column) -> Column:
        # Most tokens start with an ASCII letter and need no pattern.
        return ~(((t >= "a") & (t < "{")) | ((t >= "A") & (t < "["))) & t.rlike(r"^\p{Nd}+$")

    return F.filter(tokens, lambda t: ~(
        F.contains(t, F.lit("u00")) | (F.char_length(t) == 1) | digits(t)))


def tokenize_for_lexicon(text: Column, dictionary: dict[str, str],
                         stops: list[str] | None = None) -> Column:
    """Right-trim, tokenise, drop stop words, expand slang, drop noise."""
    trimmed = F.regexp_replace(text, r"\s+$", "")
    return drop_noise_tokens(replace_tokens(tokenize(trimmed, stops), dictionary))


def each_token(tokens: str) -> Column:
    """``explode`` for a column that was expensive to compute.

    Exploding a bare column makes the optimizer add a "not empty" filter, push it
    below the projection and compute the tokens twice; an expression is left alone.
    """
    return F.explode(F.coalesce(tokens, F.array()))


def intersect_tokens(tokens: Column, terms: list[str]) -> Column:
    """Distinct tokens of a post that are in a term list."""
    return F.filter(F.array_distinct(tokens), lambda t: t.isin(terms))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")
