"""Projections, filters, casts, joins and set operations on post tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.functions.dictionary import TABLE_BYTES, Dictionary, fits
from postlab.functions.tokens import drop_noise_tokens, each_token, tokenize
from postlab.operators.chunks import mapped
from postlab.session import settle

# Label names and their codes.
TASK1_CODES = {"non-sexist": 0, "sexist": 1}
TASK2_CODES = {
    "non-sexist": 0,
    "ideological-inequality": 1,
    "stereotyping-dominance": 2,
    "objectification": 3,
    "sexual-violence": 4,
    "misogyny-non-sexual-violence": 5,
}
AUX_CLASSES = {"NO_MACHISTA": "non-sexist", "MACHISTA": "sexist"}
DOUBTFUL = "DUDOSO"
NO_LABEL = -1

TYPE_FAMILIES = {
    "number": T.NumericType,
    "category": (T.StringType, T.BooleanType),
}


def filter_language(df: DataFrame, language: str | None) -> DataFrame:
    """One language; every row when none (or ``both``) is named."""
    return df if language in (None, False, "both") else df.filter(F.col("language") == language)


def languages(df: DataFrame) -> list[str]:
    """The languages that occur, in order: one row each."""
    return [r.language for r in df.select("language").dropna().distinct()
            .orderBy("language").collect()]


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*columns)


def select_type(df: DataFrame, family: str) -> DataFrame:
    """All columns of one type family, ``number`` or ``category``."""
    kinds = TYPE_FAMILIES[family]
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, kinds)])


def change_dtypes(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def map_values(column: Column, mapping: dict) -> Column:
    """Dictionary lookup; values outside the dictionary become NULL."""
    branches = F.lit(None)
    for key, value in mapping.items():
        branches = F.when(column == key, F.lit(value)).otherwise(branches)
    return branches


def encode_labels(df: DataFrame, task1: dict[str, int] = TASK1_CODES,
                  task2: dict[str, int] = TASK2_CODES) -> DataFrame:
    return df.withColumns({
        "task1": map_values(F.col("task1"), task1).cast("int"),
        "task2": map_values(F.col("task2"), task2).cast("int"),
    })


def decode_labels(df: DataFrame, prediction: str, codes: dict[str, int],
                  category: str = "category") -> DataFrame:
    names = {code: name for name, code in codes.items()}
    return df.withColumn(category, map_values(F.col(prediction), names))


def align_aux_schema(df: DataFrame, test_case: str, classes: dict = AUX_CLASSES,
                     encoded: bool = False) -> DataFrame:
    """Auxiliary rows in the column order of posts.

    They carry no second label: NULL beside string labels, -1 beside codes.
    """
    return df.select(
        F.lit(test_case).alias("test_case"),
        F.col("status_id").alias("id"),
        F.lit("twitter").alias("source"),
        F.lit("es").alias("language"),
        "text",
        map_values(F.col("categoria"), classes).alias("task1"),
        (F.lit(NO_LABEL) if encoded else F.lit(None).cast("string")).alias("task2"),
    )


def drop_class(df: DataFrame, column: str, value: str = DOUBTFUL) -> DataFrame:
    """Remove one class; rows without a class stay."""
    return df.filter(~F.col(column).eqNullSafe(value))


def merge_class(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def presence_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``{flag: column}``: 'si' where the column has a value, else 'no'."""
    return df.withColumns({
        flag: F.when(F.col(c).isNull(), "no").otherwise("si") for flag, c in flags.items()})


def preview(df: DataFrame, key: str = "id", n: int = 5) -> DataFrame:
    """First ``n`` rows by key, each with the shape of the whole frame."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (df.orderBy(key).limit(n)
              .withColumns({"n_rows": rows, "n_columns": F.lit(len(df.columns)).cast("bigint")}))


def join_labels(texts: DataFrame, labels: DataFrame, key: str = "status_id") -> DataFrame:
    return texts.join(labels, key, "inner")


def attach_predictions(posts: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Predictions joined back by id; every post must have been scored to appear."""
    return posts.join(predictions, key, "inner")


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name (auxiliary rows, per-language results)."""
    return reduce(DataFrame.unionByName, others, first)


def union_terms(*lexicons: DataFrame, column: str = "term") -> DataFrame:
    """Set union of the term columns."""
    return append_rows(*[x.select(column) for x in lexicons]).distinct()


def replace_tokens_join(df: DataFrame, dictionary: DataFrame, key: str = "id",
                        tokens: str = "tokens", limit: int = TABLE_BYTES) -> DataFrame:
    """Token replacement from a dictionary frame ``(term, replacement)`` of any size.

    Of several entries for a term the smallest replacement counts; tokens without one stay, and
    a NULL list stays NULL. Every row keeps its own tokens, with null and repeated ids as
    well; ``key`` is not used to find them. A dictionary that measures within ``limit``
    bytes is looked up row by row, without a shuffle. For a larger one rows and the entries
    they use meet in chunks, with the same result.
    """
    single = settle(dictionary.filter(F.col("term").isNotNull()).groupBy("term").agg(
        F.min("replacement").alias("replacement")).filter("replacement IS NOT NULL"))
    if fits(single, limit):
        return Dictionary(single, "term", "replacement").add(
            df, tokens, lambda look: F.transform(tokens, lambda t: F.coalesce(look(t), t)))
    found = mapped(df, F.col(tokens), single, F.col("replacement"), "_new")
    return found.withColumn(tokens, F.zip_with("_new", tokens, lambda new, t: F.coalesce(new, t))).drop("_new")


def tokenize_for_lexicon(df: DataFrame, dictionary: DataFrame, text: str = "text",
                         key: str = "id", limit: int = TABLE_BYTES) -> DataFrame:
    """``key, tokens`` for lexicon matching with a slang dictionary of any size."""
    cut = df.select(key, tokenize(F.regexp_replace(text, r"\s+$", "")).alias("tokens"))
    return replace_tokens_join(cut, dictionary, key, limit=limit).withColumn(
        "tokens", drop_noise_tokens(F.col("tokens")))


def intersect_tokens(df: DataFrame, terms: DataFrame, key: str = "id",
                     tokens: str = "tokens", limit: int = TABLE_BYTES) -> DataFrame:
    """``key, term``: the distinct tokens of each row that are in a term frame of any size."""
    single = settle(terms.select("term").dropna().distinct())
    if fits(single, limit):
        own = Dictionary(single.withColumn("_in", F.lit(True)), "term", "_in").add(
            df.select(key, tokens), tokens,
            lambda look: F.filter(F.array_distinct(tokens), lambda t: look(t).isNotNull()))
        return own.select(key, each_token(tokens).alias("term"))
    own = mapped(df.select(key, F.array_distinct(tokens).alias(tokens)), F.col(tokens),
                 single, F.lit(True), "_in")
    kept = F.filter(tokens, lambda t, i: F.get("_in", i).isNotNull())
    return own.select(key, F.explode(kept).alias("term"))
