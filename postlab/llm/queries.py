"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.llm import (
    bpe, centroids, chat, credentials, decontaminate, fingerprints, jaccard, language, pii, quality,
    resampling, sharding, simhash)
from postlab.llm.spans import shown
from postlab.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    words = vocabulary(spark)
    coded = bpe.decode(bpe.encode(documents(spark, sf).select("doc_id", "text"), words), words)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf).select("doc_id", "text"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = docs.withColumn("print", fingerprints.fingerprint(F.col("text")))
    near = fingerprints.with_following(printed, "doc_id", ["text", "print"])
    swapped = F.floor(F.char_length("text") / 2).cast("int")
    edited = near.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - swapped),
        F.substring("next_text", F.lit(1), swapped)))
    both = edited.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))

    def shown(sketch: str):
        return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")

    return both.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown("print").alias("fingerprint"), shown("edited_print").alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.resemblance(F.col("print"), F.col("next_print")).alias("near_next"))


@query
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, sf).select("doc_id", "text"), max_bits=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
                         "component_id")


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = credentials.find_secrets(documents(spark, sf).select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(shown(F.col("strong")), 256).alias("base_sha256"),
        shown(F.col("secrets")).alias("spans"))


@query
def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    apart = language.held_out(F.col("doc_id"))
    profiles = language.train(docs.filter(~apart))
    return language.predict(docs.select("doc_id", "text", apart.alias("held_out")), profiles).select(
        "doc_id", "held_out", "lang_pred", "score")


@query
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return decontaminate.find_leaks(documents(spark, sf).select("doc_id", "text"), items)


@query
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs)).withColumn(
        "base", F.filter("spans", lambda s: s["kind"].isin(pii.KINDS[:pii.STRICT])))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS[:pii.STRICT]),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


TOOLS = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1},
                              "limit": {"type": "integer", "minimum": 1, "maximum": 60},
                              "mode": {"type": "string", "enum": ["exact", "fuzzy"]}}},
    "lookup": {"type": "object", "required": ["key"],
               "properties": {"key": {"type": "string", "minLength": 4}}},
}


@query
def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as tool calls, the user turns that follow as their results."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    call = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    name = F.when(F.col("turn") % 4 == 1, "search").otherwise("lookup")
    search = F.to_json(F.struct(
        F.array_join(F.slice(words, 1, 4), " ").alias("query"), F.size(words).alias("limit"),
        F.when(F.char_length("text") % 2 == 0, "fuzzy").alias("mode")))
    lookup = F.to_json(F.struct(F.get(words, F.lit(0)).alias("key")))
    earlier = F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", call.alias("call_id"), "turn", name.alias("name"),
        F.when(name == "search", search).otherwise(lookup).alias("arguments"),
        F.when(F.char_length("text") % 3 > 0, earlier).alias("parent_id"))
    answered = F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = turns.filter("role = 'user' AND turn > 0").select(
        "conv_id", answered.alias("call_id"), "turn", F.col("text").alias("content"))
    return chat.link(calls, results, TOOLS)


@query
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    grades = labels.filter("toxic IS NOT NULL AND quality IS NOT NULL").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))
    docs = documents(spark, sf).select("doc_id", "text")
    return quality.score(docs, quality.train(docs, grades)).select(
        "doc_id", "expected_grade", "tail_probability", "selected")


@query
def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.cluster(spread(vectors, "vec_id")).drop("products")


@query
def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    target = spark.read.parquet(f"{sf}/benchmark.parquet").select("text")
    return resampling.resample(documents(spark, sf).select("doc_id", "text"), target)


@query
def op13_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf).select("doc_id", "text"))
