"""The registered queries and the pipeline on odd rows and on the small tables."""

import hashlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from postlab.llm import queries, simhash

OPS = [f"op{n}" for n in range(1, 14)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and long texts, repeated rows and clashing columns."""
    top = str(tmp_path_factory.mktemp("odd"))
    text = "The mail is a.b@c.com and the token = abcdefgh1234 of it all."
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "fr", "s", 0),
            (4, "é " * 60_000, "fr", "s", 1), (None, "no id at all here", "en", None, 3), (8, text, "de", "t", 1),
            (9, "12 34", "en", "t", 5)]
    (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
     .selectExpr("*", "1 AS ids", "'x' AS spans", "2 AS score", "3 AS bits", "4 AS row", "5 AS leaked")
     .write.parquet(f"{top}/documents.parquet"))
    spark.createDataFrame([(1, "What is this thing now? It is a test of it."), (2, None)],
                          "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (8, 0, 0), (None, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None),
                           (1, 2, "user", None), (None, None, None, None), (2, 1, "assistant", "x y z")],
                          "conv_id long, turn long, role string, text string").write.parquet(
                              f"{top}/conversations.parquet")
    spark.createDataFrame([(1, [0.5] * 64, 0, "x"), (None, [0.1] * 64, None, "x"), (2, None, 1, "x"),
                           (3, [1.0], 1, "x"), (1, [0.5] * 64, 0, "x")],
                          "vec_id long, embedding array<float>, label int, products string").write.parquet(
                              f"{top}/embeddings.parquet")
    return top


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return top


def test_one_query_for_each_operator_and_the_pipeline():
    names = contract.queries()
    assert [next(n for n in names if n.startswith(f"{op}_")) for op in OPS] and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    if name == "op11_centroids":
        assert sorted((r.vec_id is None, r.vec_id) for r in rows) == [(False, 1), (False, 1), (True, None)]
    elif name not in ("op7_chat", "op9_decontamination"):
        assert len(rows) == 8
        assert sum(r.doc_id == 1 for r in rows) == 2


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()}
    assert kept == {1, 4, None} or kept == {1, 4}
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    """Every decision again in plain Python, on the whole small table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    prints = {r.doc_id: simhash.bit_majority(r.text or "") for r in docs}
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if component[a] < component[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    component[b], changed = component[a], True
    clean = {r.doc_id for r in docs if component[r.doc_id] == r.doc_id
             and not any(i in r.text for i in items)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert out.keys() == clean
    assert sum(r.n_tokens for r in out.values()) > 0


def test_bpe_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_byte_bpe(spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
