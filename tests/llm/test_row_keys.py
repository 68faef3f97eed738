"""Stages decide on each text, also where ids are null or repeat."""

import corpus_pipeline
from postlab.llm import simhash

ITEM = "What is the highest mountain on the whole earth today? It is called mount everest by most people."
SCHEMA = "doc_id long, text string"


def words(name, n=80):
    return " ".join(f"{name}{i}" for i in range(n))


def kept(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_a_leak_takes_no_other_text_of_its_id(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    leak = words("around ", 20) + " " + ITEM
    clean = [(None, "a clean text without an id"), (None, None), (7, "a clean text of a repeated id"), (8, ""),
             (9, words("other"))]
    docs = spark.createDataFrame([*clean, (None, leak), (7, leak), (7, leak), (10, leak)], SCHEMA)
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and kept(out) == sorted(clean, key=repr)


def test_one_row_of_each_component_with_repeated_and_null_ids(spark):
    # For each of many texts: an id that also has a near copy of a smaller id's text.
    rows, expected = [], []
    for i in range(12):
        own, shared = words(f"own{i}x"), words(f"shared{i}x")
        rows += [(100 + i, own), (100 + i, shared), (i, shared), (None, own)]
        expected += [(100 + i, own), (i, shared)]
    rows += [(None, words("lone")), (None, words("lone")), (None, words("single")), (50, words("twice")),
             (50, words("twice"))]
    expected += [(None, words("lone")), (None, words("single")), (50, words("twice"))]
    out = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept(out) == sorted(expected, key=repr)
