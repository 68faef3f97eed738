import zlib

from pyspark.sql import functions as F

from postlab.llm import sharding


def expected(rows, shards):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()),
                                          zlib.crc32((r[1] or "").encode())))
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    at, slots, out = 0, {}, []
    for i, t in ordered:
        shard = at * shards // total
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard, slots[shard]))
        at += len((t or "").encode()) + 1
    return sorted(out, key=repr)


def test_equals_a_plain_walk(spark):
    rows = [(i, "é" * (i * 7919 % 50)) for i in range(500)] + [(None, "x"), (3, "twice"), (3, "twice"), (9, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    got = sorted((tuple(r) for r in sharding.shard_by_bytes(df, 8).collect()), key=repr)
    assert got == expected(rows, 8)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_a_row_longer_than_a_shard(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b" * 100_000), (3, "c")], "doc_id long, text string")
    assert [r.shard for r in sharding.shard_by_bytes(df, 16).orderBy("doc_id").collect()] == [0, 0, 15]


def test_equal_rows_fall_into_many_ranges(spark, monkeypatch):
    """One row repeated thousands of times: ranges cut between the copies."""
    monkeypatch.setattr("postlab.session.RANGE_ROWS", 500)
    rows = [(None, "same")] * 4000 + [(1, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    summed = sharding.prefix_sums(sharding.sizes(df))
    positions = sorted(r.position for r in summed.collect())
    assert positions == list(range(4001))
    assert summed.groupBy("part").count().agg(F.max("count")).first()[0] < 1500
    got = sorted((tuple(r) for r in sharding.shard_by_bytes(df, 8).collect()), key=repr)
    assert got == expected(rows, 8)
