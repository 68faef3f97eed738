from pyspark.sql import functions as F

from postlab.llm import fingerprints as P


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {
        tuple(words)} - {()}


def test_estimates_against_sets(spark):
    base = " ".join(f"w{i}" for i in range(1200))
    texts = [base, base[:3000], base + " tail of five more words", "other words " * 50, "a b", "a b",
             None, "", " \n\t "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        "i", P.fingerprint(F.col("text")).alias("p"))
    pairs = df.join(df.toDF("j", "q"), F.lit(True)).select(
        "i", "j", P.resemblance(F.col("p"), F.col("q")).alias("r"),
        P.containment(F.col("p"), F.col("q")).alias("c"), P.distinct_shingles(F.col("p")).alias("n"))
    for row in pairs.collect():
        a, b = shingles(texts[row.i]), shingles(texts[row.j])
        assert abs(row.r - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        assert abs(row.c - (len(a & b) / len(a) if a else 1)) < 0.25
        assert abs(row.n - len(a)) <= 0.25 * len(a)


def test_parts_merge_to_the_whole(spark):
    rows = [("x", [i, i + 1]) for i in range(0, 600, 2)] + [("y", [5]), ("z", []), (None, [7])]
    df = spark.createDataFrame(rows, "key string, sketch array<bigint>")
    got = {r.key: r.fingerprint for r in P.merge_groups(df.filter("key IS NOT NULL"), "key", "sketch", k=10).collect()}
    assert got == {"x": list(range(10)), "y": [5], "z": []}


def test_following_row(spark, monkeypatch):
    ids = [0, 1, 63, 64, 5000, -3, 2**40, 7_000_000, *[None] * 9, *[5000] * 9, 5001, -3, -1]
    rows = [(i, f"t{i}{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = dict(df.select("text", F.xxhash64("text")).collect())
    for most in (P.CROWD, 4, 1):
        monkeypatch.setattr(P, "CROWD", most)
        got = {r.text: r.next_text for r in P.with_following(df, "doc_id", ["text"]).collect()}
        assert len(got) == len(rows)
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
        texts = [t for _, t in ordered]
        assert got == dict(zip(texts, [*texts[1:], texts[0]]))


def test_a_crowd_of_one_id_spreads_over_tasks(spark, monkeypatch):
    """Most rows have no id: no window task holds more than a few of them."""
    monkeypatch.setattr(P, "CROWD", 100)
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    got = P.with_following(df, "doc_id", ["text"])
    assert got.count() == 3000 and got.select("next_text").distinct().count() == 3000
    assert got.select(F.shiftright(F.xxhash64("text"), 44)).distinct().count() > 2900


def test_copies_are_merged_before_they_are_ranked(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.array(F.col("id") % 3, F.lit(9)).alias("sketch"))
    assert P.merge_groups(df, "key", "sketch", k=3).first().fingerprint == [0, 1, 2]


def test_one_row_follows_itself_and_none_follow_in_an_empty_table(spark):
    df = spark.createDataFrame([(4, "a")], "doc_id long, text string")
    assert P.with_following(df, "doc_id", ["text"]).first().next_text == "a"
    assert P.with_following(df.limit(0), "doc_id", ["text"]).count() == 0
