from collections import Counter

from pyspark.sql import functions as F

from postlab.llm import language as L


def grams(text):
    count, words, word = Counter(), [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in words:
        count.update(w)
        for n in (2, 3):
            count.update(f"_{w}_"[i:i + n] for i in range(len(w) + 3 - n))
    return count


def test_counts_equal_a_plain_walk():
    texts = ["Hello, wörld it 1 a", "", "..", "x", "a b", "b a", "İstanbul ab"]
    text, gram, count = L.gram_counts(texts)
    for i, t in enumerate(texts):
        assert sorted(count[text == i].tolist()) == sorted(grams(t).values())
    top, _, rank = L.top_grams(["ab " * 400, "cd"])
    assert rank[top == 0].tolist() == list(range((top == 0).sum()))


def test_out_of_place_distance():
    profiles = L.Profiles([("a", 1, 0), ("a", 2, 1), ("b", 2, 0)])
    assert profiles.names == ["a", "b"]
    assert profiles.ranks[:2].tolist() == [[0, L.PROFILE], [1, 0]]


def test_predicts_and_handles_odd_rows(spark):
    english = "the cat and the dog went to the house with their friend number "
    german = "die katze und der hund gingen mit ihrem freund in das haus nummer "
    rows = [(i, (english if i % 2 else german) * 3 + str(i), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !", "en"), (103, english, None), (103, english, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = L.predict(df, L.train(df, rows=10))
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") and 0 < got[i][1] <= 1 for i in range(60))
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "en"
    assert out.filter("doc_id = 103").count() == 2
    nothing = L.train(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, nothing).collect()} == {"und"}


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4500, "a").otherwise("b").alias("lang"))
    got = {(r.lang, r.id) for r in L.sampled_ids(df, 700).collect()}
    assert Counter(x for x, _ in got) == {"a": 700, "b": 500}
    keyed = df.select("id", F.pmod(F.xxhash64("id"), F.lit(L.BUCKETS)).alias("k"), F.xxhash64("id").alias("h"))
    order = [r.id for r in keyed.filter("id < 4500").orderBy("k", "h", "id").collect()]
    assert {i for x, i in got if x == "a"} == set(order[:700])


FOREIGN = [
    "Il sole tramontava lentamente dietro le colline mentre i contadini tornavano a casa dopo una lunga giornata di lavoro.",
    "De zon ging langzaam onder achter de heuvels terwijl de boeren na een lange dag werken naar huis terugkeerden.",
    "Aurinko laski hitaasti kukkuloiden taakse, kun maanviljelijät palasivat kotiin pitkän työpäivän jälkeen.",
    "Çiftçiler tarlalarda geçen uzun bir iş gününden sonra evlerine dönerken güneş tepelerin arkasında batıyordu.",
    "Słońce powoli zachodziło za wzgórzami, gdy rolnicy wracali do domu po długim dniu pracy na polach.",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIGxvbmcgYmFzZTY0IHJ1biBvZiB0ZXh0IHRoYXQgbm9ib2R5IHJlYWRz"]


def test_texts_of_other_languages_go(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.filter(F.col("text").rlike(r"\p{L}"))
    foreign = spark.createDataFrame([(-i, t, None) for i, t in enumerate(FOREIGN, 1)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(foreign), "")
    assert kept.filter("doc_id < 0").count() == 0
    assert kept.filter("doc_id >= 0").count() == docs.count()


def test_pipeline_learns_from_every_labelled_text(spark, monkeypatch):
    """More texts than a sample held; null and repeated ids count as well."""
    import corpus_pipeline

    rows = [(None if i % 10 == 0 else i // 2, f"the cat and the dog went home {i}", "en") for i in range(L.TRAIN_ROWS + 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    read = []
    kept = L.gram_totals
    monkeypatch.setattr(L, "gram_totals", lambda sample: read.append(sample.count()) or kept(sample))
    corpus_pipeline.language_id(spark, docs, "")
    assert read == [len(rows)]
    totals = kept(L.labelled_texts(docs)).groupBy("gram").agg(F.sum("n").alias("n"))
    assert totals.agg(F.max("n")).first()[0] >= 3 * len(rows)
