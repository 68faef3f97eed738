import pytest
from pyspark.sql import functions as F

from postlab.operators import tables as P
from postlab.session import workspace
from postlab.sources.lexicons import read_lexicon
from postlab.sources.models import load_model, save_model
from postlab.sources.posts import (
    POSTS, read_aux_features, read_aux_labels, read_posts, write_delimited)
from postlab.sources.predictions import prediction_path, second_head_path, write_predictions

ROWS = [
    ("C", "000001", "tw", "es", 'he said "hi"\tand\nleft', "sexist", "objectification"),
    ("C", "000002", "tw", "en", " spaces kept ", "non-sexist", "non-sexist"),
    ("C", "000010", "tw", "fr", "", None, None),
    ("C", "000011", "tw", "en", "back\\slash \\\" quote", "other", None),
]


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(ROWS, POSTS)


def test_round_trip_keeps_everything(spark, posts):
    path = write_delimited(posts, workspace(spark), "\t")
    assert sorted(map(tuple, read_posts(spark, path).collect())) == sorted(ROWS)
    assert [r.id for r in read_posts(spark, path, "es").collect()] == ["000001"]
    assert read_posts(spark, path, "both").count() == 4


def test_reads_a_plain_file(spark, tmp_path):
    file = tmp_path / "posts.tsv"
    file.write_text(
        "test_case\tid\tsource\tlanguage\ttext\ttask1\ttask2\n"
        'A\t007\tx\ten\t"two\nlines ""quoted"""\tsexist\t\n')
    row = read_posts(spark, str(file)).first()
    assert (row.id, row.text, row.task2) == ("007", 'two\nlines "quoted"', None)


def test_columns_are_read_by_name(spark, tmp_path):
    file = tmp_path / "test.tsv"
    file.write_text("id\tlanguage\ttext\textra\ttest_case\tsource\n01\tes\thola\tz\tA\tx\n")
    row = read_posts(spark, str(file)).first()
    assert tuple(row) == ("A", "01", "x", "es", "hola", None, None)
    (tmp_path / "broken.tsv").write_text("id\ttext\n1\tx\n")
    with pytest.raises(KeyError, match="language"):
        read_posts(spark, str(tmp_path / "broken.tsv"))
    features = tmp_path / "features.csv"
    features.write_text('urls,text,status_id\n,"a, b",0012\n')
    assert tuple(read_aux_features(spark, str(features)).first()) == ("0012", "a, b")
    labels = tmp_path / "labels.csv"
    labels.write_text("n;categoria;status_id\n1;X;0012\n")
    assert tuple(read_aux_labels(spark, str(labels)).first()) == ("0012", "X")


def test_label_codes(posts):
    coded = P.encode_labels(posts).orderBy("id").collect()
    assert [(r.task1, r.task2) for r in coded] == [(1, 3), (0, 0), (None, None), (None, None)]
    back = P.decode_labels(P.encode_labels(posts), "task2", P.TASK2_CODES).orderBy("id").collect()
    assert [r.category for r in back] == ["objectification", "non-sexist", None, None]


def test_select(posts):
    assert P.select_columns(posts, ["id"]).columns == ["id"]
    with pytest.raises(KeyError, match="nope"):
        P.select_columns(posts, ["id", "nope"])
    mixed = P.change_dtypes(posts, {"id": "int"}).withColumn("flag", F.lit(True))
    assert P.select_type(mixed, "number").columns == ["id"]
    assert "flag" in P.select_type(mixed, "category").columns
    assert P.filter_language(posts, "en").count() == 2
    assert P.filter_language(posts, "both").count() == P.filter_language(posts, None).count() == 4
    assert P.filter_language(posts, "de").count() == 0


def test_classes(spark):
    df = spark.createDataFrame(
        [("1", "t", "DUDOSO"), ("2", "t", "MACHISTA"), ("3", "t", "NO_MACHISTA"), ("4", "t", None)],
        "status_id string, text string, categoria string")
    kept = P.drop_class(df, "categoria")
    assert [r.status_id for r in kept.orderBy("status_id").collect()] == ["2", "3", "4"]
    merged = P.merge_class(df, "categoria", {"DUDOSO": "MACHISTA"})
    assert merged.filter("categoria = 'MACHISTA'").count() == 2
    aligned = P.align_aux_schema(kept, "A").orderBy("id").collect()
    assert [r.task1 for r in aligned] == ["sexist", "non-sexist", None]
    assert aligned[0].task2 is None and aligned[0].source == "twitter"
    assert {r.task2 for r in P.align_aux_schema(kept, "A", encoded=True).collect()} == {-1}
    assert P.append_rows(spark.createDataFrame(ROWS, POSTS), P.align_aux_schema(kept, "A")).count() == 7


def test_preview_and_flags(posts):
    rows = P.preview(posts.select("id", "task1"), n=2).collect()
    assert [(r.id, r.n_rows, r.n_columns) for r in rows] == [("000001", 4, 2), ("000002", 4, 2)]
    flags = P.presence_flags(posts, {"labelled": "task1"}).orderBy("id").collect()
    assert [r.labelled for r in flags] == ["si", "si", "no", "si"]


def test_term_union(spark):
    a = spark.createDataFrame([("x",), ("y",)], "term string")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "term string, k int")
    assert {r.term for r in P.union_terms(a, b).collect()} == {"x", "y", "z"}


def test_lexicon_layouts(spark, tmp_path):
    files = {
        "category": "id\tlemma\tcategory\tlevel\n1\tuno dos\tpa\tconservative\n",
        "category_plain": "pa\tno\tuno dos\n",
        "polarity": "Words\nuno dos\n",
        "terms": 'term\n"uno dos"\n',
        "slang": "uno dos\treplaced\n",
    }
    for layout, text in files.items():
        file = tmp_path / layout
        file.write_text(text)
        row = read_lexicon(spark, str(file), layout, "lex").first()
        assert (row.name, row.term) == ("lex", "uno dos")
        assert row.replacement == ("replaced" if layout == "slang" else None)
        assert row.level == ("conservative" if layout == "category" else None)


def test_prediction_files(spark, posts):
    assert prediction_path("a/out.tsv", "task1") == "a/out_task1_ml.tsv"
    assert prediction_path("a/out.tsv", "task2", "es") == "a/out_es_task2_ml.tsv"
    assert second_head_path("a/out.tsv") == "a/out_task2.tsv"
    path = write_predictions(posts.withColumnRenamed("task1", "category"), workspace(spark))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "test_case\tid\tcategory" in lines and "C\t000001\tsexist" in lines


def test_workspace_uses_the_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/x/" if key == "spark.checkpoint.dir" else default

    class Context:
        applicationId = "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert workspace(Session()).startswith("hdfs://shared/x/postlab-")


def test_model_round_trip(spark):
    from postlab.operators.models import fit_text_model, predict

    rows = [(str(i), "T", ["good", "day"] if i % 2 else ["bad", "night"], "pos" if i % 2 else "neg")
            for i in range(20)]
    df = spark.createDataFrame(rows, "id string, test_case string, tokens array<string>, y string")
    model = fit_text_model(df, "y", "svm", maxIter=5)
    folder = workspace(spark)
    save_model(model, folder, "es")
    before = {r.id: r.category for r in predict(model, df).collect()}
    after = {r.id: r.category for r in predict(load_model(folder, "es"), df).collect()}
    assert before == after == {r[0]: r[3] for r in rows}


def test_dictionary_rows_keep_their_tokens(spark):
    """Null and repeated ids, null and empty lists; the same by look-up and by join."""
    rows = [(None, ["q", "x"]), (None, ["x"]), ("1", ["q", "q"]), ("1", ["tq"]), ("2", []), ("3", None), ("4", ["q", None])]
    df = spark.createDataFrame(rows, "id string, tokens array<string>")
    terms = [("q", "que"), ("q", "quien"), ("tq", "te quiero"), (None, "no"), ("x", None)]
    dictionary = spark.createDataFrame(terms, "term string, replacement string")
    new = {"q": "que", "tq": "te quiero"}
    expected = sorted(((i, None if t is None else [new.get(x, x) for x in t]) for i, t in rows), key=repr)
    for limit in (0, P.TABLE_BYTES):
        got = P.replace_tokens_join(df, dictionary, limit=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == expected
    plan = P.replace_tokens_join(df, dictionary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]
    shared = [sorted(map(repr, P.intersect_tokens(df, dictionary, limit=limit).collect())) for limit in (0, P.TABLE_BYTES)]
    assert shared[0] == shared[1] and len(shared[0]) == 6


def test_dictionary_of_many_entries(spark):
    from postlab.functions.dictionary import Dictionary

    entries = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    look = Dictionary(entries, "k", "v")
    df = spark.range(0, 10000, 7).select("id", F.concat(F.lit("k"), "id").alias("k"))
    out = look.add(df, "v", lambda at: at(F.col("k"))).collect()
    assert all(r.v == (r.id if r.id < 5000 else None) for r in out)
    empty = Dictionary(entries.limit(0), "k", "v")
    assert empty.add(df, "v", lambda at: at(F.col("k"))).filter("v IS NOT NULL").count() == 0


def test_large_dictionaries_are_asked_by_chunk(spark, monkeypatch):
    """A common token reaches the join once per chunk, and the dictionary is not copied."""
    from postlab.operators import chunks

    rows = [(i % 90, ["hot", f"t{i}", "hot"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    dictionary = spark.createDataFrame([("hot", "cold")] + [(f"t{i}", f"s{i}") for i in range(0, 900, 2)],
                                       "term string, replacement string")
    asked = []
    kept = chunks.answers
    monkeypatch.setattr(chunks, "answers", lambda a, t: asked.append((a, t)) or kept(a, t))
    got = P.replace_tokens_join(df, dictionary, limit=0).collect()
    assert sorted(map(repr, got)) == sorted(repr((i % 90, ["cold", f"s{i}" if i % 2 == 0 else f"t{i}", "cold"])).replace(
        "(", "Row(id=", 1).replace(", [", ", tokens=[", 1) for i in range(300))
    (keys, table), = asked
    hot = keys.distinct().filter(F.col(chunks.TERM) == "hot").count()
    assert hot == keys.select(chunks.CHUNK).distinct().count() < 300 and table.count() == 451
