import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from postlab.functions import tokens as K
from postlab.functions.stopwords import SPANISH
from postlab.operators.tables import replace_tokens_join


@pytest.mark.parametrize("raw, expected", [
    ("sooooo bieeen", ["sooo", "bieeen"]),
    ("@ana_b hola", ["hola"]),
    ("x@ana hola", ["x", "@", "ana", "hola"]),
    ("it's well-known, 3.5 #tag http://a.b/c?d", [
        "it's", "well-known", ",", "3.5", "#tag", "http://a.b/c?d"]),
    ("¿Qué?", ["?", "Que", "?"]),
    ("aaaa!!!!!", ["aaa", "!", "!", "!"]),
    ("", []),
    (None, None),
])
def test_raw_tokens(apply, raw, expected):
    assert apply(K.raw_tokens, [raw]) == [expected]


def test_stop_words_are_case_sensitive_and_keep_repeats(apply):
    tokens = apply(K.tokenize, ["La la casa casa de"])
    assert tokens == [["La", "casa", "casa"]]
    # An accented stop word never meets its folded token.
    assert apply(K.tokenize, ["también"]) == [["tambien"]]


def test_stop_list_is_the_one_spark_ships(spark):
    assert SPANISH == StopWordsRemover.loadDefaultStopWords("spanish")


def test_noise(apply):
    noisy = ["u00e1 a bb 12 1a 1 2 cc"]
    assert apply(lambda c: K.drop_noise_tokens(K.words(c)), noisy) == [["bb", "1a", "cc"]]


def test_tokenize_for_lexicon(apply):
    fn = lambda c: K.tokenize_for_lexicon(c, {"q": "que", "tb": "ademas"})
    # The slang is replaced after stop words are gone, so its result stays.
    assert apply(fn, ["tb q digo 44 x  "]) == [["ademas", "que", "digo"]]


def test_word_count_is_unicode_aware(apply):
    assert apply(K.word_count, ["maña xma_ma 3", "", "!!"]) == [3, 0, 0]


def test_replace_tokens_routes_agree(spark):
    df = spark.createDataFrame(
        [("1", ["a", "b", "a"]), ("2", []), ("3", None), ("4", ["z"])],
        "id string, tokens array<string>")
    pairs = {"a": "x", "z": "y"}
    inline = df.select("id", K.replace_tokens(F.col("tokens"), pairs).alias("tokens"))
    frame = spark.createDataFrame(list(pairs.items()), "term string, replacement string")
    joined = replace_tokens_join(df, frame)
    expected = {"1": ["x", "b", "x"], "2": [], "3": None, "4": ["y"]}
    assert {r.id: r.tokens for r in inline.collect()} == expected
    assert {r.id: r.tokens for r in joined.collect()} == expected


def test_large_literal_dictionary_is_refused(spark):
    with pytest.raises(ValueError):
        K.replace_tokens(F.col("t"), {str(i): "x" for i in range(501)})


def test_intersect_tokens(apply):
    assert apply(lambda c: K.intersect_tokens(K.words(c), ["b", "a"]), ["a c a b"]) == [["a", "b"]]


def test_replacement_keeps_rows_apart_and_takes_one_entry_per_term(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (1, ["b"]), (2, None)],
                               "id int, tokens array<string>")
    slang = spark.createDataFrame([("a", "y"), ("a", "x")], "term string, replacement string")
    got = sorted(((r.id, r.tokens) for r in replace_tokens_join(df, slang).collect()), key=repr)
    assert got == [(1, ["b"]), (1, ["b"]), (1, ["x", "b"]), (2, None)]
