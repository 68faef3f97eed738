"""Every class of emoji and of Latin letters."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from postlab.functions import text as T
from postlab.functions import tokens as K


@pytest.mark.parametrize("raw, expected", [
    ("⭐ ⌚ ▶️ ©", ":white_medium_star: :watch: :black_right-pointing_triangle: :copyright_sign:"),
    ("a🇪🇸🇩🇪b", "a:flag_es flag_de:b"),
    ("🏴\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F", ":flag_gbeng:"),
    ("👍🏽", ":thumbs_up_sign_emoji_modifier_fitzpatrick_type-4:"),
    ("👩🏽‍💻!", ":woman_emoji_modifier_fitzpatrick_type-4_personal_computer:!"),
    ("🏳️‍🌈", ":waving_white_flag_rainbow:"),
    ("1️⃣ 12 #", ":keycap_1: 12 #"),
    ("\U0001FAE9", ":face_with_bags_under_eyes:"),
    ("★ ✁ a 1", "★ ✁ a 1"),
])
def test_emoji(apply, raw, expected):
    assert apply(T.replace_emoji, [raw]) == [expected]


def test_long_sequences(apply):
    family = "👩" + "‍👩" * 20_000
    assert apply(T.replace_emoji, [family]) == [":" + "_".join(["woman"] * 20_001) + ":"]


def test_all_latin_letters(apply):
    raw = "Ħħ Ŧŧ Ŋŋ Ĳĳ ŉ ƒ ə ﬁ ﬀ ẞ Ǆ ǽ Ǿ Ⱥ"
    assert apply(T.strip_accents, [raw]) == ["Hh Tt NGng IJij 'n f @ fi ff SS DZ ae O A"]
    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]
               if unicodedata.category(chr(c))[0] == "L"]
    assert [x for x in apply(T.strip_accents, letters) if not x.isascii()] == []


def test_long_letters_are_folded_without_the_plain_text_around_them(spark):
    """Texts are not searched for every letter of several letters one after the other."""
    mixed = "plain ascii, ñandú Straße «œuvre» ĳ Ŋ… x̂ 日本 😀 end"
    rows = spark.createDataFrame([(mixed,), ("ñ" * 3,), (None,), ("",)], "t string")
    folded = rows.select(T.strip_accents(F.col("t")).alias("x"))
    assert [r.x for r in folded.collect()] == [
        "plain ascii, nandu Strasse <<oeuvre>> ij NG... x 日本 😀 end", "nnn", None, ""]
    # Pieces are cut first; before, the whole text was searched.
    assert "regexp_extract_all" in folded._jdf.queryExecution().optimizedPlan().toString()


def test_digits_of_any_script_are_noise_and_words_with_digits_are_not(apply):
    tokens = ["12", "a1", "A1", "٣٤", "{1", "Z9", "x", "u00ab", "[2", "99x", "é1"]
    kept = apply(lambda c: K.drop_noise_tokens(F.split(c, " ")), [" ".join(tokens)])
    assert kept == [["a1", "A1", "{1", "Z9", "[2", "99x", "é1"]]
