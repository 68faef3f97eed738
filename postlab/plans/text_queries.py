"""T1-T17: text and token functions over whole posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlab.functions import text as T
from postlab.functions import tokens as K
from postlab.operators.tables import replace_tokens_join, tokenize_for_lexicon
from postlab.plans import checksql as S
from postlab.plans import views
from postlab.plans.registry import query


def _check(expression: str, name: str = "text") -> str:
    return S.with_views(f"SELECT id, {expression} AS {name} FROM v_posts", S.POSTS)


def _apply(spark, sf, fn, name="text"):
    return views.posts(spark, sf).select("id", fn(F.col("text")).alias(name))


@query(_check(S.lower("text")))
def t1_to_lower(spark, sf):
    return _apply(spark, sf, T.to_lower)


@query(_check(S.punctuation("text")))
def t2_filter_punctuation(spark, sf):
    return _apply(spark, sf, T.filter_punctuation)


@query(_check(S.accents("text")))
def t3_strip_accents(spark, sf):
    return _apply(spark, sf, T.strip_accents)


@query(_check(S.user("text")))
def t4_replace_user(spark, sf):
    return _apply(spark, sf, T.replace_user)


@query(_check(S.hashtag("text")))
def t5_replace_hashtag(spark, sf):
    return _apply(spark, sf, T.replace_hashtag)


@query(_check(S.capitals("text")))
def t6_split_capitals(spark, sf):
    return _apply(spark, sf, T.split_capitals)


@query(_check(S.exclamation("text")))
def t7_replace_exclamation(spark, sf):
    return _apply(spark, sf, T.replace_exclamation)


@query(_check(S.interrogation("text")))
def t8_replace_interrogation(spark, sf):
    return _apply(spark, sf, T.replace_interrogation)


@query(_check(S.url("text")))
def t9_replace_url(spark, sf):
    return _apply(spark, sf, T.replace_url)


@query(_check(S.emoji("text")))
def t10_replace_emoji(spark, sf):
    return _apply(spark, sf, T.replace_emoji)


# Signs of every class: outside the two large blocks, flags, skin tones, joined, keycaps, not emoji.
SIGNS = {
    "🏴\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F": ":flag_gbeng:",
    "👩🏽\u200d💻": ":woman_emoji_modifier_fitzpatrick_type-4_personal_computer:",
    "👍🏽": ":thumbs_up_sign_emoji_modifier_fitzpatrick_type-4:",
    "🏳\ufe0f\u200d🌈": ":waving_white_flag_rainbow:", "🇪🇸": ":flag_es:", "🇩🇪": ":flag_de:",
    "1\ufe0f\u20e3": ":keycap_1:", "▶\ufe0f": ":black_right-pointing_triangle:",
    "⭐": ":white_medium_star:", "⌚": ":watch:", "★": "★"}
LETTERS = {"Ħ": "H", "ŧ": "t", "ŋ": "ng", "ĳ": "ij", "ŉ": "'n", "ƒ": "f", "ə": "@", "ﬁ": "fi", "ẞ": "SS", "Ǆ": "DZ"}


def _replaced(x: str, table: dict[str, str]) -> str:
    for sign, name in table.items():
        x = f"replace({x}, {S.quoted([sign])}, {S.quoted([name])})"
    return x


def _with_all(table: dict[str, str]) -> str:
    return f"concat(text, {S.quoted([''.join(table)])})"


@query(_check(S.emoji(_replaced(_with_all(SIGNS), SIGNS))))
def t10_replace_emoji_classes(spark, sf):
    return _apply(spark, sf, lambda c: T.replace_emoji(F.concat(c, F.lit("".join(SIGNS)))))


@query(_check(S.accents(_replaced(_with_all(LETTERS), LETTERS))))
def t3_strip_accents_letters(spark, sf):
    return _apply(spark, sf, lambda c: T.strip_accents(F.concat(c, F.lit("".join(LETTERS)))))


@query(_check(S.lower("text")))
def t11_clean_text(spark, sf):
    """The defaults: only lower-casing is on."""
    return _apply(spark, sf, T.clean_text)


@query(_check(S.preset_train("text")))
def t11a_clean_train(spark, sf):
    return _apply(spark, sf, lambda c: T.clean_text(c, T.TRAIN))


@query(_check(S.preset_full("text")))
def t11b_clean_lexicon_full(spark, sf):
    return _apply(spark, sf, lambda c: T.clean_text(c, T.LEXICON_FULL))


@query(_check(S.preset_light("text")))
def t11c_clean_lexicon_light(spark, sf):
    return _apply(spark, sf, lambda c: T.clean_text(c, T.LEXICON_LIGHT))


@query(_check(f"array_to_string({S.tokens('text')}, ' ')", "tokens"))
def t12_tokenize(spark, sf):
    return _apply(spark, sf, lambda c: K.join_tokens(K.tokenize(c)), "tokens")


@query(_check(f"array_to_string({S.no_stops(S.words('lower(text)'))}, ' ')", "tokens"))
def t13_filter_stopwords(spark, sf):
    return _apply(
        spark, sf, lambda c: K.join_tokens(K.filter_stopwords(K.words(F.lower(c)))), "tokens")


REPLACED = _check(f"array_to_string({S.slang_replaced(S.words('lower(text)'))}, ' ')", "tokens")


@query(REPLACED)
def t14_replace_tokens(spark, sf):
    return _apply(
        spark, sf,
        lambda c: K.join_tokens(K.replace_tokens(K.words(F.lower(c)), views.SLANG)), "tokens")


@query(REPLACED)
def t14_replace_tokens_join(spark, sf):
    """The route for dictionaries of any size."""
    posts = views.posts(spark, sf).select("id", K.words(F.lower("text")).alias("tokens"))
    return (replace_tokens_join(posts, views.slang(spark))
            .withColumn("tokens", K.join_tokens(F.col("tokens"))))


NOISELESS = S.no_noise(S.slang_replaced(S.tokens(r"regexp_replace(lower(text), '\s+$', '')")))


@query(_check(f"array_to_string({NOISELESS}, ' ')", "tokens"))
def t15_drop_noise_tokens(spark, sf):
    return _apply(
        spark, sf,
        lambda c: K.join_tokens(K.tokenize_for_lexicon(F.lower(c), views.SLANG)), "tokens")


# Every lexicon word and more stands for its reverse: far beyond a literal dictionary.
LARGE_SLANG = S.with_views(
    "SELECT n.id, array_to_string(list_filter(coalesce(r.tokens, []), lambda t: NOT (contains(t, 'u00') "
    "OR length(t) = 1 OR regexp_full_match(t, '[0-9]+'))), ' ') AS tokens FROM v_posts n LEFT JOIN ("
    "SELECT id, list(coalesce(reverse(l.term), u.term) ORDER BY pos) AS tokens FROM (SELECT id, "
    "unnest(t) AS term, unnest(generate_series(1, len(t))) AS pos FROM (SELECT id, "
    + S.tokens(r"regexp_replace(lower(text), '\s+$', '')") + " AS t FROM v_posts) a) u "
    "LEFT JOIN lex_df l ON u.term = l.term GROUP BY id) r ON n.id = r.id", S.POSTS, S.LEXICON)


@query(LARGE_SLANG)
def t15_large_dictionary(spark, sf):
    """Slang from a frame of any size."""
    slang = views.whole_lexicon(spark, sf).withColumn("replacement", F.reverse("term"))
    posts = views.posts(spark, sf).select("id", F.lower("text").alias("text"))
    return tokenize_for_lexicon(posts, slang).withColumn("tokens", K.join_tokens(F.col("tokens")))


@query(_check(f"cast(len({S.words('text')}) AS bigint)", "n_words"))
def t16_word_count(spark, sf):
    return _apply(spark, sf, lambda c: K.word_count(c).cast("bigint"), "n_words")


@query(_check(f"array_to_string({S.words('text')}, ' ')"))
def t17_join_tokens(spark, sf):
    return _apply(spark, sf, lambda c: K.join_tokens(K.words(c)))
