"""Cleaning rules, checked against strings written by hand and against Python's re."""

import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postlab.functions import text as T

LEFT = r"(?:^|(?<=[^a-zA-Z0-9\-\\.]))"


@pytest.mark.parametrize("raw, expected", [
    ("@foo hi", "twuser hi"),
    ("hi @foo", "hi twuser"),
    ("@b", "@b"),
    ("x@bar", "x@bar"),
    (".@ab -@cd \\@ef", ".@ab -@cd \\@ef"),
    ("ñ@cd", "ñtwuser"),
    ("@@ab", "@twuser"),
    ("@foo_bar", "twuser_bar"),
    ("@1ab @a1", "@1ab twuser"),
    ("@ab@cd", "twuser@cd"),
    ("", ""),
    (None, None),
])
def test_replace_user(apply, raw, expected):
    assert apply(T.replace_user, [raw]) == [expected]


@pytest.mark.parametrize("raw, expected", [
    ("#Uno y #dos", "twhastag y twhastag"),
    ("a#uno", "a#uno"),
    ("##uno", "#twhastag"),
    ("#x", "#x"),
    ("ñ#niuna", "ñtwhastag"),
])
def test_replace_hashtag(apply, raw, expected):
    assert apply(T.replace_hashtag, [raw]) == [expected]


@pytest.mark.parametrize("raw, expected", [
    ("see https://ex.org/a?b=1#frag", "see twurl#frag"),
    ("http://A.B:80/[x];y<z>^_q", "twurl"),
    ("http://a~b", "twurl~b"),
    ('http://a"b', 'twurl"b'),
    ("HTTP://a.b", "HTTP://a.b"),
    ("http://a%20b!", "twurl"),
    ("http://", "http://"),
])
def test_replace_url(apply, raw, expected):
    assert apply(T.replace_url, [raw]) == [expected]


@pytest.mark.parametrize("fn, raw, expected", [
    (T.to_lower, "ÁB\nC", "áb c"),
    (T.filter_punctuation, string.punctuation + "a¿¡ñ", "a¿¡ñ"),
    (T.strip_accents, "¿Qué? ¡Ñandú! Straße Æther œuvre", "?Que? !Nandu! Strasse AEther oeuvre"),
    (T.strip_accents, "é «x» — …", "e <<x>> -- ..."),
    (T.strip_accents, "plain ascii", "plain ascii"),
    (T.split_capitals, "NiUna ÑA", " Ni Una Ñ A"),
    (T.replace_exclamation, "¡¡Ya!!! no!", " twexclamationYa twexclamation no twexclamation"),
    (T.replace_exclamation, "!¡!", " twexclamation twexclamation twexclamation"),
    (T.replace_interrogation, "¿¿Qué???", "twinterrogation twinterrogation Qué twinterrogation"),
    (T.replace_emoji, "a😀😀b", "a:grinning_face grinning_face:b"),
    (T.replace_emoji, "❤️ x", ":heavy_black_heart: x"),
    (T.replace_emoji, "a::b", "a b"),
    (T.replace_emoji, "", ""),
    (T.replace_emoji, None, None),
])
def test_single_rules(apply, fn, raw, expected):
    assert apply(fn, [raw]) == [expected]


def test_order_of_steps(apply):
    # Capitals are split before hashtags are looked for, accents before marks.
    assert apply(lambda c: T.clean_text(c, ("capitals", "hashtags")), ["#NiUna"]) == ["# Ni Una"]
    steps = ("accents", "interrogation", "exclamation")
    assert apply(lambda c: T.clean_text(c, steps), ["¿a¡"]) == [
        " twinterrogationa twexclamation"]


def test_presets(apply):
    raw = "@ana mira #Tema https://ex.org/x?q=1 ¡Ya!!! ¿no?\nFin."
    expected = ("twuser mira twhastag twurl  twexclamationya twexclamation "
                "twinterrogation no twinterrogation fin")
    assert apply(lambda c: T.clean_text(c, T.TRAIN), [raw]) == [expected]
    assert apply(T.clean_text, [raw]) == [raw.lower().replace("\n", " ")]
    assert apply(lambda c: T.clean_text(c, T.LEXICON_LIGHT), ["A😀 http://x.y"]) == [
        "a:grinning_face: twurl"]


def test_unknown_step():
    with pytest.raises(ValueError, match="sing"):
        T.clean_text(None, ("sing",))


def python_rules(text):
    """The rules of the training preset in Python's own regular expressions."""
    text = re.sub(r"http[s]?://(?:[a-zA-Z0-9]|[$-_@.&+]|[!*(),])+", "twurl", text)
    text = re.sub(LEFT + r"@[A-Za-z]+[A-Za-z0-9]+", "twuser", text)
    text = re.sub(LEFT + r"#[A-Za-z]+[A-Za-z0-9]+", "twhastag", text)
    text = re.sub("!+|¡+", " twexclamation", text)
    text = re.sub(r"\?+", " twinterrogation", text.replace("¿", "twinterrogation "))
    text = "".join(c for c in text if c not in string.punctuation)
    return text.lower().replace("\n", " ")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB1ñÉ@#!¡?¿ .-_\\/:\n", max_size=40), min_size=50, max_size=80))
def test_train_preset_equals_python(apply, texts):
    assert apply(lambda c: T.clean_text(c, T.TRAIN), texts) == [python_rules(t) for t in texts]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aÉñß!¿«x", max_size=20), min_size=30, max_size=40))
def test_idempotent_rules(apply, texts):
    for fn in (T.filter_punctuation, T.strip_accents):
        once = apply(fn, texts)
        assert apply(fn, once) == once


def test_very_long_texts(apply):
    n = 200_000
    texts = ["a-" * n, "1," * n, "a" * n, "!" * n, "😀" * 1000, "@" * n, "é" * n]
    from postlab.functions.tokens import raw_tokens
    from pyspark.sql import functions as F

    sizes = apply(lambda c: F.length(T.clean_text(c, T.LEXICON_FULL)), texts)
    assert sizes[0] == n and sizes[6] == n
    assert apply(lambda c: F.size(raw_tokens(c)), texts)[0] == 2
