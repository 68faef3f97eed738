"""Text cleaning as ``Column -> Column`` functions.

Everything here is built from JVM-side expressions, so a whole cleaning preset
stays inside one projection: no shuffle, no Python worker, and usable on batch
and streaming frames alike.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab.functions.binding import let

# The marker words and patterns that define the cleaning rules.
USER_WORD = "twuser"
HASHTAG_WORD = "twhastag"
EXCLAMATION_WORD = "twexclamation"
QUESTION_WORD = "twinterrogation"
URL_WORD = "twurl"
# The mark is matched before its left neighbour is looked at, which is cheaper.
USER_PATTERN = r"@(?<![a-zA-Z0-9\-\\.]@)[A-Za-z][A-Za-z0-9]+"
HASHTAG_PATTERN = r"#(?<![a-zA-Z0-9\-\\.]#)[A-Za-z][A-Za-z0-9]+"
URL_PATTERN = r"https?://[a-z!$-_]+"
PUNCTUATION_PATTERN = r"\p{Punct}+"  # the 32 ASCII marks

# Latin characters that transliterate to something other than
# their unaccented base letter.
MULTI_LETTER = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "…": "...", "—": "--", "«": "<<", "»": ">>", "€": "EUR",
}
SINGLE_LETTER = {
    "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d",
    "ı": "i", "ª": "a", "º": "o", "¿": "?", "¡": "!", " ": " ",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-",
}

# Letters without a Unicode decomposition whose name does not tell their base letter.
LATIN_LETTERS = {
    "ĸ": "k", "Ŋ": "NG", "ŋ": "ng", "Ƅ": "6", "ƅ": "6", "ƍ": "d", "Ǝ": "3", "ǝ": "@", "Ə": "@",
    "ə": "@", "Ɣ": "G", "ƕ": "hv", "Ƕ": "HV", "Ɩ": "I", "ƛ": "l", "Ɯ": "W", "Ƣ": "OI", "ƣ": "oi",
    "Ʀ": "YR", "Ƨ": "2", "ƨ": "2", "Ʃ": "SH", "ʃ": "sh", "ƪ": "sh", "Ʊ": "U", "Ʒ": "ZH", "ʒ": "zh",
    "Ƹ": "ZH", "ƹ": "zh", "ƺ": "zh", "ƻ": "2", "Ƽ": "5", "ƽ": "5", "ƾ": "ts", "Ƿ": "W", "ƿ": "w",
    "ǀ": "|", "ǁ": "||", "ǂ": "|=", "ǃ": "!", "Ȝ": "Y", "ȝ": "y", "Ȣ": "OU", "ȣ": "ou", "ȸ": "db",
    "ȹ": "qp", "Ɂ": "?", "ɂ": "?", "Ʉ": "U", "Ʌ": "V", "Ɋ": "Q", "ɋ": "q", "ẟ": "d", "ẞ": "SS",
    "ẜ": "s", "ẝ": "s", "Ỻ": "LL", "ỻ": "ll", "Ỽ": "V", "ỽ": "v", "ʼ": "'", "ʾ": "",
    "·": "",
}
RARE_BLOCKS = r"[\x{100}-\x{2AF}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{FB00}-\x{FB06}]"
LATIN_NAME = re.compile(
    r"LATIN (SMALL|CAPITAL) LETTER (?:(?:TURNED|REVERSED|OPEN|AFRICAN|DOTLESS|SCRIPT) )*"
    r"([A-Z]{1,2})(?: .*)?")

# The code points with Unicode's property Emoji (version 17), but for digits, # and *,
# which are emoji only in keycaps.
EMOJI_POINTS = """
    A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
    25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626
    262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F
    2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8
    26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712
    2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797
    27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF
    1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A
    1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5
    1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D
    1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE
    1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D8 1F6DC-1F6E5
    1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF
    1FA70-1FA7C 1FA80-1FA8A 1FA8E-1FAC6 1FAC8 1FACD-1FADC 1FADF-1FAEA 1FAEF-1FAF8
"""
# Emoji that are younger than the names in ``unicodedata``.
NEW_EMOJI = {
    0x1F6D8: "landslide", 0x1FA89: "harp", 0x1FA8A: "trombone", 0x1FA8E: "treasure_chest",
    0x1FA8F: "shovel", 0x1FABE: "leafless_tree", 0x1FAC6: "fingerprint", 0x1FAC8: "hairy_creature",
    0x1FACD: "orca", 0x1FADC: "root_vegetable", 0x1FADF: "splatter",
    0x1FAE9: "face_with_bags_under_eyes", 0x1FAEA: "distorted_face", 0x1FAEF: "fight_cloud",
}
_POINTS = "".join(
    "-".join(rf"\x{{{p}}}" for p in span.split("-")) for span in EMOJI_POINTS.split())
EMOJI_CLASS = f"[{_POINTS}]"
FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
TAG_FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]++\x{E007F}"
KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
# A sign with its skin tone, and signs joined by U+200D.
SIGN = rf"{EMOJI_CLASS}\x{{FE0F}}?[\x{{1F3FB}}-\x{{1F3FF}}]?"
JOINED = rf"{SIGN}(?:\x{{200D}}{SIGN})*+"


def _spelled(letter: str) -> str | None:
    """ASCII for a Latin letter: its decomposition, the table above or the letter it is named after."""
    out = ""
    for c in unicodedata.normalize("NFKD", letter):
        known = LATIN_LETTERS.get(c, SINGLE_LETTER.get(c, MULTI_LETTER.get(c)))
        named = LATIN_NAME.fullmatch(unicodedata.name(c, ""))
        if unicodedata.combining(c):
            continue
        if c.isascii():
            out += c
        elif known is not None:
            out += known
        elif named:
            out += named[2].lower() if named[1] == "SMALL" else named[2]
        else:
            return None
    return out


@lru_cache(maxsize=1)
def latin_letters() -> dict[str, str]:
    """ASCII spelling of all letters of the Latin blocks and ligatures, IPA letters as far as named."""
    blocks = [*range(0xC0, 0x2B0), *range(0x1E00, 0x1F00), *range(0x2C60, 0x2C80), *range(0xFB00, 0xFB07)]
    spelled = {chr(c): _spelled(chr(c)) for c in blocks if unicodedata.category(chr(c))[0] == "L"}
    return {c: x for c, x in spelled.items() if x}


@lru_cache(maxsize=1)
def latin_fold() -> tuple[str, str]:
    """``translate`` arguments that fold Latin letters and drop combining marks.

    The table is the Unicode decomposition of the Latin blocks. Targets come
    first-come in ``source`` order; the trailing characters of ``source`` have no
    target, which is how ``translate`` deletes.
    """
    pairs = dict(SINGLE_LETTER)
    for letter, spelled in latin_letters().items():
        if len(spelled) == 1 and letter not in MULTI_LETTER:
            pairs.setdefault(letter, spelled)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


@lru_cache(maxsize=1)
def rare_letters() -> dict[str, str]:
    """Letters of several ASCII letters that few texts hold."""
    return {c: x for c, x in latin_letters().items() if len(x) > 1 and c not in MULTI_LETTER}


@lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """``{emoji: 'its_unicode_name'}`` for the code points of ``EMOJI_CLASS``."""
    named = {}
    for span in EMOJI_POINTS.split():
        first, last = span.split("-") if "-" in span else (span, span)
        for code in range(int(first, 16), int(last, 16) + 1):
            name = unicodedata.name(chr(code), NEW_EMOJI.get(code, ""))
            named[chr(code)] = name.lower().replace(" ", "_")
    return named


def to_lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("\n"), F.lit(" "))


def filter_punctuation(text: Column) -> Column:
    """Delete ASCII punctuation; inverted marks are not ASCII and stay."""
    return F.regexp_replace(text, PUNCTUATION_PATTERN, "")


def strip_accents(text: Column) -> Column:
    """Transliterate Latin text to ASCII. Other scripts are left as they are.

    Texts that are ASCII already have as many bytes as characters and pass as is.
    """
    source, target = latin_fold()

    def spelled(x: Column) -> Column:
        for letter, letters in MULTI_LETTER.items():
            x = F.replace(x, F.lit(letter), F.lit(letters))
        rare = x
        for letter, letters in rare_letters().items():
            rare = F.replace(rare, F.lit(letter), F.lit(letters))
        # The short class holds all of the long one and tells most texts apart.
        has_rare = x.rlike(RARE_BLOCKS) & x.rlike(f"[{''.join(rare_letters())}]")
        return F.translate(F.when(has_rare, rare).otherwise(x), source, target)

    def by_pieces(x: Column) -> Column:
        # Each letter has its own spelling, so a run without ASCII is folded by itself.
        runs = F.regexp_extract_all(x, F.lit(r"[\x00-\x7F]++|[^\x00-\x7F]++"), F.lit(0))
        return F.array_join(F.transform(
            runs, lambda p: F.when(p < F.lit("\x80"), p).otherwise(spelled(p))), "")

    def fold(x: Column) -> Column:
        # One look tells the texts that hold no letter of several ASCII letters.
        long = x.rlike(f"[{''.join(MULTI_LETTER)}{RARE_BLOCKS[1:]}")
        return (F.when(F.octet_length(x) == F.char_length(x), x)
                .when(long, by_pieces(x)).otherwise(F.translate(x, source, target)))

    return let(text, fold)


def replace_user(text: Column) -> Column:
    return F.regexp_replace(text, USER_PATTERN, USER_WORD)


def replace_hashtag(text: Column) -> Column:
    return F.regexp_replace(text, HASHTAG_PATTERN, HASHTAG_WORD)


def split_capitals(text: Column) -> Column:
    return F.regexp_replace(text, "([A-Z])", " $1")


def replace_exclamation(text: Column) -> Column:
    return F.regexp_replace(text, r"([!¡])\1*", " " + EXCLAMATION_WORD)


def replace_interrogation(text: Column) -> Column:
    opened = F.replace(text, F.lit("¿"), F.lit(QUESTION_WORD + " "))
    return F.regexp_replace(opened, r"\?+", " " + QUESTION_WORD)


def replace_url(text: Column) -> Column:
    return F.regexp_replace(text, URL_PATTERN, URL_WORD)


def replace_emoji(text: Column) -> Column:
    """Emoji -> ``:name:``; the ``::`` between neighbours becomes one space.

    Skin tones and signs joined by U+200D are one emoji, named after its parts with
    ``_`` between them. Flags become ``:flag_es:``, keycaps ``:keycap_1:``. Texts without
    emoji skip the dictionary. The others are cut into emoji and other pieces, so the name
    lookup runs once per emoji, not once per name.
    """
    names = F.from_json(F.lit(_emoji_json()), "map<string,string>")
    letters = {chr(0x1F1E6 + i): chr(ord("a") + i) for i in range(26)}
    letters |= {chr(0xE0000 + i): chr(i) for i in range(0x20, 0x7F)}
    dropped = "\U0001F3F4\U000E007F"  # of a flag of tags: the black flag and the last tag
    # Plain runs hold digits too, unless they open a keycap. A class of many ranges is slow, so
    # what lies between the first emoji points, which is most of all text, is told by a short one:
    # single characters below U+0100 are looked up at once, each range is a test of its own.
    plain = r"[^0123456789#*\xA9\xAE\x{203C}-\x{10FFFF}]"
    other = rf"(?:{plain}++|[0-9#*](?!\x{{FE0F}}?\x{{20E3}})|[^0-9#*{_POINTS}])++"

    def sign(p: Column) -> Column:
        flag = F.concat(F.lit(":flag_"), F.translate(
            p, "".join(letters) + dropped, "".join(letters.values())), F.lit(":"))
        signs = F.regexp_extract_all(p, F.lit(EMOJI_CLASS), F.lit(0))
        parts = F.array_join(F.transform(signs, lambda c: F.element_at(names, c)), "_")
        return F.when(p.rlike(f"^(?:{TAG_FLAG}|{FLAG})$"), flag).otherwise(
            F.concat(F.lit(":"), parts, F.lit(":")))

    def named(p: Column) -> Column:
        # A look at the first or last character tells most pieces apart.
        keycap = p.endswith("⃣") & p.rlike(f"^{KEYCAP}$")
        return (F.when(F.left(p, F.lit(1)).rlike(EMOJI_CLASS), sign(p))
                .when(keycap, F.concat(F.lit(":keycap_"), F.left(p, F.lit(1)), F.lit(":")))
                .otherwise(p))

    def spell(x: Column) -> Column:
        pieces = F.regexp_extract_all(
            x, F.lit(f"{other}|{TAG_FLAG}|{FLAG}|{KEYCAP}|{JOINED}"), F.lit(0))
        return F.when(x.rlike(r"[\xA9\xAE\x{203C}-\x{1FAFF}]"),
                      F.array_join(F.transform(pieces, named), "")).otherwise(x)

    return F.replace(let(text, spell), F.lit("::"), F.lit(" "))


@lru_cache(maxsize=1)
def _emoji_json() -> str:
    import json

    return json.dumps(emoji_names())


# The order is part of the contract: accents go before the marks they turn into
# ASCII, capitals are split before hashtags are looked for, lower-casing is last.
STEPS = {
    "emoji": replace_emoji,
    "urls": replace_url,
    "accents": strip_accents,
    "users": replace_user,
    "capitals": split_capitals,
    "hashtags": replace_hashtag,
    "exclamation": replace_exclamation,
    "interrogation": replace_interrogation,
    "punctuation": filter_punctuation,
    "lower": to_lower,
}

DEFAULT = ("lower",)
TRAIN = ("users", "hashtags", "urls", "exclamation", "interrogation", "punctuation", "lower")
LEXICON_FULL = tuple(STEPS)
LEXICON_LIGHT = ("emoji", "urls", "lower")


def clean_text(text: Column, steps: tuple[str, ...] = DEFAULT) -> Column:
    """Apply the named cleaning steps in contract order."""
    unknown = sorted(set(steps) - set(STEPS))
    if unknown:
        raise ValueError(f"unknown cleaning steps: {unknown}")
    for name, step in STEPS.items():
        if name in steps:
            text = step(text)
    return text
