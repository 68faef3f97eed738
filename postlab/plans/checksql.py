"""DuckDB text for the derived tables and for the text rules.

Written from the rules, not generated from the Spark expressions: RE2 has neither
look-behind nor back-references, so several rules take another form here.
"""

from __future__ import annotations

from postlab.functions.stopwords import SPANISH
from postlab.plans.views import LEXICON_SIZE, SLANG, TAIL

WORD = r"[\p{L}\p{N}_]+"

POSTS = f"""v_posts AS (
SELECT 'CASE1' AS test_case, lpad(cast(d.doc_id AS varchar), greatest(6, length(cast(d.doc_id AS varchar)))::int, '0') AS id,
  d.source, d.lang AS language,
  concat('@', d.source, ' ', d.text, chr(10), '#Topic', cast(d.doc_id % 10 AS varchar), ' https://ex.org/',
    cast(d.doc_id AS varchar), '?q=1#frag ¿', d.lang, '?? ¡Ya!!! sooooo{TAIL}') AS text,
  CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'non-toxic' END AS task1,
  CASE WHEN l.toxic = 1 THEN concat('kind', cast(d.n_chars % 5 + 1 AS varchar)) WHEN l.toxic = 0 THEN 'non-toxic' END AS task2,
  CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS split
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

AUX_LABELS = """v_aux_labels AS (
SELECT cast(doc_id AS varchar) AS status_id,
  CASE WHEN doc_id % 7 = 0 THEN 'doubtful' WHEN quality = 1 THEN 'neg' ELSE 'pos' END AS categoria FROM labels)"""

AUX_FEATURES = """v_aux_features AS (
SELECT cast(doc_id AS varchar) AS status_id, text, n_chars % 100 AS favorite_count, n_chars % 1000 AS followers_count,
  CASE doc_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' END AS media_type, doc_id % 2 = 0 AS verified,
  CASE WHEN doc_id % 4 = 0 THEN cast(doc_id + 1 AS varchar) END AS reply_to_status_id FROM documents)"""

LEXICON = f"""lex_pairs AS (SELECT DISTINCT doc_id, term FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents) x),
lex_df AS (SELECT term, count(*) AS df FROM lex_pairs WHERE length(term) >= 4 GROUP BY term),
lex_rank AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) AS rk FROM lex_df),
v_lexicon AS (
SELECT term, CASE rk % 8 WHEN 0 THEN 'c0' WHEN 1 THEN 'c1' WHEN 2 THEN 'c2' ELSE 'c3' END AS category,
  CASE WHEN rk % 3 = 0 THEN 'conservative' ELSE 'inclusive' END AS level FROM lex_rank WHERE rk <= {LEXICON_SIZE})"""

PHRASE_VIEW = f"""cut AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}|[^\\p{{L}}\\p{{N}}_]+') AS p FROM documents),
places AS (SELECT doc_id, p, unnest(generate_series(2, len(p) - 1)) AS i FROM cut),
pair_terms AS (SELECT DISTINCT doc_id, p[i-1] || ' ' || p[i+1] AS term FROM places WHERE p[i] = ' '),
v_phrases AS (SELECT DISTINCT term FROM pair_terms)"""

LOGITS = """v_logits AS (
SELECT vec_id AS id, list_slice(e, 11, 12) AS logits1, list_slice(e, 1, 6) AS logits2,
  CASE WHEN label % 6 = 0 THEN 0 ELSE 1 END AS gold1,
  CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label % 6 END AS gold2,
  cast(floor(vec_id / 16) AS bigint) AS batch_id
FROM (SELECT vec_id, label, cast(embedding AS double[]) AS e FROM embeddings) x)"""

METRIC_LOG = """v_metric_log AS (
SELECT * FROM (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
  value AS loss, value / (1 + abs(value)) AS macro_f1 FROM events) x WHERE epoch <= 20)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body


# Text rules: SQL expression -> SQL expression.

def lower(x: str) -> str:
    return f"replace(lower({x}), chr(10), ' ')"


def punctuation(x: str) -> str:
    return f"regexp_replace({x}, '[[:punct:]]', '', 'g')"


def accents(x: str) -> str:
    for letter, spelled in (("ß", "ss"), ("¿", "?"), ("¡", "!")):
        x = f"replace({x}, '{letter}', '{spelled}')"
    return f"strip_accents({x})"


def user(x: str) -> str:
    return rf"regexp_replace({x}, '(^|[^a-zA-Z0-9\-\\.])@([A-Za-z]+[A-Za-z0-9]+)', '\1twuser', 'g')"


def hashtag(x: str) -> str:
    return rf"regexp_replace({x}, '(^|[^a-zA-Z0-9\-\\.])#([A-Za-z]+[A-Za-z0-9]+)', '\1twhastag', 'g')"


def capitals(x: str) -> str:
    return rf"regexp_replace({x}, '([A-Z])', ' \1', 'g')"


def exclamation(x: str) -> str:
    return f"regexp_replace({x}, '!+|¡+', ' twexclamation', 'g')"


def interrogation(x: str) -> str:
    return rf"regexp_replace(replace({x}, '¿', 'twinterrogation '), '\?+', ' twinterrogation', 'g')"


def url(x: str) -> str:
    return f"regexp_replace({x}, 'http[s]?://([a-zA-Z0-9]|[$-_@.&+]|[!*(),])+', 'twurl', 'g')"


def emoji(x: str) -> str:
    named = f"replace(replace({x}, '😀', ':grinning_face:'), '❤', ':heavy_black_heart:')"
    return f"replace({named}, '::', ' ')"


def chain(x: str, *steps) -> str:
    for step in steps:
        x = step(x)
    return x


def preset_train(x: str) -> str:
    return chain(x, url, user, hashtag, exclamation, interrogation, punctuation, lower)


def preset_full(x: str) -> str:
    return chain(x, emoji, url, accents, user, capitals, hashtag, exclamation, interrogation,
                 punctuation, lower)


def preset_light(x: str) -> str:
    return chain(x, emoji, url, lower)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def no_stops(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: t NOT IN ({quoted(SPANISH)}))"


def raw_tokens(x: str) -> str:
    bare = rf"regexp_replace({accents(x)}, '(^|[^A-Za-z0-9_!@#$%&*])@[A-Za-z0-9_]+', '\1 ', 'g')"
    for code in [*range(32, 127), ord("😀")]:
        c = chr(code)
        pattern = ("\\" if not c.isalnum() and c.isascii() else "") + c
        shown = "\\\\" if c == "\\" else c
        bare = f"regexp_replace({bare}, {quoted([pattern + '{4,}'])}, {quoted([shown * 3])}, 'g')"
    token = "|".join([
        r"https?://[a-z!$-_]+", r"#[\p{L}\p{N}_]+",
        r"[\p{L}_][\p{L}\p{N}_]*(?:[''\-][\p{L}\p{N}_]+)*",
        r"\p{N}+(?:[.,:/]\p{N}+)*", r"[^\s]"])
    return f"regexp_extract_all({bare}, '{token}')"


def tokens(x: str) -> str:
    return no_stops(raw_tokens(x))


def slang_replaced(toks: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SLANG.items())
    return f"list_transform({toks}, lambda t: CASE t {cases} ELSE t END)"


def no_noise(toks: str) -> str:
    return (f"list_filter({toks}, lambda t: NOT (contains(t, 'u00') OR length(t) = 1 "
            "OR regexp_full_match(t, '[0-9]+')))")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"
