"""Personal data spans by weak supervision: labelers vote, expectation-maximisation weighs them.

Candidates are the strict patterns (``email``, ``ip``, ``card``, ``phone``), which always
count, and weak ones: a ``number`` of 9 to 19 digits that is no card, a ``handle``, a
``name`` after a title, an ``iban``. On each candidate the labelers vote for, against
or not at all: pattern, checksum, gazetteer, words to the left, neighbours, format.

``fit`` counts how often every combination of kind, votes and shape occurs in all texts (few
combinations; partial counts per batch). Expectation-maximisation estimates from
them how often each labeler votes which way for true and for false candidates, and
a posterior per combination. A logistic classifier of kind, votes and shape is then
trained on those posteriors, so it also judges combinations that never occurred.
``detect`` keeps strict spans and weak ones the classifier gives more than
``KEEP``.

Texts are read whole; null is empty and has no spans. Rows are independent, so
repeated rows give repeated results. Without candidates the classifier is neutral
and only strict spans count. Other columns are kept; one named like a result column
is replaced. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.session import ship_package

KINDS = ["email", "ip", "card", "phone", "number", "handle", "name", "iban"]
STRICT = 4
LABELERS = 6
KEEP = 0.5
ROUNDS = 60
LEFT, AROUND = 48, 96
SPANS = "array<struct<start:int,end:int,kind:string,probability:double>>"

# The strict patterns. Repeats that cannot match otherwise do not back up, and
# a search never restarts inside a run of digits it has already refused.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_.@-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
                  r"(?![A-Za-z0-9])")
NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.?\x20[A-Z]\w{1,30}"
                  r"(?:\x20[A-Z]\w{1,30})?")
DIGIT = re.compile(r"[0-9]")

TOP_DOMAINS = set("com org net edu gov io de fr es uk eu info biz int".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "4", "5", "6", "8", "9")
FIRST_NAMES = set("""Anna Maria John James Mary Peter Paul Michael Thomas Laura Sarah David Daniel
    Martin Andreas Hans Klaus Sabine Petra Claudia Jean Pierre Marie Sophie Luc Jacques Carlos
    Jose Juan Carmen Pilar Ana Luis Antonio""".split())
FOR_WORDS = re.compile(r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|account|"
                       r"iban|name|address|ip|kontakt|telefon|correo|courriel|konto|reach)\W*\Z")
AGAINST_WORDS = re.compile(r"(?i)(?:order|isbn|issn|version|page|part|sku|invoice|ticket|serial|"
                           r"article|no|nr|id|section|figure)\W*\Z")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with what may stand before it, found from the ``@`` so that no run is reread."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at) if local else None
        if domain:
            yield at - local, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def strict_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, kind number, end`` of the strict kinds, by start and then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def weak_spans(text: str, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no strict pattern holds and that overlap no strict span."""
    found = [(m.start(), 6, m.end()) for m in NAME.finditer(text)]
    if "@" in text:
        found += [(m.start(), 5, m.end()) for m in HANDLE.finditer(text)]
    if DIGIT.search(text):
        found += [(m.start(), 4, m.end()) for m in CARD.finditer(text)
                  if 9 <= len(m[0]) - m[0].count(" ") - m[0].count("-") <= 19]
        found += [(m.start(), 7, m.end()) for m in IBAN.finditer(text)]
    free, end, i = [], -1, 0
    taken = sorted((a, b) for a, _, b in strict)
    for a, kind, b in sorted(found):
        while i < len(taken) and taken[i][0] < b:
            end = max(end, taken[i][1])
            i += 1
        if end <= a:
            free.append((a, kind, b))
            end = b  # of overlapping weak candidates the first one counts
    return free


def votes(text: str, span: tuple[int, int, int], neighbour: bool) -> tuple[int, ...]:
    """What each labeler says about a candidate: 1 for, -1 against, 0 nothing."""
    start, kind, end = span
    value, name = text[start:end], KINDS[kind]
    digits = "".join(DIGIT.findall(value))
    left = text[max(0, start - LEFT):start]
    pattern = 1 if kind < STRICT else 0
    checksum = gazetteer = shape = 0
    if name in ("card", "number"):
        checksum = 1 if len(digits) >= 13 and luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" and len(digits) >= 13 else -1
        groups = [len(g) for g in re.split(r"[\x20-]", value)]
        shape = 1 if len(groups) == 1 or set(groups[:-1]) == {4} else -1
    elif name == "email":
        gazetteer = 1 if value.rsplit(".", 1)[1].lower() in TOP_DOMAINS else -1
        shape = -1 if value[0] in ".%+-" or ".." in value else 1
    elif name == "ip":
        checksum = 1
        gazetteer = -1 if digits.startswith("0") or value.startswith(("127.", "255.")) else 1
        shape = -1 if any(p != (p.lstrip("0") or "0") for p in value.split(".")) else 1
    elif name == "phone":
        gazetteer = 1 if digits.startswith(CALLING_CODES) else -1
        shape = 1 if value.count("(") == value.count(")") <= 1 else -1
    elif name == "name":
        words = value.split()
        gazetteer = 1 if any(w in FIRST_NAMES for w in words[1:]) else 0
        shape = 1 if len(words) > 2 else 0
    elif name == "iban":
        packed = value.replace(" ", "")
        moved = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
        checksum = 1 if int(moved) % 97 == 1 else -1
    context = 1 if FOR_WORDS.search(left) else -1 if AGAINST_WORDS.search(left) else 0
    return pattern, checksum, gazetteer, context, int(neighbour), shape


def candidates(text: str) -> list[tuple[tuple[int, int, int], tuple[int, ...]]]:
    """All candidates in order, each with its pattern: kind, votes and size class."""
    strict = strict_spans(text)
    spans = sorted(strict + weak_spans(text, strict))
    out = []
    for i, span in enumerate(spans):
        near = (i > 0 and span[0] - spans[i - 1][2] <= AROUND) or (
            i + 1 < len(spans) and spans[i + 1][0] - span[2] <= AROUND)
        size = min((span[2] - span[0]).bit_length(), 7)
        out.append((span, (span[1], *votes(text, span, near), size)))
    return out


class Model:
    """Labeler reliabilities and the span classifier trained on their posteriors."""

    def __init__(self, counts: list[tuple[tuple[int, ...], int]]):
        patterns = np.array([p for p, _ in counts], np.int64).reshape(-1, LABELERS + 2)
        weight = np.array([n for _, n in counts], np.float64)
        self.reliability, posterior = expectation_maximisation(patterns, weight)
        self.weights = train_classifier(features(patterns), posterior, weight)

    def probability(self, patterns: list[tuple[int, ...]]) -> np.ndarray:
        table = np.array(patterns, np.int64).reshape(-1, LABELERS + 2)
        return 1 / (1 + np.exp(-features(table) @ self.weights))


def expectation_maximisation(patterns: np.ndarray, weight: np.ndarray) -> tuple:
    """Vote frequencies ``[truth, labeler, vote + 1]`` and the posterior of each pattern.

    Starts from the majority of votes; a small prior count keeps labelers on the side
    they were made for.
    """
    vote = patterns[:, 1:1 + LABELERS] + 1
    posterior = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(1)))
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
    table = np.zeros((2, LABELERS, 3))
    for _ in range(ROUNDS):
        for truth, mass in ((0, weight * (1 - posterior)), (1, weight * posterior)):
            for i in range(LABELERS):
                table[truth, i] = prior[truth] + np.bincount(vote[:, i], mass, 3)
        table /= table.sum(2, keepdims=True)
        share = ((weight * posterior).sum() + 1) / (weight.sum() + 2)
        each = np.log(table[:, np.arange(LABELERS), vote]).sum(2)
        gain = np.log(share) - np.log1p(-share) + each[1] - each[0]
        posterior = 1 / (1 + np.exp(-np.clip(gain, -30, 30)))
    return table, posterior


def features(patterns: np.ndarray) -> np.ndarray:
    """One-hot kind, votes and size class, and a constant."""
    return np.hstack([np.eye(len(KINDS))[patterns[:, 0]],
                      *(np.eye(3)[patterns[:, 1 + i] + 1] for i in range(LABELERS)),
                      np.eye(8)[patterns[:, -1]], np.ones((len(patterns), 1))])


def train_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray,
                     ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (target - p)) - ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        w += np.linalg.solve(bend + ridge * np.eye(len(w)), slope)
    return w


def fit(df: DataFrame, text: str = "text") -> Model:
    ship_package(df.sparkSession)
    names = ["kind", *(f"v{i}" for i in range(LABELERS)), "size"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(p for t in batch["text"] for _, p in candidates(t))
            yield pd.DataFrame([(*p, n) for p, n in seen.items()], columns=[*names, "n"])

    schema = ", ".join(f"{c} int" for c in names) + ", n long"
    counts = (df.select(F.coalesce(text, F.lit("")).alias("text")).mapInPandas(counted, schema)
              .groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names))
    # At most kinds x 3^labelers x sizes combinations, however many texts.
    return Model([(tuple(r[:-1]), r[-1]) for r in counts.collect()])


def accepted(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    found = candidates(text)
    if not found:
        return []
    chance = model.probability([p for _, p in found])
    return [(a, b, KINDS[kind], float(c)) for ((a, kind, b), _), c in zip(found, chance)
            if kind < STRICT or c > KEEP]


def detect(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``spans`` (``start, end, kind, probability``), by start and then kind."""
    ship_package(df.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "kind": k, "probability": c}
                           for a, b, k, c in accepted(t, model)] for t in texts], dtype=object)

    return df.withColumn("spans", spans(F.coalesce(F.col(text), F.lit(""))))


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Put ``<KIND>`` in the place of every accepted span; of overlapping ones the first."""
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, model) for t in texts], dtype=object)

    return df.withColumn(text, hidden(F.col(text)))


def redacted(text: str, model: Model) -> str:
    out, done = [], 0
    for a, b, kind, _ in accepted(text, model):
        if b <= done:
            continue
        if a >= done:
            out.append(text[done:a])
            out.append(f"<{kind.upper()}>")
        done = b
    return "".join([*out, text[done:]])
