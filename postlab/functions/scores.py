"""Row-level scoring functions over arrays of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab.functions.binding import let

IGNORED_LABEL = -1


def argmax(logits: Column) -> Column:
    """Zero-based index of the first largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def log_probability(logits: Column, label: Column) -> Column:
    """log softmax(logits)[label], computed with the usual max shift."""
    def shifted(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.get(logits, label) - top - F.log(total)

    return let(F.array_max(logits), shifted)


def _unless_ignored(value: Column, label: Column, ignore: int) -> Column:
    return F.when(label != ignore, value)


def cross_entropy(logits: Column, label: Column, ignore: int = IGNORED_LABEL) -> Column:
    """Per-row loss, NULL where the label is ignored, so ``avg`` skips the row."""
    return _unless_ignored(-log_probability(logits, label), label, ignore)


def focal_loss(logits: Column, label: Column, gamma: float = 2.0,
               ignore: int = IGNORED_LABEL) -> Column:
    logp = log_probability(logits, label)
    return _unless_ignored(-F.pow(1 - F.exp(logp), F.lit(gamma)) * logp, label, ignore)
