"""Bind an expression to a name inside a larger Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda body re-evaluates every outer expression it mentions for each
    element; binding it as a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
