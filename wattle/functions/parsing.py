"""Text rules for raw meter readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the numeric rule of the readings format. The dot is deliberately
# unescaped (it matches any character), so "1e5" passes; values that pass but do not
# parse as a number ("1a5") are dropped by the try_cast that follows.
NUMERIC_PATTERN = r"^-?\d+(.\d+)?$"


def is_numeric(s: Column) -> Column:
    return s.rlike(NUMERIC_PATTERN)


def parse_reading(s: Column) -> Column:
    """DOUBLE or null: non-empty, matches the numeric rule and parses."""
    ok = (F.length(s) > 0) & is_numeric(s)
    return F.when(ok, s.try_cast("double"))
