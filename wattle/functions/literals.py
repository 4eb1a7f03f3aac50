"""Exact SQL-text literals, so constant arrays cost one driver call instead of one per value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_double(v: float) -> str:
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"{v!r}D"          # shortest repr: parses back to the same double


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_double(v) for v in values) + ")"


def array_lit(values) -> Column:
    return F.expr(sql_array(values))
