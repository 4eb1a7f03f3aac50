"""Reproducible random draws keyed by data, not by partitioning.

``rand(seed)`` depends on how rows are split into partitions; these draws depend only on
the key, so a recomputed partition (lost executor) or a different parallelism gives
the same numbers. One md5 digest yields four independent 32-bit uniforms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def digest(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform(d: Column, slot: int) -> Column:
    """Uniform in (0, 1) from 32 bits of a digest; slot 0..3 selects the bits."""
    hex8 = F.substring(d, 8 * slot + 1, 8)
    return (F.conv(hex8, 16, 10).cast("double") + 0.5) / TWO_32


def gaussian(d: Column, slot: int = 0) -> Column:
    """Standard normal by Box-Muller from two uniforms (slots ``slot`` and ``slot + 1``)."""
    u1, u2 = uniform(d, slot), uniform(d, slot + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def randint(d: Column, slot: int, n) -> Column:
    """Uniform integer in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(d, slot) * n).cast("long")
