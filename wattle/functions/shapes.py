"""Array functions on load shapes (an hourly day is ``ARRAY<DOUBLE>``).

All builders compose Spark's higher-order array functions, so they run inside the JVM
and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 24


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rotate(x, q) -> Column:
    """Cyclic rotation: ``q > 0`` shifts left, ``q < 0`` right, result[j] = x[(j + q) mod n].

    ``q = 0`` or ``|q| >= n`` returns the array unchanged (not ``q mod n``).
    """
    x, q = _col(x), _lit(q)
    n = F.size(x)
    q_eff = F.when(F.abs(q) >= n, F.lit(0)).otherwise(q)
    return F.transform(x, lambda v, j: F.element_at(x, F.pmod(j + q_eff, n) + 1))


def crop(x, length: int = DAY) -> Column:
    """Centre crop to ``length`` starting at floor((n - length) / 2); shorter arrays unchanged."""
    x = _col(x)
    n = F.size(x)
    start = F.floor((n - F.lit(length)) / 2).cast("int") + 1
    return F.when(n > length, F.slice(x, start, F.lit(length))).otherwise(x)


def shifted_crop(x, q, length: int = DAY) -> Column:
    """``crop(rotate(x, q), length)`` as one index expression (no intermediate array)."""
    x, q = _col(x), _lit(q)
    n = F.size(x)
    q_eff = F.when(F.abs(q) >= n, F.lit(0)).otherwise(q)
    start = F.when(n > length, F.floor((n - F.lit(length)) / 2).cast("int")).otherwise(F.lit(0))
    width = F.least(n, F.lit(length))
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.element_at(x, F.pmod(i + start + q_eff, n) + 1),
    )


def array_sum(x) -> Column:
    """Left-to-right sum starting from 0.0 (fixed order, so results are reproducible)."""
    return F.aggregate(_col(x), F.lit(0.0), lambda acc, v: acc + v)


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a lambda variable.

    Catalyst does not hoist sub-expressions out of lambda bodies, so a value used inside
    ``transform`` (for example an array's sum) is bound here instead of being recomputed
    for every element.
    """
    return F.element_at(F.transform(F.array(expr), body), 1)


def normalize(x) -> Column:
    """Scale to sum 1; an array summing to exactly 0 is returned unchanged."""
    return let(
        _col(x),
        lambda a: let(
            array_sum(a),
            lambda s: F.when(s == 0.0, a).otherwise(F.transform(a, lambda v: v / s)),
        ),
    )


def _assert_same_size(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(
        F.raise_error(F.lit("cannot compare shapes of different length"))
    )


def sq_distance(a, b, check: bool = True) -> Column:
    """Squared Euclidean distance; positions where either side is NaN are skipped."""
    a, b = _col(a), _col(b)
    terms = F.zip_with(
        a, b, lambda u, v: F.when(F.isnan(u) | F.isnan(v), F.lit(0.0)).otherwise((u - v) * (u - v))
    )
    d2 = array_sum(terms)
    if check:
        d2 = F.when(_assert_same_size(a, b), d2)
    return d2


def sq_distance_unrolled(a: str, b: list) -> Column:
    """``sq_distance`` for a fixed length ``len(b)`` written as scalar arithmetic (compiled by
    whole-stage codegen instead of interpreted lambdas); same left-to-right order.

    ``a`` names an array column; ``b`` holds SQL expressions (literals or column refs)."""
    acc = "0.0D"
    for i, bi in enumerate(b):
        u = f"`{a}`[{i}]"
        acc = f"({acc} + CASE WHEN isnan({u}) OR isnan({bi}) THEN 0.0D ELSE ({u} - {bi}) * ({u} - {bi}) END)"
    return F.expr(acc)


def euclidean(a, b, check: bool = True) -> Column:
    return F.sqrt(sq_distance(a, b, check))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector has zero norm."""
    a, b = _col(a), _col(b)
    dot = array_sum(F.zip_with(a, b, lambda u, v: u * v))
    na = array_sum(F.transform(a, lambda u: u * u))
    nb = array_sum(F.transform(b, lambda u: u * u))
    denom = F.sqrt(na) * F.sqrt(nb)
    return F.when(_assert_same_size(a, b), F.when(denom != 0.0, dot / denom))


def shift_candidates(x, max_shift: int, length: int = DAY) -> Column:
    """``ARRAY<STRUCT<q INT, z ARRAY<DOUBLE>>>``: the normalised, centre-cropped shape for
    every shift q in [-max_shift, max_shift], smallest q first."""
    x = _col(x)
    return F.transform(
        F.sequence(F.lit(-max_shift), F.lit(max_shift)),
        lambda q: F.struct(q.alias("q"), normalize(shifted_crop(x, q, length)).alias("z")),
    )


def ksc_distance(x, c, max_shift: int, length: int = DAY) -> Column:
    """K-SC distance of a raw point to one (normalised) centroid.

    ``STRUCT<dist, q, z>``: the smallest Euclidean distance over all shifts (ties -> smaller
    q) with the winning shift and its normalised shape. Scale factor 1, no division by
    the point norm.
    """
    c = _col(c)
    cands = F.transform(
        shift_candidates(x, max_shift, length),
        lambda s: F.struct(euclidean(s["z"], c).alias("dist"), s["q"].alias("q"), s["z"].alias("z")),
    )
    return F.array_min(cands)


def scaled_distance(x, c, max_shift: int, length: int = DAY) -> Column:
    """The distance of the method's text: min over scale a and shift q of |x_q - a c| / |x_q|.

    For a shift the best scale is a = x·c / |c|^2, which leaves sqrt(1 - (x·c)^2 / (|x|^2 |c|^2)).
    ``STRUCT<dist, q, alpha, z>`` with the raw shifted shape; ties -> smaller q. A zero point or
    centroid is at distance 1 (nothing of it is explained).
    """
    c = _col(c)

    def dot(a, b):
        return array_sum(F.zip_with(a, b, lambda u, v: u * v))

    def scored(q, z):
        n = dot(z, z) * dot(c, c)
        left = F.when(n > 0.0, F.greatest(F.lit(1.0) - dot(z, c) * dot(z, c) / n, F.lit(0.0))).otherwise(F.lit(1.0))
        return F.struct(F.sqrt(left).alias("dist"), q.alias("q"), F.try_divide(dot(z, c), dot(c, c)).alias("alpha"), z.alias("z"))
    shifts = F.sequence(F.lit(-max_shift), F.lit(max_shift))
    return F.array_min(F.transform(shifts, lambda q: let(shifted_crop(_col(x), q, length), lambda z: scored(q, z))))
