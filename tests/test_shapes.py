"""Hand-computed fixtures for the array functions and row rules."""

import math

import pytest
from pyspark.sql import functions as F

from wattle.functions import shapes as S
from wattle.functions.regimes import temperature_terms


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ",".join(f"{k} {t}" for k, (t) in
                                                             [(k, _type(v)) for k, v in cols.items()]))
    return df.select(expr.alias("r")).first()["r"]


def _type(v):
    if isinstance(v, list):
        return "array<double>"
    if isinstance(v, int):
        return "int"
    return "double"


def test_rotate(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    assert one(spark, S.rotate("x", 1), x=x) == [2.0, 3.0, 4.0, 1.0]
    assert one(spark, S.rotate("x", -1), x=x) == [4.0, 1.0, 2.0, 3.0]
    assert one(spark, S.rotate("x", 0), x=x) == x
    assert one(spark, S.rotate("x", 4), x=x) == x
    assert one(spark, S.rotate("x", 5), x=x) == x      # |q| >= n: unchanged, not q mod n


def test_crop(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert one(spark, S.crop("x", 2), x=x) == [2.0, 3.0]
    assert one(spark, S.crop("x", 5), x=x) == x
    assert one(spark, S.crop("x", 9), x=x) == x


def test_shifted_crop_equals_rotate_then_crop(spark):
    x = [float(v) for v in range(1, 27)]
    for q in (-3, -1, 0, 1, 2, 26, 30):
        a = one(spark, S.shifted_crop("x", q, 24), x=x)
        b = one(spark, S.crop(S.rotate("x", q), 24), x=x)
        assert a == b, q


def test_normalize(spark):
    assert one(spark, S.normalize("x"), x=[1.0, 3.0]) == [0.25, 0.75]
    assert one(spark, S.normalize("x"), x=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, S.normalize("x"), x=[1.0, -1.0]) == [1.0, -1.0]


def test_distance_skips_nan(spark):
    assert one(spark, S.euclidean("a", "b"), a=[0.0, float("nan"), 3.0], b=[4.0, 1.0, 0.0]) == 5.0


def test_distance_length_mismatch_raises(spark):
    with pytest.raises(Exception):
        one(spark, S.euclidean("a", "b"), a=[0.0, 1.0], b=[1.0, 2.0, 3.0])


def test_cosine(spark):
    assert one(spark, S.cosine("a", "b"), a=[1.0, 0.0], b=[0.0, 2.0]) == 0.0
    assert abs(one(spark, S.cosine("a", "b"), a=[1.0, 1.0], b=[2.0, 2.0]) - 1.0) < 1e-12


def test_ksc_distance_finds_shift(spark):
    x = [float((i * 7) % 11 + 1) for i in range(26)]
    core = x[2:26]
    c = [v / sum(core) for v in core]
    r = one(spark, S.ksc_distance("x", "c", 1), x=x, c=c)
    assert r["q"] == 1
    assert r["dist"] < 1e-12


def test_temperature_terms(spark):
    df = spark.createDataFrame([(25.0,), (18.0,), (10.0,), (0.0,)], "t double")
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(temperature_terms(F.col("t")))]).collect()
    assert [tuple(r) for r in rows] == [(5.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 6.0, 0.0), (0.0, 16.0, 5.0)]


def test_let_binding_evaluates_once_semantics(spark):
    assert one(spark, S.let(F.col("x"), lambda a: F.size(a) + F.lit(1)), x=[1.0, 2.0]) == 3


def test_sq_distance_unrolled_matches(spark):
    a, b = [0.1 * i for i in range(24)], [0.05 * i * i for i in range(24)]
    from wattle.functions.literals import sql_double
    u = one(spark, S.sq_distance_unrolled("a", [sql_double(v) for v in b]), a=a)
    v = one(spark, S.sq_distance("a", "b"), a=a, b=b)
    assert u == v
    assert math.isclose(u, sum((p - q) ** 2 for p, q in zip(a, b)), rel_tol=1e-12)
