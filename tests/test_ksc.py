"""K-SC assignment, update, quality invariants and entropy."""

import math
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattle.functions import shapes as S
from wattle.operators import ksc
from wattle.plans import catalog as C

from conftest import SF01


def brute(x, model, max_shift):
    best = None
    w = len(x)
    for cid, (_, c) in sorted(model.items()):
        for q in range(-max_shift, max_shift + 1):
            qe = 0 if abs(q) >= w else q
            s = (w - 24) // 2
            z = [x[(i + s + qe) % w] for i in range(24)]
            t = 0.0
            for v in z:
                t += v
            z = z if t == 0 else [v / t for v in z]
            d = 0.0
            for a, b in zip(z, c):
                d += (a - b) * (a - b)
            cand = (math.sqrt(d), cid, q)
            if best is None or cand < best:
                best = cand
    return best


@pytest.fixture(scope="module")
def pts(spark):
    return C.stable_points(spark, SF01)


def test_assign_is_true_minimum(spark, pts):
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 4))
    for method in ("sql", "arrow"):
        rows = ksc.assign(pts, seeds, 1, method=method).limit(200).collect()
        for r in rows:
            d, cid, q = brute(list(r.x), seeds, 1)
            assert (r.cid, r.q) == (cid, q)
            assert r.dist == pytest.approx(d, abs=1e-12)


def test_tie_goes_to_lowest_cid(spark):
    x = [float(1 + (i % 5)) for i in range(26)]
    c = [0.1] * 12 + [0.0] * 12
    model = {2: (1, c), 1: (1, list(c))}
    df = spark.createDataFrame([(1, x)], "meter_id bigint, x array<double>")
    for method in ("sql", "arrow"):
        assert ksc.assign(df, model, 1, method=method).first().cid == 1


def test_kernel_equals_sql_exactly(spark, pts):
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 7))
    a = ksc.assign(pts, seeds, 2, method="sql").select("meter_id", "day", "cid", "q", "dist", "z")
    b = ksc.assign(pts, seeds, 2, method="arrow").select(
        "meter_id", "day", *[F.col(c).alias(c + "2") for c in ("cid", "q", "dist", "z")])
    j = a.join(b, ["meter_id", "day"])
    assert j.count() == pts.count()
    bad = j.where((F.col("cid") != F.col("cid2")) | (F.col("q") != F.col("q2")) |
                  (F.col("dist") != F.col("dist2")) | (F.col("z") != F.col("z2")))
    assert bad.count() == 0


@pytest.mark.parametrize("method", ["sql", "arrow"])
@pytest.mark.parametrize("x", [[1.0] * 23, [1.0] * 23 + [float("nan")], [1.0] * 23 + [None], [1.0] * 23 + [float("inf")]])
def test_short_and_non_finite_points_raise(spark, method, x):
    df = spark.createDataFrame([(1, x)], "meter_id bigint, x array<double>")
    with pytest.raises(Exception, match="finite|hours"):
        ksc.assign(df, {1: (1, [0.1] * 24)}, 1, method=method).collect()


def test_non_finite_points_are_left_out_of_a_fit(spark, pts):
    some = pts.select("meter_id", "day", "x").orderBy("meter_id", "day").limit(40)
    bad = spark.createDataFrame([(9, None, [1.0] * 25 + [float("nan")]), (9, None, [1.0] * 25 + [None]), (9, None, [])],
                                some.schema)
    dirty = some.unionByName(bad)
    assert ksc.rejected(dirty) == 3
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(dirty), 3))
    assert seeds == ksc.collect_model(ksc.sample_seeds(C.pool(some), 3))
    clean, same = ksc.fit(ksc.stable(some), seeds), ksc.fit(ksc.stable(dirty), seeds)
    assert clean.converged and {k: n for k, (n, _) in clean.model.items()} == {k: n for k, (n, _) in same.model.items()}


def test_many_centroids(spark):
    rng = np.random.default_rng(1)
    C_ = rng.random((2000, 24))
    model = {i: (1, list(c)) for i, c in enumerate(C_)}
    X = rng.random((30, 24))
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)], "meter_id bigint, x array<double>")
    Z = X / X.sum(axis=1, keepdims=True)
    want = ((Z[:, None, :] - C_[None]) ** 2).sum(axis=2).argmin(axis=1)
    got = {r.meter_id: r.cid for r in ksc.assign(df, model, 0).collect()}
    assert [got[i] for i in range(30)] == list(want)


def test_one_tag_for_each_id(spark, pts):
    twice = pts.select("meter_id", "day", "x").union(pts.select("meter_id", "day", F.reverse("x")))
    one = ksc.one_per_id(twice)
    assert one.count() == pts.count()
    assert one.join(twice, ["meter_id", "day", "x"], "left_semi").count() == pts.count()


def test_quality_invariants(spark, pts):
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 5))
    res = ksc.fit(pts, seeds, 3, 0.0, 1)
    a = ksc.assign(pts, res.assigning_model, 1)
    q = types.SimpleNamespace(**ksc.quality(res.model, res.squares, 5))
    ssw = a.join(ksc.model_frame(spark, res.model), "cid").select(F.sum(S.sq_distance("z", "c"))).first()[0]
    assert q.ssw == pytest.approx(ssw, rel=1e-9)
    assert q.sst == pytest.approx(q.ssb + q.ssw, rel=1e-9)
    assert q.ssw <= q.sst
    assert 0.0 <= q.coverage <= 1.0
    shares = ksc.centroid_shares(ksc.model_frame(spark, res.model)).collect()
    assert sum(r.share for r in shares) == pytest.approx(100.0)
    assert sum(r.n for r in shares) == q.n_points == pts.count()
    ent = ksc.meter_entropy(a).collect()
    assert all(0.0 <= r.entropy <= math.log(5) + 1e-12 for r in ent)
    assert all(math.copysign(1.0, r.entropy) > 0 for r in ent)


def test_k1_has_zero_coverage_and_no_ch(spark, pts):
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 1))
    res = ksc.fit(pts, seeds, 2, 0.0, 1)
    q = ksc.quality(res.model, res.squares, 1)
    assert q["coverage"] == pytest.approx(0.0, abs=1e-9)
    assert q["ch"] is None


def test_entropy_values(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1), (2, 2)], "meter_id bigint, cid int")
    got = {r.meter_id: r.entropy for r in ksc.meter_entropy(df).collect()}
    assert got[1] == 0.0 and math.copysign(1.0, got[1]) == 1.0
    assert got[2] == pytest.approx(math.log(2))


def test_histogram_puts_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0.0, 0.5, 1.0, 1.0)], "entropy double")
    h = {r.bin: r.n for r in ksc.entropy_histogram(df, 4).collect()}
    assert h == {1: 1, 2: 0, 3: 1, 4: 2}


def test_sweep_stops_at_coverage(spark, pts):
    res = ksc.sweep(pts, C.pool(pts), 2, 6, 0.0, 1, 0.0, 1)
    assert [r["k"] for r in res.table] == [2]
    with pytest.raises(ValueError):
        ksc.sweep(pts, C.pool(pts), 3, 2, 0.5)


def test_stable_points_spread_over_task_slots(spark, pts):
    assert pts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pts.count() == C.points(spark, SF01).count()


def test_several_models_in_one_pass(spark, pts):
    pool = C.pool(pts)
    seeds = {k: ksc.collect_model(ksc.sample_seeds(pool, k)) for k in (2, 3, 5)}
    rows = ksc.update_many(pts, seeds).collect()
    for k, model in seeds.items():
        alone = {r["cid"]: r for r in ksc.update(ksc.assign(pts, model)).collect()}
        mine = {r["cid"]: r for r in rows if r["k"] == k}
        assert {c: r["n"] for c, r in mine.items()} == {c: r["n"] for c, r in alone.items()}
        for c, r in mine.items():
            assert r["c"] == pytest.approx(alone[c]["c"], rel=1e-12) and r["ss"] == pytest.approx(alone[c]["ss"], rel=1e-12)


def test_sweep_passes_are_those_of_the_slowest(spark, pts):
    pool = C.pool(pts)
    runs = {n: ksc.sweep(pts, pool, 2, 6, 2.0, 12, 1e-4, 1, together=n) for n in (1, 2, 5)}
    turns = [r["iterations"] for r in runs[1].table]
    assert runs[1].scans == sum(turns)
    assert runs[2].scans == max(turns[:2]) + max(turns[2:4]) + turns[4]
    assert runs[5].scans == max(turns)
    for n in (2, 5):
        for a, b in zip(runs[1].table, runs[n].table, strict=True):
            assert (a["k"], a["iterations"], a["k_effective"]) == (b["k"], b["iterations"], b["k_effective"])
            assert a["coverage"] == pytest.approx(b["coverage"], rel=1e-9)
    for r in runs.values():
        r.assigned.unpersist()


def test_sweep_keeps_the_first_k_that_reaches_the_coverage(spark, pts):
    pool = C.pool(pts)
    every = ksc.sweep(pts, pool, 2, 6, 2.0, 3)
    at = every.table[1]["coverage"]
    for n in (1, 4):
        r = ksc.sweep(pts, pool, 2, 6, at - 1e-9, 3, together=n)
        assert [x["k"] for x in r.table] == [x["k"] for x in every.table if x["k"] <= r.fit.k] and r.fit.k <= 3
        r.assigned.unpersist()
    every.assigned.unpersist()


def test_stable_points_do_not_follow_the_shuffle_partitions(spark):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        d = ksc.stable(spark.createDataFrame([(1, [1.0] * 24)] * 50, "meter_id long, x array<double>"))
        assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_scaled_distance_is_the_least_over_scales(spark):
    rng = np.random.default_rng(6)
    x, c = rng.gamma(2.0, 1.0, 26), rng.gamma(2.0, 1.0, 24)
    d = spark.createDataFrame([([float(v) for v in x], [float(v) for v in c]), ([0.0] * 26, [1.0] * 24)], "x array<double>, c array<double>")
    got, zero = [r["d"] for r in d.select(S.scaled_distance("x", "c", 1).alias("d")).collect()]
    grid = []
    for q in (-1, 0, 1):
        z = np.array([x[(i + 1 + q) % 26] for i in range(24)])
        grid += [(np.linalg.norm(z - a * c) / np.linalg.norm(z), q) for a in np.linspace(0, 3, 30001)]
    assert got["dist"] == pytest.approx(min(grid)[0], abs=1e-7) and got["q"] == min(grid)[1]
    assert np.linalg.norm(np.array(got["z"]) - got["alpha"] * c) / np.linalg.norm(got["z"]) == pytest.approx(got["dist"], rel=1e-9)
    assert zero["dist"] == 1.0 and zero["alpha"] == 0.0


def test_spectral_centroids_are_least_squares(spark, pts):
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 3))
    a = ksc.assign_scaled(pts, seeds).select("cid", "z").collect()
    model = ksc.update_scaled(ksc.assign_scaled(pts, seeds))
    for cid, (n, c) in model.items():
        z = np.array([r["z"] for r in a if r["cid"] == cid])
        norm = np.linalg.norm(z, axis=1)        # a day without consumption has no direction
        z = z / np.where(norm > 0, norm, 1.0)[:, None]
        cost = lambda v: len(z) - ((z @ v / np.linalg.norm(v)) ** 2).sum()
        assert n == len(z) and np.linalg.norm(c) == pytest.approx(1.0)
        assert cost(np.array(c)) <= cost(z.mean(axis=0)) + 1e-9
        lead = np.linalg.svd(z)[2][0]
        assert abs(abs(lead @ np.array(c)) - 1.0) < 1e-9


def test_scaled_fit_never_gets_worse(spark, pts):
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 3))
    costs = [ksc.fit_scaled(pts, seeds, max_iter=i).squares for i in (1, 2, 4)]
    assert costs == sorted(costs, reverse=True) and costs[-1] < costs[0]
