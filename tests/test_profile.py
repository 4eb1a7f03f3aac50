"""Regression betas against numpy least squares; fallbacks; activity profile."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattle.operators import profile as pf
from wattle.plans import catalog as C

from conftest import SF01

D0 = dt.date(2024, 1, 1)


def weather_rows(days, meter=1, hour=3, temp=lambda d: float((d * 13) % 36 - 2), seed=0):
    rng = np.random.default_rng(seed)
    return [(meter, D0 + dt.timedelta(days=d), hour, float(round(rng.gamma(2.0, 1.5), 2)), temp(d))
            for d in range(days)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "meter_id bigint, read_date date, hour int, reading double, temperature double")


def design(rows):
    ys, xs = [], []
    for i in range(3, len(rows)):
        t = rows[i][4]
        xs.append([rows[i - 1][3], rows[i - 2][3], rows[i - 3][3], max(t - 20, 0), max(16 - t, 0), max(5 - t, 0)])
        ys.append(rows[i][3])
    X = np.column_stack([np.ones(len(xs)), np.array(xs)])
    return X, np.array(ys)


def test_betas_match_least_squares(spark):
    rows = weather_rows(40)
    b = pf.fit_betas(frame(spark, rows)).first()
    X, y = design(rows)
    ref = np.linalg.lstsq(X, y, rcond=None)[0]
    assert not b.fallback and b.n_obs == 37
    assert [b[f"b{i}"] for i in range(7)] == pytest.approx(list(ref), rel=1e-7, abs=1e-9)


def test_residuals_orthogonal_to_regressors(spark):
    rows = weather_rows(60, seed=3)
    b = pf.fit_betas(frame(spark, rows)).first()
    X, y = design(rows)
    res = y - X @ np.array([b[f"b{i}"] for i in range(7)])
    assert np.abs(X.T @ res).max() < 1e-8 * max(1.0, np.abs(X.T @ y).max())


def test_fallback_too_few_observations(spark):
    b = pf.fit_betas(frame(spark, weather_rows(9))).first()
    assert b.fallback and b.n_obs == 6 and all(b[f"b{i}"] == 0.0 for i in range(7))


def test_fallback_singular_design(spark):
    rows = weather_rows(30, temp=lambda d: float(max((d * 13) % 36 - 2, 5)))   # never below 5 C
    b = pf.fit_betas(frame(spark, rows)).first()
    assert b.fallback and all(b[f"b{i}"] == 0.0 for i in range(7))


def test_activity_profile_matches_rows(spark):
    w = C.weather(spark, SF01)
    closed = pf.activity_profile(w)
    direct = pf.activity(w).groupBy("meter_id", "hour").agg(
        F.avg("activity").alias("m2"), F.stddev_pop("activity").alias("s2"))
    j = closed.join(direct, ["meter_id", "hour"])
    assert j.count() == closed.count()
    worst = j.select(F.max(F.abs(F.col("mean") - F.col("m2"))).alias("dm"),
                     F.max(F.abs(F.col("sd") - F.col("s2"))).alias("ds")).first()
    assert worst.dm < 1e-9 and worst.ds < 1e-6


def test_profile_arrays_fill_missing_hours(spark):
    p = spark.createDataFrame([(1, 0, 1.0, 0.5), (1, 5, 2.0, 0.1)], "meter_id bigint, hour int, mean double, sd double")
    r = pf.profile_arrays(p).first()
    assert r.mean[0] == 1.0 and r.mean[5] == 2.0 and r.mean[1] == 0.0 and len(r.mean) == 24


def test_copies_match_expanded_least_squares(spark):
    base = weather_rows(30, seed=5)
    # exact copies: day 7 three times, day 12 twice, and day 20 repeated so that copies hold
    # a third of all rows
    rows = list(base) + [base[7]] * 2 + [base[12]] + [base[20]] * 15
    rows_sorted = sorted(rows, key=lambda r: (r[1], r[3], r[4]))
    b = pf.fit_betas(frame(spark, rows)).first()
    X, y = design(rows_sorted)
    ref = np.linalg.lstsq(X, y, rcond=None)[0]
    assert b.n_obs == len(rows) - 3 and not b.fallback
    assert [b[f"b{i}"] for i in range(7)] == pytest.approx(list(ref), rel=1e-7, abs=1e-9)
    lags = sorted((r.read_date, r.lag1, r.lag2, r.lag3) for r in pf.with_lags(frame(spark, rows)).collect())
    assert len(lags) == len(rows)
    expect = sorted((rows_sorted[i][1], rows_sorted[i - 1][3] if i >= 1 else None,
                     rows_sorted[i - 2][3] if i >= 2 else None, rows_sorted[i - 3][3] if i >= 3 else None)
                    for i in range(len(rows_sorted)))
    assert lags == expect
    # activity profile over the expanded rows
    act = [r[3] - b.b4 * max(r[4] - 20, 0) - b.b5 * max(16 - r[4], 0) - b.b6 * max(5 - r[4], 0) for r in rows]
    p = pf.activity_profile(frame(spark, rows)).first()
    assert p.mean == pytest.approx(np.mean(act), rel=1e-9) and p.sd == pytest.approx(np.std(act), rel=1e-7)


def test_copies_never_reach_the_window_as_rows(spark):
    plan = pf.fit_betas(frame(spark, weather_rows(12)))._jdf.queryExecution().executedPlan().toString()
    # the copy-collapsing aggregate is combined before its shuffle; the window sees its output
    assert "partial_count" in plan
    lag_window_input = plan.split("Window [")[-1]      # the deepest window is the lag window
    assert "HashAggregate" in lag_window_input and "functions=[count(1)]" in lag_window_input


def expected_lags(rows):
    """meter, hour -> rows ordered by (date, reading, temperature) with their lags, nulls first."""
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[2]), []).append(r)
    out = []
    for g in groups.values():
        g.sort(key=lambda r: (r[1] is not None, r[1] or D0, r[3], r[4]))
        out += [(*r, *[g[i - k][3] if i >= k else None for k in (1, 2, 3)]) for i, r in enumerate(g)]
    return out


def sorted_rows(rows):
    return sorted(map(repr, rows))


def test_lags_across_blocks(spark):
    rng = np.random.default_rng(4)
    rows = []
    # dense months, months of one and two rows, gaps of years, several rows a date, null dates
    for meter, gaps in ((1, [1] * 200), (2, [31, 40, 29, 62, 400, 15, 16, 1, 1, 45]), (3, [0, 0, 0, 0, 30, 0, 31, 0, 0, 90])):
        day = 0
        for gap in gaps:
            day += gap
            rows.append((meter, D0 + dt.timedelta(days=day), 3, float(rng.integers(0, 50)), float(rng.integers(-5, 30))))
    rows += [(3, None, 3, 7.0, 1.0), (3, None, 3, 8.0, 1.0), (4, None, 3, 1.0, 2.0)]
    rows += [rows[5]] * 6 + [rows[198]] * 2 + [rows[203]] * 4      # copies inside and at the edges of blocks
    got = pf.with_lags(frame(spark, rows).repartition(3)).select("meter_id", "read_date", "hour", "reading", "temperature", "lag1", "lag2", "lag3")
    assert sorted_rows(tuple(r) for r in got.collect()) == sorted_rows(expected_lags(rows))


def test_betas_across_blocks_match_least_squares(spark):
    rows = weather_rows(400, seed=8)
    b = pf.fit_betas(frame(spark, rows)).first()
    X, y = design(rows)
    assert b.n_obs == 397
    assert [b[f"b{i}"] for i in range(7)] == pytest.approx(list(np.linalg.lstsq(X, y, rcond=None)[0]), rel=1e-8, abs=1e-10)


def test_large_readings_keep_their_digits(spark):
    # differences of 1e-3 on readings of a million: raw sums of squares would lose them
    rows = [(m, d, h, 1e6 + r / 1000, t) for m, d, h, r, t in weather_rows(90, seed=11)]
    b = pf.fit_betas(frame(spark, rows)).first()
    X, y = design(rows)
    shift = X - np.array([0, 1e6, 1e6, 1e6, 0, 0, 0])
    ref = np.linalg.lstsq(shift, y - 1e6, rcond=None)[0]
    assert [b[f"b{i}"] for i in range(1, 7)] == pytest.approx(list(ref[1:]), rel=1e-5, abs=1e-8)


def test_rows_without_values_are_no_observations(spark):
    rows = weather_rows(60, seed=2)
    gaps = [(m, d, h, None if i in (20, 41) else r, None if i == 33 else t) for i, (m, d, h, r, t) in enumerate(rows)]
    b = pf.fit_betas(frame(spark, gaps)).first()
    seen = [i for i in range(3, 60) if i != 33 and not {i, i - 1, i - 2, i - 3} & {20, 41}]
    X, y = design(rows)
    at = [i - 3 for i in seen]
    assert b.n_obs == len(seen)
    assert [b[f"b{i}"] for i in range(7)] == pytest.approx(list(np.linalg.lstsq(X[at], y[at], rcond=None)[0]), rel=1e-7, abs=1e-9)


def test_lags_constant_but_for_the_first_row_are_singular(spark):
    # the first reading differs and the last three lags never see it: no spread, not a tiny one
    rows = [(1, D0 + dt.timedelta(days=d), 3, 7.31 if d == 0 else 0.1, float((d * 13) % 36 - 2)) for d in range(25)]
    shifted = [(2, d, h, r, t) for _, d, h, r, t in rows[:1]] + [(2, D0 + dt.timedelta(days=400 + d), 3, 0.1, float((d * 13) % 36 - 2)) for d in range(25)]
    for r in pf.fit_betas(frame(spark, rows + shifted)).collect():
        assert r.fallback and r.b1 == 0.0


def test_empty_input(spark):
    d = frame(spark, [])
    for out in (pf.with_lags(d), pf.fit_betas(d), pf.activity_profile(d), pf.activity(d)):
        assert out.collect() == []


def test_lag_expansion_in_chunks(spark):
    from wattle.operators import profile as prof
    old = prof.COPY_CHUNK
    prof.COPY_CHUNK = 3
    try:
        rows = weather_rows(6, seed=9) + [weather_rows(6, seed=9)[2]] * 7
        rows_sorted = sorted(rows, key=lambda r: (r[1], r[3], r[4]))
        got = sorted((r.read_date, r.lag1, r.lag2, r.lag3) for r in pf.with_lags(frame(spark, rows)).collect())
        expect = sorted((rows_sorted[i][1], rows_sorted[i - 1][3] if i >= 1 else None,
                         rows_sorted[i - 2][3] if i >= 2 else None, rows_sorted[i - 3][3] if i >= 3 else None)
                        for i in range(len(rows_sorted)))
        assert got == expect
    finally:
        prof.COPY_CHUNK = old
