"""Ingest rules, completeness, extended windows and seeds."""

import datetime as dt

from wattle.operators import prepare as pr

D0 = dt.date(2024, 1, 1)


def readings(spark, rows):
    return spark.createDataFrame(rows, "meter_id bigint, day date, hour int, reading double")


def day_rows(meter, day, hours, value=1.0):
    return [(meter, day, h, value) for h in hours]


def test_numeric_rule_and_parse(spark):
    lines = ["1\t2024-01-01 05:00:00\t1.5", "1\t2024-01-01 06:00:00\t", "1\t2024-01-01 07:00:00\t1a5",
             "1\t2024-01-01 08:00:00\t.5", "1\t2024-01-01 09:00:00\t1e1", "1\t2024-01-01 10:00:00-06\t2",
             "1\t2024-01-01 11:00:00\t-3.25\textra", "x\t2024-01-01 12:00:00\t1", "1\t2024-01-01 25:00:00\t1",
             "1\t2024-01-01 13:00:00", "1\tgarbage\t1", "1\t2024-01-01 14:00:00\t+1", "1\t2024-01-01 15:00:00\tNaN"]
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    got = sorted((r.hour, r.reading) for r in pr.ingest_lines(df).collect())
    assert got == [(5, 1.5), (9, 10.0), (10, 2.0), (11, -3.25)]


def test_completeness(spark):
    h24 = list(range(24))
    rows = (day_rows(1, D0, h24)                                     # keep
            + day_rows(2, D0, h24[:23])                              # 23 rows: drop
            + day_rows(3, D0, h24 + [5])                             # 25 rows: drop
            + day_rows(4, D0, h24[:23] + [0])                        # duplicate + missing: drop (strict)
            + day_rows(5, D0, h24, 0.0))                             # zero sum: drop
    days = pr.complete_days(readings(spark, rows))
    assert [r.meter_id for r in days.collect()] == [1]
    lax = pr.complete_days(readings(spark, rows), strict=False)
    assert sorted(r.meter_id for r in lax.collect()) == [1, 4]


def test_extended_window_uses_adjacent_valid_days(spark):
    rows = []
    for d in (1, 2, 4):
        rows += [(1, D0 + dt.timedelta(days=d - 1), h, float(100 * d + h)) for h in range(24)]
    days = pr.complete_days(readings(spark, rows))
    pts = pr.daily_points(days, 26).collect()
    assert len(pts) == 1
    p = pts[0]
    assert p.day == D0 + dt.timedelta(days=1)
    assert p.x[0] == 123.0 and p.x[-1] == 400.0 and p.x[1:25] == [float(200 + h) for h in range(24)]
    assert len(pr.daily_points(days, 24).collect()) == 3


def test_window_validation():
    import pytest
    assert [pr.check_window(w) for w in (24, 25, 26, 27, 72, 73)] == [0, 0, 1, 1, 24, 24]
    for bad in (23, 74):
        with pytest.raises(ValueError):
            pr.check_window(bad)


def test_seeds_reproducible_and_normalised(spark):
    rows = []
    for m in range(5):
        for d in range(6):
            rows += [(m, D0 + dt.timedelta(days=d), h, float(1 + (m * 7 + d * 3 + h) % 5)) for h in range(24)]
    pts = pr.daily_points(pr.complete_days(readings(spark, rows)), 26)
    a = pr.seed_centroids(pts, 7).orderBy("cid").collect()
    b = pr.seed_centroids(pts.repartition(3), 7).orderBy("cid").collect()
    assert [r.c for r in a] == [r.c for r in b]
    assert [r.cid for r in a] == list(range(1, 8))
    assert all(abs(sum(r.c) - 1.0) < 1e-12 and len(r.c) == 24 for r in a)
    assert pr.seed_centroids(pts, 1000).count() == pts.count()
