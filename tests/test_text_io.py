"""Text formats: write then read back."""

import datetime as dt
import os

from wattle.sources import text as tx


def test_points_centroids_profiles_roundtrip(spark, scratch):
    pts = spark.createDataFrame([(12, dt.date(2024, 1, 5), [0.5, 1.25, 3.0]), (7, dt.date(2023, 12, 31), [1.0, 2.0, 4.0])],
                                "meter_id bigint, day date, x array<double>")
    tx.write_points(pts, os.path.join(scratch, "p"), sort=True)
    back = sorted(tuple(r) for r in tx.read_points(spark, os.path.join(scratch, "p")).collect())
    assert back == sorted(tuple(r) for r in pts.collect())
    cents = spark.createDataFrame([(1, 1, [0.25, 0.75]), (2, 1, [1.0, 0.0])], "cid int, n bigint, c array<double>")
    tx.write_centroids(cents, os.path.join(scratch, "c"))
    assert sorted(tuple(r) for r in tx.read_centroids(spark, os.path.join(scratch, "c")).collect()) == \
        sorted(tuple(r) for r in cents.collect())
    prof = spark.createDataFrame([(3, [0.1] * 24, [0.2] * 24)], "meter_id bigint, mean array<double>, sd array<double>")
    tx.write_profiles(prof, os.path.join(scratch, "pr"))
    r = tx.read_profiles(spark, os.path.join(scratch, "pr")).first()
    assert r.meter_id == 3 and r.mean == [0.1] * 24 and r.sd == [0.2] * 24
    longf = tx.profiles_long(tx.read_profiles(spark, os.path.join(scratch, "pr")))
    assert longf.count() == 24


def test_temperature_seed_first_line_only(spark, scratch):
    p = os.path.join(scratch, "t.txt")
    with open(p, "w") as f:
        f.write("1.5|2|-3.25\n9|9|9\n")
    rows = [tuple(r) for r in tx.read_temperature_seed(spark, p).orderBy("pos").collect()]
    assert rows == [(0, 1.5), (1, 2.0), (2, -3.25)]


def test_result_tables(spark, scratch):
    ent = spark.createDataFrame([(5, 0.5), (6, 0.0)], "meter_id bigint, entropy double")
    tx.write_entropy(ent, os.path.join(scratch, "e"))
    assert sorted(tuple(r) for r in tx.read_entropy(spark, os.path.join(scratch, "e")).collect()) == [(5, 0.5), (6, 0.0)]
    el = spark.createDataFrame([(2, 0.3, 10.0), (3, 0.45, 12.5)], "k int, coverage double, ch double")
    tx.write_elbow(el, os.path.join(scratch, "k"))
    assert [tuple(r) for r in tx.read_elbow(spark, os.path.join(scratch, "k")).orderBy("k").collect()] == \
        [(2, 0.3, 10.0), (3, 0.45, 12.5)]
    sh = spark.createDataFrame([(1, 60.0, [0.5, 0.5])], "cid int, share double, c array<double>")
    tx.write_shares(sh, os.path.join(scratch, "s"))
    assert tuple(tx.read_shares(spark, os.path.join(scratch, "s")).first()) == (1, 60.0, [0.5, 0.5])
    tg = spark.createDataFrame([(9, dt.date(2024, 1, 1), 2, [0.5, 0.5], [0.25, 0.75])],
                               "meter_id bigint, day date, cid int, original array<double>, shifted array<double>")
    tx.write_tagged(tg, os.path.join(scratch, "tg"), sort=True)
    assert tuple(tx.read_tagged(spark, os.path.join(scratch, "tg")).first()) == (2, [0.5, 0.5], [0.25, 0.75])


def test_weather_csv_drops_malformed(spark, scratch):
    p = os.path.join(scratch, "w")
    os.makedirs(p)
    with open(os.path.join(p, "part.csv"), "w") as f:
        f.write("1,2024-01-02,5,1.5,12.0\nbad,line\n2,2024-01-03,6,0.5,-1\n")
    rows = sorted(tuple(r) for r in tx.read_weather(spark, p).collect())
    assert rows == [(1, dt.date(2024, 1, 2), 5, 1.5, 12.0), (2, dt.date(2024, 1, 3), 6, 0.5, -1.0)]


def test_synthetic_line_format(spark):
    from wattle.operators.synthesize import format_lines
    df = spark.createDataFrame([(3, dt.datetime(2024, 2, 1, 7), 0.5, 12.25)],
                               "series_id bigint, read_ts timestamp_ntz, load double, temperature double")
    assert format_lines(df).first().value == "3|2024-02-01 7:00:00|0.500000|12.250000"
