"""The text data source: kept and rejected lines, byte ranges, pushed filters."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from wattle.operators import prepare
from wattle.sources import datasource as ds
from wattle.sources import text as tx


def put(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_ranges_give_every_line_once(scratch):
    rng = random.Random(4)
    lines = ["x" * rng.choice([0, 0, 1, 3, 17, 40]) for _ in range(60)] + ["the last"]
    data = "\n".join(lines).encode()
    for end in (b"", b"\n"):
        p = put(os.path.join(scratch, f"f{len(end)}"), data + end)
        size = len(data + end)
        for step in (1, 2, 7, 50, size):
            for block in (1, 3, 64, 1 << 20):
                got = [x for a in range(0, size, step) for arr in ds.blocks(p, a, min(a + step, size), block) for x in arr.to_pylist()]
                assert got == lines, (step, block)


READINGS = ["7\t2024-01-05 03:00:00\t1.5", "7\t2024-01-05 23:00:00-06\t1e1", "7\t2024-01-05 04:00:00\t", "7\t2024-01-05 04:00:00\t1a5",
            "7\t2024-01-05 04:00:00\t.5", "7\t2024-01-05 24:00:00\t1", "7\t2024-04-31 04:00:00\t1", "x\t2024-01-05 04:00:00\t1",
            "7\t2024-01-05 04:00:00", "", "-3\t2023-12-31 00:00:00\t-2\tmore\tfields", "7\t2024-01-05\t1"]


def test_readings_as_the_spark_reader_keeps_them(spark, scratch):
    p = os.path.join(scratch, "r")
    os.makedirs(os.path.join(p, "_hidden"))
    put(os.path.join(p, "a.txt"), "\n".join(READINGS[:5]).encode())
    put(os.path.join(p, "b.txt"), "\r\n".join(READINGS[5:]).encode() + b"\r\n")
    put(os.path.join(p, "_hidden", "c.txt"), b"no input")
    put(os.path.join(p, ".d.txt"), b"no input")
    for size in (10, 1000):
        d = ds.read(spark, p, "readings", bytes=str(size))
        assert sorted(r["line"] for r in d.collect()) == sorted(READINGS)
        want = prepare.ingest_lines(spark.createDataFrame([(x,) for x in READINGS], "line string"))
        assert sorted(map(tuple, ds.kept(spark, p, "readings", bytes=str(size)).collect())) == sorted(map(tuple, want.collect()))
        reasons = {r["line"]: r["reason"] for r in ds.rejected(spark, p, "readings", bytes=str(size)).collect()}
        assert reasons == {READINGS[2]: "reading", READINGS[3]: "reading", READINGS[4]: "reading", READINGS[5]: "day", READINGS[6]: "day",
                           READINGS[7]: "meter_id", READINGS[8]: "fields", READINGS[9]: "fields", READINGS[11]: "day"}


def test_filters_are_pushed(spark, scratch):
    p = put(os.path.join(scratch, "t"), "\n".join(READINGS).encode())
    d = ds.read(spark, p, "readings").where(
        (F.col("meter_id") == 7) & (F.col("day") >= dt.date(2024, 1, 1)) & F.col("hour").isin(3, 4) & F.col("reason").isNull())
    assert "Filter (" not in d._jdf.queryExecution().executedPlan().toString()
    assert [(r["meter_id"], r["hour"], r["reading"]) for r in d.collect()] == [(7, 3, 1.5)]
    d = ds.read(spark, p, "readings").where("reading > 1.0 and (hour = 3 or meter_id = -3)")   # left to Spark
    assert [r["hour"] for r in d.collect()] == [3]


def test_every_kind_round_trips(spark, scratch):
    at = lambda n: os.path.join(scratch, n)
    pts = spark.createDataFrame([(12, dt.date(2024, 2, 29), [0.5, 1e-7, float("inf")]), (7, dt.date(2099, 12, 31), [1.0])], "meter_id bigint, day date, x array<double>")
    tx.write_points(pts, at("points"))
    tx.write_shares(spark.createDataFrame([(1, 60.0, [0.5, 0.5])], "cid int, share double, c array<double>"), at("shares"))
    tx.write_entropy(spark.createDataFrame([(5, 0.5), (6, 0.0)], "meter_id bigint, entropy double"), at("entropies"))
    tx.write_elbow(spark.createDataFrame([(2, 0.25, 10.0)], "k int, coverage double, ch double"), at("elbow"))
    tx.write_centroids(spark.createDataFrame([(2, 1, [1.0, 0.0])], "cid int, n bigint, c array<double>"), at("centroids"))
    tx.write_profiles(spark.createDataFrame([(3, [0.1] * 24, [0.2] * 24)], "meter_id bigint, mean array<double>, sd array<double>"), at("profiles"))
    tx.write_tagged(spark.createDataFrame([(9, dt.date(2024, 1, 1), 2, [0.5], [0.25])], "meter_id bigint, day date, cid int, original array<double>, shifted array<double>"), at("tagged"))
    for kind, reader in (("points", tx.read_points), ("shares", tx.read_shares), ("entropies", tx.read_entropy), ("elbow", tx.read_elbow),
                         ("profiles", tx.read_profiles), ("tagged", tx.read_tagged)):
        got, want = ds.kept(spark, at(kind), kind), reader(spark, at(kind))
        assert got.columns == want.columns
        assert sorted(map(repr, map(list, got.collect()))) == sorted(map(repr, map(list, want.collect()))), kind
        assert ds.rejected(spark, at(kind), kind).count() == 0
    assert ds.kept(spark, at("centroids"), "centroids").first()["c"] == [1.0, 0.0]


def test_broken_and_empty_inputs(spark, scratch):
    p = put(os.path.join(scratch, "p"), b"7240105|1,2,x\n7249905|1\n240105|1\n|1\n7240105\n7240105|1,2\n7240105|\xff\n")
    got = ds.read(spark, p, "points").collect()
    assert [r["reason"] for r in got] == ["x", "meter_id", "meter_id", "meter_id", "fields", None, "x"]
    assert all(r["meter_id"] is None and r["day"] is None and r["x"] is None for r in got if r["reason"])
    empty = os.path.join(scratch, "none")
    os.makedirs(empty)
    assert ds.read(spark, empty, "points").count() == 0
    put(os.path.join(empty, "e"), b"")
    assert ds.kept(spark, empty, "points").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        ds.read(spark, p, "other")
