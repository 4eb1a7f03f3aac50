"""Global row numbers of tables and of text files."""

import os
import random

from pyspark.sql import functions as F

from wattle.operators.order import numbered, numbered_lines
from wattle.sources import text as tx


def test_positions_are_the_sorted_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice("abc"), rnd.random()) for _ in range(3000)]
    rows += [(7, "b", 0.5)] * 900      # equal rows are interchangeable
    d = spark.createDataFrame(rows, "k int, s string, v double").repartition(7)
    got = numbered(d, "k", "s", name="at").collect()
    assert sorted(r["at"] for r in got) == list(range(len(rows)))
    by_place = [(r["k"], r["s"], r["v"]) for r in sorted(got, key=lambda r: r["at"])]
    assert by_place == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_positions_of_nothing_and_of_arrays(spark):
    d = spark.createDataFrame([], "k int, x array<double>")
    assert numbered(d, "k").collect() == []
    d = spark.createDataFrame([(1, [2.0]), (1, [1.0]), (0, None)], "k int, x array<double>")
    assert [(r["k"], r["x"]) for r in numbered(d, "k").orderBy("pos").collect()] == [(0, None), (1, [1.0]), (1, [2.0])]


def test_no_window_sees_the_rows(spark):
    d = numbered(spark.range(0, 1000).withColumn("k", F.col("id") % 5), "k")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "HashAggregate" in plan.split("Window [")[1]


def test_lines_keep_the_order_of_files_and_blocks(spark, scratch):
    want = []
    for part in (2, 10, 100000, 99999):     # names alone would sort otherwise
        lines = [f"{part}:{i}:" + "x" * (i % 50) for i in range(400)]
        with open(os.path.join(scratch, f"part-{part:05d}-abc.txt"), "w") as f:
            f.write("\n".join(lines) + "\n")
        want.append((part, lines))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")     # many blocks for each file
        got = numbered_lines(spark, scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert [r["value"] for r in sorted(got, key=lambda r: r["pos"])] == [x for _, lines in sorted(want) for x in lines]
    assert sorted(r["pos"] for r in got) == list(range(1600))


def test_empty_files(spark, scratch):
    open(os.path.join(scratch, "part-00000"), "w").close()
    assert numbered_lines(spark, scratch).collect() == []


def test_written_order_is_read_back(spark, scratch):
    rnd = random.Random(3)
    pts = [(rnd.randrange(50), i, [rnd.random() for _ in range(3)]) for i in range(500)]
    d = spark.createDataFrame(pts, "meter_id long, i int, x array<double>").selectExpr("meter_id", "date_add(date'2024-01-01', i) AS day", "x").repartition(9)
    path = os.path.join(scratch, "points")
    tx.write_points(d, path, sort=True)
    got = tx.parse_points(tx.fields(numbered_lines(spark, path)), "pos").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(500))
    assert [(r["meter_id"], r["day"]) for r in got] == sorted((r["meter_id"], r["day"]) for r in d.collect())
