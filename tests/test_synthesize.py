"""Generator: counts, ranges, reproducibility, distribution of the draws."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattle.functions import draws
from wattle.operators import synthesize as syn


@pytest.fixture(scope="module")
def inputs(spark):
    prof = spark.createDataFrame([(m, [0.2 + 0.01 * m * h for h in range(24)]) for m in range(1, 6)],
                                 "meter_id bigint, mean array<double>")
    temps = spark.createDataFrame([(i, float(-5 + (i * 7) % 40)) for i in range(50)], "pos long, temperature double")
    return prof, temps


def test_counts_ranges(spark, inputs):
    prof, temps = inputs
    s = syn.synthesize(prof, temps, 37, 3, "2024-02-01", 1.5, 4, 11, detail=True)
    assert s.count() == 37 * 3 * 24
    r = s.agg(F.min("thermal"), F.max("thermal"), F.min("activity"), F.countDistinct("series_id"),
              F.min("read_ts"), F.max("read_ts")).first()
    assert r[0] >= 0.0 and r[1] <= 0.2 and r[2] >= 0.0 and r[3] == 37
    assert r[4] == dt.datetime(2024, 2, 1) and r[5] == dt.datetime(2024, 2, 3, 23)


def test_same_output_for_any_parallelism(spark, inputs):
    prof, temps = inputs
    a = syn.synthesize(prof, temps, 20, 2, "2024-02-01", 1.5, 1, 5).orderBy("series_id", "read_ts").collect()
    b = syn.synthesize(prof, temps, 20, 2, "2024-02-01", 1.5, 8, 5).orderBy("series_id", "read_ts").collect()
    assert a == b


def test_peak_rule(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.5)], "avg double, load double")
    diff = F.col("load") - F.col("avg")
    got = [r[0] for r in df.select(F.when(diff > 0, F.col("avg") + diff * 1.5).otherwise(F.col("load"))).collect()]
    assert got == [2.5, 0.5]


def test_draws_are_uniform_and_normal(spark):
    df = spark.range(0, 20000).select(draws.uniform(draws.digest(1, F.col("id")), 0).alias("u"),
                                      draws.gaussian(draws.digest(2, F.col("id")), 0).alias("g"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("g"), F.stddev("g")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and r[1] > 0 and r[2] < 1
    assert r[3] == pytest.approx(0.0, abs=0.03) and r[4] == pytest.approx(1.0, abs=0.03)


def test_dense_index_is_a_bijection(spark):
    df = spark.createDataFrame([(m,) for m in (5, 1027, 3, 2000, 9, 1021 * 3)], "meter_id bigint")
    idx = sorted(r.idx for r in syn.dense_index(df, "meter_id", buckets=7).collect())
    assert idx == list(range(6))


def test_float32_slopes():
    s0, s1, s2 = syn.slopes(0)
    assert s0 != -0.0059 and abs(s0 + 0.0059) < 1e-9


def test_profile_noise_and_slope_row(spark, inputs):
    prof, temps = inputs
    prof_sd = prof.withColumn("sd", F.array_repeat(F.lit(0.0), 24))
    s = syn.synthesize(prof_sd, temps, 5, 1, "2024-02-01", 1.0, 2, 3, detail=True, noise="profile", slope_row=2)
    # zero profile sd: activity equals the (non-negative) profile mean exactly
    r = s.select("seed_meter_id", "i", "activity").collect()
    means = {row.meter_id: row.mean for row in prof.collect()}
    assert all(abs(x.activity - max(means[x.seed_meter_id][x.i % 24], 0.0)) < 1e-15 for x in r)
    with pytest.raises(ValueError):
        syn.synthesize(prof, temps, 5, 1, "2024-02-01", 1.0, 2, 3, noise="bogus")


def test_noise_statistics(spark):
    prof = spark.createDataFrame([(1, [0.5] * 24)], "meter_id bigint, mean array<double>")
    temps = spark.createDataFrame([(0, 10.0)], "pos long, temperature double")
    s = syn.synthesize(prof, temps, 200, 10, "2024-02-01", 1.0, 4, 21, detail=True)
    r = s.agg(F.avg("activity"), F.stddev_pop("activity"), F.avg("temperature"), F.stddev_pop("temperature")).first()
    assert r[0] == pytest.approx(0.5, abs=0.005) and r[1] == pytest.approx(0.1, abs=0.005)
    assert r[2] == pytest.approx(10.0, abs=0.05) and r[3] == pytest.approx(2.0, abs=0.05)
    # peaky ratio 1 leaves the load unchanged: load = activity + thermal
    d = s.select(F.max(F.abs(F.col("load") - F.col("activity") - F.col("thermal")))).first()[0]
    assert d < 1e-12
