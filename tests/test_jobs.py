"""The four jobs end to end on text files derived from the sf0.01 events."""

import os

from wattle.operators import prepare as pr
from wattle.plans import catalog as C
from wattle.plans import jobs
from wattle.sources import fixtures as fx
from wattle.sources import text as tx

from conftest import SF01


def test_jobs_end_to_end(spark, scratch):
    raw = os.path.join(scratch, "raw")
    fx.meter_lines(C.events(spark, SF01)).write.text(raw)
    out = jobs.prepare_points(spark, raw, os.path.join(scratch, "points"), os.path.join(scratch, "seeds"), 26)
    assert out["points"] == pr.daily_points(C.days(spark, SF01), 26).count()

    table = jobs.ksc_clustering(spark, os.path.join(scratch, "points"), os.path.join(scratch, "seeds"),
                                os.path.join(scratch, "ksc"), max_iter=3, k_start=2, k_end=4, least_coverage=0.99)
    assert [r["k"] for r in table] == [2, 3, 4]
    shares = tx.read_shares(spark, os.path.join(scratch, "ksc", "centroid")).collect()
    assert abs(sum(r.share for r in shares) - 100.0) < 1e-9
    assert tx.read_tagged(spark, os.path.join(scratch, "ksc", "taggedpoints")).count() == out["points"]
    assert tx.read_entropy(spark, os.path.join(scratch, "ksc", "entropy")).count() > 0
    assert tx.read_elbow(spark, os.path.join(scratch, "ksc", "elbow")).count() == 3

    weather_dir = os.path.join(scratch, "weather")
    tx.write_weather(C.weather(spark, SF01), weather_dir)
    jobs.train_profiles(spark, weather_dir, os.path.join(scratch, "profiles"))
    n_prof = tx.read_profiles(spark, os.path.join(scratch, "profiles")).count()
    assert n_prof == C.weather(spark, SF01).select("meter_id").distinct().count()

    seed_file = os.path.join(scratch, "temps.txt")
    with open(seed_file, "w") as f:
        f.write("|".join(str(float(t)) for t in range(-5, 30)) + "\n")
    jobs.generate(spark, 4, os.path.join(scratch, "profiles"), seed_file, os.path.join(scratch, "syn"),
                  "2024-03-01", 2, 25, 1.5)
    lines = spark.read.text(os.path.join(scratch, "syn"))
    assert lines.count() == 25 * 2 * 24
    first = lines.orderBy("value").first().value.split("|")
    assert len(first) == 4 and first[1].startswith("2024-03-0")
