"""Physical-plan properties that matter at scale (checked on the planned, not executed, plan)."""

import re

from wattle.operators import ksc, profile as pf, synthesize as syn
from wattle.plans import catalog as C
from wattle.sources import fixtures as fx

from conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p: str) -> int:
    return len(re.findall(r"Exchange (hash|range|single|round)", p))


def test_assignment_is_narrow(spark):
    pts = C.points(spark, SF001)
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 3))
    base = exchanges(plan(pts))
    for method in ("arrow", "sql"):
        p = plan(ksc.assign(pts, seeds, 1, method=method))
        assert exchanges(p) == base and "Join" not in p


def test_update_adds_one_exchange(spark):
    pts = C.points(spark, SF001)
    seeds = ksc.collect_model(ksc.sample_seeds(C.pool(pts), 3))
    a = ksc.assign(pts, seeds, 1)
    p = plan(ksc.update(a))
    assert exchanges(p) == exchanges(plan(pts)) + 1
    assert "partial_avg" in p                 # map-side combine before the shuffle


def test_regression_windows_run_over_blocks(spark):
    w = C.weather(spark, SF001)
    p = plan(pf.activity_profile(w))
    # every window over rows is partitioned by the block; the one over a meter-hour sees one row a block
    over = re.findall(r"^.*Window \[.*windowspecdefinition\(([^)]*)", p, re.M)
    rows = [x for x in over if "read_date" in x]
    assert rows and all("block" in x.split("read_date")[0] for x in rows)
    # the moments are combined before their shuffle: 51 sums, no other aggregate per row
    assert p.count("partial_sum") >= 51 and "covar" not in p


def test_generator_expands_without_shuffle(spark):
    prof = spark.createDataFrame([(m, [0.3] * 24) for m in range(1, 4)], "meter_id bigint, mean array<double>")
    temps = spark.createDataFrame([(i, 10.0 + i) for i in range(30)], "pos long, temperature double")
    p = plan(syn.synthesize(prof, temps, 50, 2, "2024-02-01", 1.5, 4, 1))
    top = p.split("Generate explode")[0]      # operators above the hour expansion
    assert exchanges(top) == 0
    assert "BroadcastHashJoin" in p


def test_meter_slice_pushes_filters(spark):
    p = plan(C.q_meter_slice(spark, SF001))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id", p)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in p


def test_seeds_are_top_k_not_sort(spark):
    p = plan(C.pool(C.points(spark, SF001)))
    assert "TakeOrderedAndProject" in p


def test_meter_days_keep_their_deal(spark):
    # as many partitions as asked for: no exchange dropped as repeated, none coalesced
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pf.collapsed(C.weather(spark, SF001)).rdd.getNumPartitions() == n


def test_tasks_follow_the_rows(spark, monkeypatch):
    ev = C.events(spark, SF001)
    rows = pf.activity_profile(fx.weather_readings(ev)).collect()
    monkeypatch.setattr(fx, "DAYS_PER_TASK", 10)
    monkeypatch.setattr(pf, "ROWS_PER_TASK", 240)
    days, w = fx.meter_days(ev).count(), fx.weather_readings(ev)
    p = plan(pf.activity_profile(w))
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(day#\d+, meter_id#\d+L?, (\d+)\)", p)]
    sorted_ = [int(n) for n in re.findall(r"hashpartitioning\(meter_id#\d+L?, hour#\d+, block#\d+, (\d+)\)", p)]
    assert dealt and min(dealt) > 8 and abs(min(dealt) - days / 10) <= 0.2 * days / 10   # days are estimated
    assert sorted_ and min(sorted_) == -(-days * 24 // 240)
    few = sorted((r.meter_id, r.hour, round(r["mean"], 6), round(r.sd, 6)) for r in rows)
    assert few == sorted((r.meter_id, r.hour, round(r["mean"], 6), round(r.sd, 6)) for r in pf.activity_profile(w).collect())
