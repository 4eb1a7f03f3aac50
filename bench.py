"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is forced end to end with a ``noop`` write (no collect). One warm-up pass, then
the median of ``$BENCH_RUNS`` (default 3) timed passes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from wattle.operators import ksc, prepare as pr, profile as pf, synthesize as syn  # noqa: E402
from wattle.plans import catalog as C, params as P  # noqa: E402
from wattle.session import cached, get_session, scratch_path  # noqa: E402
from wattle.sources import fixtures as fx, text as tx  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def _sf_value(path: str):
    tag = os.path.basename(path.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = get_session(f"local[{CPUS}]", "wattle-bench", {
        "spark.sql.shuffle.partitions": str(max(8, 2 * int(CPUS))),
        "spark.driver.memory": "8g",
    })
    state = {}

    def daily_points():
        sink(C.points(spark, SF_DIR))

    def prepare_state():
        pts = C.stable_points(spark, SF_DIR)
        state["points"] = pts
        state["n_points"] = pts.count()
        state["seeds"] = ksc.collect_model(ksc.sample_seeds(C.pool(pts), P.K_FIT))
        # generator inputs, like the profile and temperature seed files it reads
        w = C.weather(spark, SF_DIR)
        state["prof"] = cached(pf.profile_arrays(pf.activity_profile(w)))
        state["temps"] = cached(syn.temperature_seed(w))
        state["prof"].count()
        state["temps"].count()
        # raw readings as a text file, the production input of the ingest
        state["raw"] = scratch_path(spark, "bench-raw")
        fx.meter_lines(C.events(spark, SF_DIR)).write.text(state["raw"])

    def text_ingest():
        lines = tx.read_raw_lines(spark, state["raw"])
        sink(pr.daily_points(pr.complete_days(pr.ingest_lines(lines)), P.WINDOW))

    def assign_pass():
        sink(ksc.assign(state["points"], state["seeds"], P.MAX_SHIFT))

    def fit3():
        ksc.fit(state["points"], state["seeds"], 3, 0.0, P.MAX_SHIFT)

    def k_sweep():
        # fixed work, comparable between rounds: K = 2..8 until coverage 0.40, two turns each
        res = ksc.sweep(state["points"], C.pool(state["points"]), 2, 8, 0.40, 2, P.DELTA, P.MAX_SHIFT)
        res.assigned.unpersist()

    def regression_betas():
        sink(pf.fit_betas(C.weather(spark, SF_DIR)))

    def activity_profile():
        sink(pf.activity_profile(C.weather(spark, SF_DIR)))

    def synth_1000x30():
        sink(syn.synthesize(state["prof"], state["temps"], 1000, 30, "2024-02-01", P.PEAKY_RATIO,
                            int(CPUS) * 2, 7))

    def tagged_entropy():
        a = ksc.assign(state["points"], state["seeds"], P.MAX_SHIFT)
        sink(ksc.meter_entropy(a))
        sink(ksc.tag_points(a))

    jobs = [("daily_points", daily_points), ("text_ingest", text_ingest), ("assign_pass", assign_pass), ("ksc_fit3", fit3),
            ("k_sweep", k_sweep), ("tag_entropy", tagged_entropy), ("regression_betas", regression_betas),
            ("activity_profile", activity_profile), ("synth_1000x30", synth_1000x30)]

    prepare_state()
    times = {name: [] for name, _ in jobs}
    for rep in range(RUNS + 1):
        for name, fn in jobs:
            t = time.perf_counter()
            fn()
            if rep > 0:
                times[name].append(time.perf_counter() - t)
    med = {k: round(statistics.median(v), 3) for k, v in times.items()}
    shifts = 2 * P.MAX_SHIFT + 1
    evals = state["n_points"] * P.K_FIT * shifts
    out = {
        "metric": "total_sec_median",
        "value": round(sum(med.values()), 3),
        "unit": "sec",
        "queries": med,
        "sf": _sf_value(SF_DIR),
        "cpus": int(CPUS),
        "points": state["n_points"],
        "assign_point_centroid_shifts_per_sec": round(evals / med["assign_pass"], 1),
        "runs": {k: [round(x, 3) for x in v] for k, v in times.items()},
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
