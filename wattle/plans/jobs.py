"""The four end-to-end jobs, reading and writing the text formats.

* ``prepare_points``  raw TSV readings -> daily points + seed centroids
* ``ksc_clustering``  points + seeds -> K sweep -> centroids (with shares), tagged points,
                      per-meter entropy and the elbow table
* ``train_profiles``  weather CSV -> per-meter activity profiles
* ``generate``        profiles + temperature seed -> synthetic series

Each is a sequence of Spark jobs over DataFrames; nothing but the K-SC model (at most a
few hundred centroids) and a handful of scalars reaches the driver.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import SparkSession

from ..operators import ksc, prepare as pr, profile as pf, synthesize as syn
from ..operators.loopstate import LoopState, points_print
from ..session import cached
from ..sources import text as tx


def prepare_points(spark: SparkSession, input_dir: str, point_out: str, centroid_out: str,
                   window_size: int = 24, n_seeds: int = 100) -> dict:
    days = pr.complete_days(pr.ingest_lines(tx.read_raw_lines(spark, input_dir)))
    points = cached(pr.daily_points(days, window_size))
    tx.write_points(points, point_out, sort=True)
    tx.write_centroids(pr.seed_centroids(points, n_seeds), centroid_out)
    n = points.count()
    points.unpersist()
    return {"points": n}


def ksc_clustering(spark: SparkSession, point_dir: str, centroid_dir: str, out_dir: str,
                   max_iter: int = 100, delta: float = 1e-4, min_partitions: int | None = None,
                   max_shift: int = 1, k_start: int = 2, k_end: int = 20,
                   least_coverage: float = 0.5, together: int | None = None, state_dir: str | None = None) -> list:
    """``state_dir`` (a shared folder) makes the job resumable: every turn of the sweep is stored
    there, and a job started again with the same input and settings goes on behind the last one and
    writes the outputs that are not finished yet."""
    read = tx.read_points(spark, point_dir, min_partitions)
    points = ksc.stable(read)   # points with a missing or non-finite value are left out
    pool = tx.read_centroids(spark, centroid_dir)
    state, once, mode = None, (lambda path, write: write(path)), "errorifexists"
    if state_dir:
        together = together or ksc.TOGETHER
        seeds = sorted((cid, c) for cid, (_, c) in ksc.collect_model(pool).items())
        settings = {"delta": delta, "max_shift": max_shift, "max_iter": max_iter, "k_start": k_start, "k_end": k_end, "together": together,
                    "seeds": hashlib.sha256(repr(seeds).encode()).hexdigest(), "out": out_dir, **points_print(points)}
        state = LoopState(spark, state_dir, settings)
        once, mode = state.once, "overwrite"   # a half-written output of the job stopped
    res = ksc.sweep(points, pool, k_start, k_end, least_coverage, max_iter, delta, max_shift, together=together, state=state)
    shares = ksc.centroid_shares(ksc.model_frame(spark, res.fit.model))
    once(os.path.join(out_dir, "centroid"), lambda p: tx.write_shares(shares, p, mode))
    tags = ksc.tag_points(ksc.assign(ksc.one_per_id(points), res.fit.assigning_model, max_shift))
    once(os.path.join(out_dir, "taggedpoints"), lambda p: tx.write_tagged(tags, p, mode, sort=True))
    once(os.path.join(out_dir, "entropy"), lambda p: tx.write_entropy(ksc.meter_entropy(res.assigned), p, mode))
    once(os.path.join(out_dir, "elbow"), lambda p: tx.write_elbow(ksc.sweep_frame(spark, res.table), p, mode))
    res.assigned.unpersist()
    points.unpersist()
    return res.table


def train_profiles(spark: SparkSession, input_dir: str, output_path: str) -> None:
    weather = tx.read_weather(spark, input_dir)
    tx.write_profiles(pf.profile_arrays(pf.activity_profile(weather)), output_path)


def generate(spark: SparkSession, parallelism: int, reading_seed_path: str, temperature_seed_path: str,
             output_path: str, start_date: str, n_days: int, n_series: int, peaky_ratio: float,
             seed: int = 7) -> None:
    profiles = cached(tx.read_profiles(spark, reading_seed_path).select("meter_id", "mean"))
    temps = cached(tx.read_temperature_seed(spark, temperature_seed_path))
    out = syn.synthesize(profiles, temps, n_series, n_days, start_date, peaky_ratio, parallelism, seed)
    syn.format_lines(out).write.mode("errorifexists").text(output_path)
