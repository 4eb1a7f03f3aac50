"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the given parquet tables (``events``) and derives everything else with
Spark. Doubles are rounded to ``DIGITS`` decimals and arrays are returned in long form
``(…, pos, value)`` so that results compare value-by-value with the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..operators import ksc
from ..operators import prepare as pr
from ..session import cached
from ..sources import fixtures as fx
from . import params as P


def _r(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, P.DIGITS) + F.lit(0.0)).alias(name or (c if isinstance(c, str) else None))


def _long(df: DataFrame, keys: list, arr: str, value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(arr).alias("pos", "_v")).select(
        *keys, F.col("pos").cast("int").alias("pos"), _r("_v", value)
    )


# --------------------------------------------------------------------------- shared stages

def events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load_table(spark, sf, "events").select("user_id", "ts", "value")


def readings(spark, sf) -> DataFrame:
    return pr.ingest_lines(fx.meter_lines(events(spark, sf)))


def days(spark, sf) -> DataFrame:
    return pr.complete_days(readings(spark, sf))


def points(spark, sf, window=P.WINDOW) -> DataFrame:
    """Points of all meter-days (without the injected faults, which only the ingest queries read)."""
    return pr.daily_points(fx.full_days(events(spark, sf)), window)


def stable_points(spark, sf) -> DataFrame:
    """Points for iterative work: checkpointed (lineage cut) and kept in memory."""
    return ksc.stable(points(spark, sf))


def pool(pts: DataFrame) -> DataFrame:
    return pr.seed_centroids(pts, P.POOL)


def fitted(spark, sf):
    """(points, fit result, final assignment) of the fixed K_FIT fit."""
    pts = stable_points(spark, sf)
    seeds = ksc.collect_model(ksc.sample_seeds(pool(pts), P.K_FIT))
    res = ksc.fit(pts, seeds, P.MAX_ITERS, P.DELTA, P.MAX_SHIFT)
    # each query reads the final assignment once: a narrow re-assignment, not a cached copy
    assigned = ksc.assign(pts, res.assigning_model, P.MAX_SHIFT)
    return pts, res, assigned


# --------------------------------------------------------------------------- queries

def q_ingest_clean(spark, sf):
    r = readings(spark, sf)
    return r.select("meter_id", "day", F.col("hour").cast("int").alias("hour"), _r("reading"))


def q_complete_days(spark, sf):
    d = days(spark, sf)
    return d.select("meter_id", "day", _r(S.array_sum("x"), "total"), _r(F.array_max("x"), "peak"))


def q_daily_points_24(spark, sf):
    return _long(points(spark, sf, 24), ["meter_id", "day"], "x")


def q_daily_points_26(spark, sf):
    return _long(points(spark, sf, P.WINDOW), ["meter_id", "day"], "x")


def q_seed_centroids(spark, sf):
    return _long(pool(points(spark, sf)), ["cid"], "c")


def q_shape_shifts(spark, sf, widest=P.MAX_SHIFT):
    pts = points(spark, sf)
    shifts = pts.select(
        "meter_id", "day",
        F.explode(F.sequence(F.lit(-widest), F.lit(widest))).alias("q"), "x",
    )
    z = S.normalize(S.crop(S.rotate("x", F.col("q")), S.DAY))
    return _long(shifts.select("meter_id", "day", "q", z.alias("z")), ["meter_id", "day", "q"], "z")


def q_shape_distance(spark, sf):
    pts = cached(points(spark, sf))  # read for the seeds and again for the distances
    seeds = ksc.collect_model(pool(pts).where(F.col("cid") <= P.K_FIT))
    rows = pts.select(
        "meter_id", "day",
        F.explode(ksc.model_literal(seeds)).alias("m"),
        S.normalize(S.crop("x", S.DAY)).alias("z0"), "x",
    )
    kd = S.ksc_distance("x", F.col("m.c"), P.MAX_SHIFT)
    return rows.select(
        "meter_id", "day", F.col("m.cid").alias("cid"),
        _r(kd["dist"], "ksc_dist"), kd["q"].alias("best_q"),
        _r(S.euclidean("z0", F.col("m.c")), "euclid0"),
        _r(S.cosine("z0", F.col("m.c")), "cosine0"),
    )


def q_ksc_assign(spark, sf):
    pts = cached(points(spark, sf))
    seeds = ksc.collect_model(ksc.sample_seeds(pool(pts), P.K_FIT))
    a = ksc.assign(pts, seeds, P.MAX_SHIFT)
    return a.select("meter_id", "day", "cid", "q", _r("dist"))


def q_ksc_update(spark, sf):
    pts = cached(points(spark, sf))
    seeds = ksc.collect_model(ksc.sample_seeds(pool(pts), P.K_FIT))
    upd = ksc.movement(ksc.update(ksc.assign(pts, seeds, P.MAX_SHIFT)), seeds, P.DELTA)
    return upd.select("cid", "n", _r("moved"), "over", F.posexplode("c").alias("pos", "_v")).select(
        "cid", "n", "moved", "over", F.col("pos").cast("int").alias("pos"), _r("_v", "value")
    )


def q_ksc_fit(spark, sf):
    _, res, _ = fitted(spark, sf)
    cents = ksc.centroid_shares(ksc.model_frame(spark, res.model))
    out = cents.select("cid", "n", _r("share"), F.lit(res.iterations).alias("iterations"),
                       F.posexplode("c").alias("pos", "_v"))
    return out.select("cid", "n", "share", "iterations", F.col("pos").cast("int").alias("pos"), _r("_v", "value"))


def q_cluster_quality(spark, sf):
    _, res, _ = fitted(spark, sf)
    q = ksc.quality(res.model, res.squares, P.K_FIT)
    t = ksc.sweep_frame(spark, [{**q, "iterations": res.iterations, "converged": res.converged}])
    return t.select("k", "k_effective", "n_points", *[_r(c) for c in ["sst", "ssb", "ssw", "coverage", "ch"]])


def q_centroid_share(spark, sf):
    _, res, _ = fitted(spark, sf)
    return ksc.centroid_shares(ksc.model_frame(spark, res.model)).select("cid", "n", _r("share"))


def q_tagged_points(spark, sf):
    _, _, assigned = fitted(spark, sf)
    t = ksc.tag_points(assigned)
    both = t.select("meter_id", "day", "cid", F.arrays_zip("original", "shifted").alias("_p"))
    return both.select("meter_id", "day", "cid", F.posexplode("_p").alias("pos", "_v")).select(
        "meter_id", "day", "cid", F.col("pos").cast("int").alias("pos"),
        _r("_v.original", "original"), _r("_v.shifted", "shifted"),
    )


def q_tagged_top10(spark, sf):
    _, _, assigned = fitted(spark, sf)
    top = ksc.tag_points(assigned).orderBy("cid", "meter_id", "day").limit(P.TOP_TAGGED)
    return _long(top, ["meter_id", "day", "cid"], "original", "original")


def _entropy(spark, sf):
    _, _, assigned = fitted(spark, sf)
    return ksc.meter_entropy(assigned)


def q_meter_entropy(spark, sf):
    e = _entropy(spark, sf)
    return e.select("meter_id", "n_days", "n_clusters", _r("entropy"))


def q_entropy_histogram(spark, sf):
    h = ksc.entropy_histogram(_entropy(spark, sf), P.ENTROPY_BINS)
    return h.select("bin", _r("lo"), _r("hi"), "n")


def q_entropy_class(spark, sf):
    e = ksc.entropy_class(_entropy(spark, sf), P.ENTROPY_THRESHOLD)
    return e.groupBy("predictable").agg(F.count(F.lit(1)).alias("meters"))


def q_k_sweep(spark, sf):
    pts = stable_points(spark, sf)
    res = ksc.sweep(pts, pool(pts), P.SWEEP_START, P.SWEEP_END, P.LEAST_COVERAGE,
                    P.MAX_ITERS, P.DELTA, P.MAX_SHIFT)
    res.assigned.unpersist()
    t = ksc.sweep_frame(spark, res.table)
    return t.select("k", "k_effective", "iterations", "n_points",
                    *[_r(c) for c in ["sst", "ssb", "ssw", "coverage", "ch"]])


QUERIES = {
    "ingest_clean": q_ingest_clean,
    "complete_days": q_complete_days,
    "daily_points_24": q_daily_points_24,
    "daily_points_26": q_daily_points_26,
    "seed_centroids": q_seed_centroids,
    "shape_shifts": q_shape_shifts,
    "shape_distance": q_shape_distance,
    "ksc_assign": q_ksc_assign,
    "ksc_update": q_ksc_update,
    "ksc_fit": q_ksc_fit,
    "cluster_quality": q_cluster_quality,
    "centroid_share": q_centroid_share,
    "tagged_points": q_tagged_points,
    "tagged_top10": q_tagged_top10,
    "meter_entropy": q_meter_entropy,
    "entropy_histogram": q_entropy_histogram,
    "entropy_class": q_entropy_class,
    "k_sweep": q_k_sweep,
}


# --------------------------------------------------------------------------- regression family

from ..operators import profile as pf  # noqa: E402


def weather(spark, sf) -> DataFrame:
    return fx.weather_readings(events(spark, sf))


def q_temperature_features(spark, sf):
    w = pf.with_temperature_terms(weather(spark, sf))
    return w.select("meter_id", "read_date", "hour", _r("temperature"),
                    _r("x4", "cooling"), _r("x5", "heating"), _r("x6", "cold"))


def q_regression_lags(spark, sf):
    w = pf.with_lags(weather(spark, sf))
    return w.select("meter_id", "read_date", "hour", _r("reading"), _r("lag1"), _r("lag2"), _r("lag3"))


def q_regression_betas(spark, sf):
    b = pf.fit_betas(weather(spark, sf))
    return b.select("meter_id", "hour", "n_obs", *[_r(c) for c in pf.BETAS], "fallback")


def q_activity_profile(spark, sf):
    p = pf.activity_profile(weather(spark, sf))
    return p.select("meter_id", "hour", _r("mean"), _r("sd"))


QUERIES.update({
    "temperature_features": q_temperature_features,
    "regression_lags": q_regression_lags,
    "regression_betas": q_regression_betas,
    "activity_profile": q_activity_profile,
})


# --------------------------------------------------------------------------- generator family

from ..operators import synthesize as syn  # noqa: E402


def synthetic(spark, sf, detail=False) -> DataFrame:
    """One synthetic series per meter that has a profile (the output grows with the data)."""
    w = weather(spark, sf)
    prof = cached(pf.profile_arrays(pf.activity_profile(w)))
    temps = cached(syn.temperature_seed(w))
    n = prof.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * P.SYNTH_DAYS * 24 // P.SYNTH_HOURS_PER_TASK))
    return syn.synthesize(prof, temps, n, P.SYNTH_DAYS, P.SYNTH_START, P.PEAKY_RATIO, tasks, P.SYNTH_SEED, detail)


def q_synth_series(spark, sf):
    s = synthetic(spark, sf)
    return s.select("series_id", "seed_meter_id", "read_ts", _r("load"), _r("temperature"))


def q_synth_thermal(spark, sf):
    s = synthetic(spark, sf, detail=True)
    return s.groupBy("series_id").agg(
        _r(F.first("x0"), "x0"), _r(F.first("y0"), "y0"), _r(F.first("x1"), "x1"), _r(F.first("x2"), "x2"),
        _r(F.min("thermal"), "thermal_min"), _r(F.max("thermal"), "thermal_max"),
        _r(F.min("activity"), "activity_min"),
    )


def q_synth_daily(spark, sf):
    s = synthetic(spark, sf, detail=True)
    return s.groupBy("series_id", "day_index").agg(
        _r(F.avg("load"), "mean_load"), _r(F.stddev_pop("load"), "sd_load"), _r(F.min("load"), "min_load"),
        _r(F.max("load"), "max_load"),
    )


QUERIES.update({
    "synth_series": q_synth_series,
    "synth_thermal": q_synth_thermal,
    "synth_daily": q_synth_daily,
})


# --------------------------------------------------------------------------- text round trip, slices

from ..session import scratch_path  # noqa: E402
from ..sources import text as tx  # noqa: E402


def q_export_roundtrip(spark, sf):
    """Writes points, seed centroids, profiles and weather rows in their text formats to a
    fresh folder under the checkpoint location, reads them back and summarises them."""
    base = scratch_path(spark, "roundtrip")
    pts = cached(points(spark, sf))
    w = weather(spark, sf)
    prof = pf.profile_arrays(pf.activity_profile(w))
    tx.write_points(pts, f"{base}/points", sort=True)
    tx.write_centroids(pool(pts), f"{base}/centroids")
    tx.write_profiles(prof, f"{base}/profiles")
    tx.write_weather(w, f"{base}/weather")
    rp = tx.read_points(spark, f"{base}/points")
    rc = tx.read_centroids(spark, f"{base}/centroids")
    rpr = tx.read_profiles(spark, f"{base}/profiles")
    rw = tx.read_weather(spark, f"{base}/weather")

    def summary(name, df, value):
        return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                      F.round(F.sum(value), 3).alias("checksum"))

    return (summary("points", rp, S.array_sum("x"))
            .unionByName(summary("centroids", rc, S.array_sum("c")))
            .unionByName(summary("profiles", rpr, S.array_sum("mean") + S.array_sum("sd")))
            .unionByName(summary("weather", rw, F.col("reading") + F.col("temperature"))))


def q_meter_slice(spark, sf):
    """One meter's hourly consumption over the first week: the filter and the projection
    reach the parquet scan. The meter is the largest consumer (found by an aggregate)."""
    ev = events(spark, sf)
    top = ev.groupBy("user_id").agg(F.sum("value").alias("_s")).agg(
        F.max_by("user_id", F.struct("_s", F.col("user_id")))).first()[0]
    sl = pr.meter_slice(ev.withColumnRenamed("user_id", "meter_id"), top,
                        "2024-01-01 00:00:00", "2024-01-07 23:59:59", ts_col="ts")
    hour_ts = F.make_timestamp_ntz(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"),
                                   F.lit(0), F.lit(0))  # wall-clock hour, independent of the session zone
    return sl.groupBy("meter_id", hour_ts.alias("read_ts")).agg(
        _r(F.sum("value"), "reading"), F.count(F.lit(1)).alias("events"))


QUERIES.update({
    "export_roundtrip": q_export_roundtrip,
    "meter_slice": q_meter_slice,
})


def q_cluster_members(spark, sf):
    """Points tagged with the largest cluster of the fit (ties: lowest cid)."""
    _, res, assigned = fitted(spark, sf)
    top = min(res.model.items(), key=lambda kv: (-kv[1][0], kv[0]))[0]
    return ksc.tag_points(assigned).where(F.col("cid") == top).select(
        "meter_id", "day", "cid", _r(F.array_max("original"), "peak_share"))


def q_activity_load(spark, sf):
    """Row-level activity load: readings joined with their (meter, hour) model."""
    a = pf.activity(weather(spark, sf))
    return a.select("meter_id", "read_date", "hour", _r("reading"), _r("activity"), "fallback")


QUERIES.update({
    "cluster_members": q_cluster_members,
    "activity_load": q_activity_load,
})


# --------------------------------------------------------------------------- files, jobs, screens

from . import jobs  # noqa: E402


def q_raw_file_ingest(spark, sf):
    """The raw reading lines written to text files, scanned and ingested again."""
    base = scratch_path(spark, "raw")
    fx.meter_lines(events(spark, sf)).write.text(base)
    r = pr.ingest_lines(tx.read_raw_lines(spark, base))
    return r.select("meter_id", "day", F.col("hour").cast("int").alias("hour"), _r("reading"))


def q_point_files(spark, sf):
    """Points written in their text format (globally ordered) and read again, key and values."""
    base = scratch_path(spark, "points")
    tx.write_points(points(spark, sf), base, sort=True)
    return _long(tx.read_points(spark, base), ["meter_id", "day"], "x")


def q_result_files(spark, sf):
    """Shares and entropies of the fit, written in their text formats and read again."""
    base = scratch_path(spark, "results")
    _, res, assigned = fitted(spark, sf)
    tx.write_shares(ksc.centroid_shares(ksc.model_frame(spark, res.model)), f"{base}/shares")
    tx.write_entropy(ksc.meter_entropy(assigned), f"{base}/entropy")
    shares = tx.read_shares(spark, f"{base}/shares").select(F.lit("share").alias("kind"), F.col("cid").cast("long").alias("id"), _r("share", "value"))
    entropy = tx.read_entropy(spark, f"{base}/entropy").select(F.lit("entropy").alias("kind"), F.col("meter_id").alias("id"), _r("entropy", "value"))
    return shares.unionByName(entropy)


def q_tagged_files(spark, sf):
    """Tagged points written in their text format (ordered) and read again, by cluster."""
    base = scratch_path(spark, "tagged")
    _, _, assigned = fitted(spark, sf)
    tx.write_tagged(ksc.tag_points(assigned), base, sort=True)
    peak = F.struct(F.array_max("original").alias("o"), F.array_max("shifted").alias("s"))
    return tx.read_tagged(spark, base).select("cid", peak.alias("p")).select("cid", _r("p.o", "peak"), _r("p.s", "peak_shifted"))


def q_point_screen(spark, sf):
    """Points with faults put in by key arithmetic (a missing or a NaN hour): those that a
    fit keeps, and how many it leaves out."""
    k = F.col("meter_id") + F.dayofyear("day")
    hour3 = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None).cast("double"))
    bad = (k % 7 == 0) | (k % 11 == 0)
    dirty = points(spark, sf).withColumn("x", F.when(bad, F.transform("x", lambda v, i: F.when(i == 3, hour3).otherwise(v))).otherwise(F.col("x")))
    dirty = cached(dirty)
    out = ksc.rejected(dirty)
    return ksc.stable(dirty).groupBy("meter_id").agg(F.count("*").alias("kept"), F.lit(out).alias("rejected"))


def q_tagged_repeated(spark, sf):
    """Every point twice (as it is and reversed): one of each id is kept, the lesser."""
    p = points(spark, sf)
    return _long(ksc.one_per_id(p.unionByName(p.withColumn("x", F.reverse("x")))), ["meter_id", "day"], "x")


def q_job_prepare_points(spark, sf):
    """The preparation job over raw text files: points and seeds that it wrote."""
    base = scratch_path(spark, "job-prepare")
    fx.meter_lines(events(spark, sf)).write.text(f"{base}/raw")
    jobs.prepare_points(spark, f"{base}/raw", f"{base}/points", f"{base}/seeds", P.WINDOW, P.POOL)
    return _long(tx.read_points(spark, f"{base}/points"), ["meter_id", "day"], "x")


def q_job_train_profiles(spark, sf):
    """The training job over weather files: the profiles that it wrote."""
    base = scratch_path(spark, "job-train")
    tx.write_weather(weather(spark, sf), f"{base}/weather")
    jobs.train_profiles(spark, f"{base}/weather", f"{base}/profiles")
    p = tx.profiles_long(tx.read_profiles(spark, f"{base}/profiles"))
    return p.select("meter_id", "hour", _r("mean"), _r("sd"))


def q_temperature_seed_file(spark, sf):
    """The temperature seed as one line of a text file, read again."""
    base = scratch_path(spark, "temperatures")
    seed = syn.temperature_seed(weather(spark, sf)).agg(F.array_sort(F.collect_list(F.struct("pos", "temperature"))).alias("t"))
    seed.select(F.array_join(F.transform("t", lambda e: e["temperature"].cast("string")), "|")).write.text(base)
    return tx.read_temperature_seed(spark, base).select("pos", _r("temperature"))


QUERIES.update({
    "raw_file_ingest": q_raw_file_ingest,
    "point_files": q_point_files,
    "result_files": q_result_files,
    "tagged_files": q_tagged_files,
    "point_screen": q_point_screen,
    "tagged_repeated": q_tagged_repeated,
    "job_prepare_points": q_job_prepare_points,
    "job_train_profiles": q_job_train_profiles,
    "temperature_seed_file": q_temperature_seed_file,
})


# --------------------------------------------------------------------------- order as rows

from ..operators.order import numbered, numbered_lines  # noqa: E402


def q_point_positions(spark, sf):
    """Every point's place in the global order by meter and day."""
    return numbered(points(spark, sf).select("meter_id", "day"), "meter_id", "day").select("pos", "meter_id", "day")


def q_point_file_order(spark, sf):
    """Points written in global order; each with the number of its line in the files."""
    base = scratch_path(spark, "point-order")
    tx.write_points(points(spark, sf), base, sort=True)
    p = tx.parse_points(tx.fields(numbered_lines(spark, base)), "pos")
    return p.select("pos", "meter_id", "day", _r(F.array_max("x"), "peak"))


def q_tagged_file_order(spark, sf):
    """Tagged points written in order of cluster, meter and day; each with its line number."""
    base = scratch_path(spark, "tagged-order")
    _, _, assigned = fitted(spark, sf)
    tx.write_tagged(ksc.tag_points(assigned), base, sort=True)
    t = tx.parse_tagged(tx.fields(numbered_lines(spark, base)), "pos")
    return t.select("pos", "cid", _r(F.array_max("original"), "peak"), _r(F.array_max("shifted"), "peak_shifted"))


def q_tagged_file_top10(spark, sf):
    """The first ten lines of the tagged files."""
    base = scratch_path(spark, "tagged-top")
    _, _, assigned = fitted(spark, sf)
    tx.write_tagged(ksc.tag_points(assigned), base, sort=True)
    t = tx.parse_tagged(tx.fields(numbered_lines(spark, base, "line").where(F.col("line") < P.TOP_TAGGED)), "line")
    return t.select("line", "cid", F.posexplode("original").alias("pos", "_v")).select("line", "cid", F.col("pos").cast("int").alias("pos"), _r("_v", "original"))


def q_share_file_order(spark, sf):
    """Centroids with their shares, in the order of the lines of their file."""
    base = scratch_path(spark, "share-order")
    _, res, _ = fitted(spark, sf)
    tx.write_shares(ksc.centroid_shares(ksc.model_frame(spark, res.model)), base)
    return tx.parse_shares(tx.fields(numbered_lines(spark, base)), "pos").select("pos", "cid", _r("share"))


def q_temperature_first_line(spark, sf):
    """Temperatures of every date as a line of its own, in order, over several files: the
    first line of the first file is the seed."""
    base = scratch_path(spark, "temperature-lines")
    daily = weather(spark, sf).groupBy("read_date", "hour").agg(F.avg("temperature").alias("t"))
    daily = daily.groupBy("read_date").agg(F.array_sort(F.collect_list(F.struct("hour", "t"))).alias("d"))   # 24 hours
    line = F.array_join(F.transform("d", lambda e: e["t"].cast("string")), "|").alias("value")
    daily.repartitionByRange(4, "read_date").sortWithinPartitions("read_date").select(line).write.text(base)
    lines = spark.read.text(base).count()
    return tx.read_temperature_seed(spark, base).select("pos", _r("temperature"), F.lit(lines).cast("long").alias("lines"))


QUERIES.update({
    "point_positions": q_point_positions,
    "point_file_order": q_point_file_order,
    "tagged_file_order": q_tagged_file_order,
    "tagged_file_top10": q_tagged_file_top10,
    "share_file_order": q_share_file_order,
    "temperature_first_line": q_temperature_first_line,
})


# --------------------------------------------------------------------------- whole jobs

def q_shape_shifts_wrap(spark, sf):
    """Shifts wider than the margin of a point: its ends wrap around."""
    return q_shape_shifts(spark, sf, P.WRAP_SHIFT)


def q_job_prepare_seeds(spark, sf):
    """The preparation job over raw text files: the seed centroids that it wrote."""
    base = scratch_path(spark, "job-seeds")
    fx.meter_lines(events(spark, sf)).write.text(f"{base}/raw")
    jobs.prepare_points(spark, f"{base}/raw", f"{base}/points", f"{base}/seeds", P.WINDOW, P.POOL)
    return _long(tx.read_centroids(spark, f"{base}/seeds"), ["cid"], "c")


def q_job_ksc_clustering(spark, sf):
    """The clustering job over point and seed files, two K: every file that it wrote."""
    base = scratch_path(spark, "job-cluster")
    pts = cached(points(spark, sf))
    tx.write_points(pts, f"{base}/points", sort=True)
    tx.write_centroids(pool(pts), f"{base}/seeds")
    jobs.ksc_clustering(spark, f"{base}/points", f"{base}/seeds", f"{base}/out", P.MAX_ITERS, P.DELTA, max_shift=P.MAX_SHIFT,
                        k_start=P.K_FIT - 1, k_end=P.K_FIT, least_coverage=1.0)

    def rows(df, kind, key, value, pos=None):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), (F.lit(-1) if pos is None else F.col(pos)).alias("pos"), _r(value, "value"))
    shares = tx.read_shares(spark, f"{base}/out/centroid")
    tags = tx.read_tagged(spark, f"{base}/out/taggedpoints")
    elbow = tx.read_elbow(spark, f"{base}/out/elbow")
    return (rows(shares, "share", "cid", "share")
            .unionByName(rows(shares.select("cid", F.posexplode("c").alias("p", "v")), "centroid", "cid", "v", "p"))
            .unionByName(rows(tx.read_entropy(spark, f"{base}/out/entropy"), "entropy", "meter_id", "entropy"))
            .unionByName(rows(tags, "original", "cid", F.array_max("original")))
            .unionByName(rows(tags, "shifted", "cid", F.array_max("shifted")))
            .unionByName(rows(elbow, "coverage", "k", "coverage"))
            .unionByName(rows(elbow, "ch", "k", "ch")))


def q_job_generate(spark, sf):
    """The training and the generation job over files: the lines that they wrote, one series
    for each profile."""
    base = scratch_path(spark, "job-generate")
    w = weather(spark, sf)
    tx.write_weather(w, f"{base}/weather")
    jobs.train_profiles(spark, f"{base}/weather", f"{base}/profiles")
    seed = syn.temperature_seed(w).agg(F.array_sort(F.collect_list(F.struct("pos", "temperature"))).alias("t"))   # 24 a date
    seed.select(F.array_join(F.transform("t", lambda e: e["temperature"].cast("string")), "|")).write.text(f"{base}/temperatures")
    n = tx.read_profiles(spark, f"{base}/profiles").count()
    jobs.generate(spark, spark.sparkContext.defaultParallelism, f"{base}/profiles", f"{base}/temperatures", f"{base}/series",
                  P.SYNTH_START, P.SYNTH_DAYS, n, P.PEAKY_RATIO, P.SYNTH_SEED)
    f = tx.fields(spark.read.text(f"{base}/series"))
    return f.select(F.col("f")[0].cast("long").alias("series_id"), F.col("f")[1].alias("read_ts"),
                    _r(F.col("f")[2].cast("double"), "load"), _r(F.col("f")[3].cast("double"), "temperature"))


QUERIES.update({
    "shape_shifts_wrap": q_shape_shifts_wrap,
    "job_prepare_seeds": q_job_prepare_seeds,
    "job_ksc_clustering": q_job_ksc_clustering,
    "job_generate": q_job_generate,
})


# --------------------------------------------------------------------------- the text's distance and centroids

def q_scaled_assign(spark, sf):
    """Nearest seed of every point with a free scale and the distance divided by its norm."""
    pts = cached(points(spark, sf))
    seeds = ksc.collect_model(ksc.sample_seeds(pool(pts), P.K_FIT))
    return ksc.assign_scaled(pts, seeds, P.MAX_SHIFT).select("meter_id", "day", "cid", "q", _r("dist"), _r("alpha"))


def q_scaled_update(spark, sf):
    """The spectral centroids of that assignment."""
    pts = cached(points(spark, sf))
    seeds = ksc.collect_model(ksc.sample_seeds(pool(pts), P.K_FIT))
    return _long(ksc.model_frame(spark, ksc.update_scaled(ksc.assign_scaled(pts, seeds, P.MAX_SHIFT))), ["cid", "n"], "c")


QUERIES.update({
    "scaled_assign": q_scaled_assign,
    "scaled_update": q_scaled_update,
})


# --------------------------------------------------------------------------- fits that resume

from ..operators.loopstate import LoopState  # noqa: E402


def q_ksc_resumed(spark, sf):
    """The fit of ``ksc_fit`` stopped after two turns and taken up from its stored state; with the
    passes that were left."""
    base = scratch_path(spark, "ksc-state")
    pts = stable_points(spark, sf)
    seeds = {P.K_FIT: ksc.collect_model(ksc.sample_seeds(pool(pts), P.K_FIT))}
    settings = {"k": P.K_FIT, "delta": P.DELTA, "max_shift": P.MAX_SHIFT}
    ksc.fit_many(pts, seeds, 2, P.DELTA, P.MAX_SHIFT, state=LoopState(spark, base, settings))
    fits, passes = ksc.fit_many(pts, seeds, P.MAX_ITERS, P.DELTA, P.MAX_SHIFT, state=LoopState(spark, base, settings))
    res = fits[P.K_FIT]
    out = ksc.model_frame(spark, res.model).select("cid", "n", F.lit(res.iterations).alias("iterations"), F.lit(passes).alias("passes"),
                                                   F.posexplode("c").alias("pos", "_v"))
    return out.select("cid", "n", "iterations", "passes", F.col("pos").cast("int").alias("pos"), _r("_v", "value"))


QUERIES.update({
    "ksc_resumed": q_ksc_resumed,
})


# --------------------------------------------------------------------------- tables by date and by meter

from ..session import parallelism  # noqa: E402
from ..sources import tables as tb  # noqa: E402


def _bucketed(spark, rows: DataFrame, name: str, order=("meter_id", "day")) -> DataFrame:
    path = scratch_path(spark, name)
    return tb.write_bucketed(rows, path.rsplit("/", 1)[1].replace("-", "_"), parallelism(spark), path, order=order)


def q_date_slice(spark, sf):
    """Meter-days written by day; those of a date range, read from its folders alone."""
    base = scratch_path(spark, "days")
    tb.write_periods(fx.full_days(events(spark, sf)), base, parallelism(spark), "day")
    d = tb.read_periods(spark, base, P.SLICE_FIRST, P.SLICE_LAST, "day")
    return d.select("meter_id", "day", _r(S.array_sum("x"), "total"), _r(F.array_max("x"), "peak"))


def q_bucketed_points(spark, sf):
    """Extended windows over meter-days in buckets by meter: no exchange after the table."""
    t = _bucketed(spark, fx.full_days(events(spark, sf)), "bucketed-days")
    return _long(pr.daily_points(t, P.WINDOW), ["meter_id", "day"], "x")


def q_bucketed_entropy(spark, sf):
    """Entropies of the meters from their assigned points in buckets by meter."""
    _, _, assigned = fitted(spark, sf)
    t = _bucketed(spark, assigned.select("meter_id", "day", "cid"), "bucketed-tags")
    return ksc.meter_entropy(t).select("meter_id", "n_days", "n_clusters", _r("entropy"))


def q_bucketed_profiles(spark, sf):
    """Profiles of 24 slots a meter from (meter, hour) rows in buckets by meter."""
    t = _bucketed(spark, pf.activity_profile(weather(spark, sf)), "bucketed-profiles", order=("meter_id", "hour"))
    return tx.profiles_long(pf.profile_arrays(t)).select("meter_id", "hour", _r("mean"), _r("sd"))


QUERIES.update({
    "date_slice": q_date_slice,
    "bucketed_points": q_bucketed_points,
    "bucketed_entropy": q_bucketed_entropy,
    "bucketed_profiles": q_bucketed_profiles,
})


# --------------------------------------------------------------------------- many centroids

def q_ksc_assign_pool(spark, sf):
    """Every point with the nearest of all seeds of the pool (the kernel skips what cannot win)."""
    pts = cached(points(spark, sf))
    a = ksc.assign(pts, ksc.collect_model(pool(pts)), P.MAX_SHIFT)
    return a.select("meter_id", "day", "cid", "q", _r("dist"))


QUERIES.update({
    "ksc_assign_pool": q_ksc_assign_pool,
})


# --------------------------------------------------------------------------- one source for all text formats

from ..sources import datasource as ds  # noqa: E402


def _raw_files(spark, sf) -> str:
    base = scratch_path(spark, "raw")
    fx.meter_lines(events(spark, sf)).write.text(base)
    return base


def q_source_readings(spark, sf):
    """Raw reading lines in files, read by the text data source: the lines that parse."""
    r = ds.kept(spark, _raw_files(spark, sf), "readings")
    return r.select("meter_id", "day", "hour", _r("reading"))


def q_source_rejected(spark, sf):
    """The raw lines that do not parse, each with its reason."""
    return ds.rejected(spark, _raw_files(spark, sf), "readings")


def q_source_balance(spark, sf):
    """Lines in the files of each meter, as Spark's own reader counts them, and what the source keeps and rejects."""
    base = _raw_files(spark, sf)
    meter = lambda c: F.split_part(c, F.lit("\t"), F.lit(1)).alias("meter")
    lines = spark.read.text(base).groupBy(meter(F.col("value"))).agg(F.count("*").alias("n_lines"))
    d = ds.read(spark, base, "readings").groupBy(meter(F.col("line"))).agg(
        F.count_if(F.col("reason").isNull()).alias("n_kept"), F.count("reason").alias("n_rejected"))
    return lines.join(d, "meter", "full")


def q_source_points(spark, sf):
    """Points written as text; those of a date range, compared inside the source's tasks."""
    base = scratch_path(spark, "points")
    tx.write_points(points(spark, sf), base)
    d = ds.kept(spark, base, "points").where(F.col("day").between(F.lit(P.SLICE_FIRST).cast("date"), F.lit(P.SLICE_LAST).cast("date")))
    return _long(d, ["meter_id", "day"], "x")


def q_source_results(spark, sf):
    """Shares and entropies of the fit, written in their text formats and read by the source."""
    base = scratch_path(spark, "results")
    _, res, assigned = fitted(spark, sf)
    tx.write_shares(ksc.centroid_shares(ksc.model_frame(spark, res.model)), f"{base}/shares")
    tx.write_entropy(ksc.meter_entropy(assigned), f"{base}/entropies")
    shares, entropy = (ds.kept(spark, f"{base}/{kind}", kind) for kind in ("shares", "entropies"))
    return shares.select(F.lit("share").alias("kind"), F.col("cid").alias("id"), _r("share", "value")).unionByName(
        entropy.select(F.lit("entropy").alias("kind"), F.col("meter_id").alias("id"), _r("entropy", "value")))


QUERIES.update({
    "source_readings": q_source_readings,
    "source_rejected": q_source_rejected,
    "source_balance": q_source_balance,
    "source_points": q_source_points,
    "source_results": q_source_results,
})
