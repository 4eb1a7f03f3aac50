"""K-SC: shift-invariant k-means over normalised daily load shapes.

Model state is the K centroids of 24 values (K is chosen by the user; the seed pool holds
100), so each iteration ships it to the tasks with the task closure (the DataFrame
equivalent of a broadcast variable) and gets it back as one aggregated row per cluster:

  assign  : narrow over the persisted points (Arrow-batched kernel by default), no
            shuffle, no join
  update  : groupBy(cid) with partial aggregation -> at most K rows per task cross the
            network, so a cluster holding a third of all points costs nothing extra
  quality : no pass of its own: the update also sums the squared lengths of the shapes

The loop's plan has constant size (points + model), so lineage does not grow with the
iteration count; the points are spread, checkpointed and persisted once (``stable``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import assign_udf
from ..functions.literals import sql_array
from ..functions.shapes import DAY, crop, normalize, scaled_distance, shift_candidates, sq_distance
from ..session import cached, parallelism, reliable, spread
from .loopstate import LoopState
from .prepare import is_finite

Model = dict  # cid -> (n, list[float])


# ---------------------------------------------------------------------------------------
# model <-> columns
# ---------------------------------------------------------------------------------------

def model_literal(model: Model) -> Column:
    """``ARRAY<STRUCT<cid INT, c ARRAY<DOUBLE>>>`` ordered by cid."""
    items = ", ".join(f"named_struct('cid', {int(cid)}, 'c', {sql_array(c)})" for cid, (_, c) in sorted(model.items()))
    return F.expr(f"array({items})")


def collect_model(centroids: DataFrame) -> Model:
    """Bring a centroid table (``cid, n, c``; at most a few hundred rows) to the driver."""
    return {int(r["cid"]): (int(r["n"]), [float(v) for v in r["c"]]) for r in centroids.collect()}


def model_frame(spark, model: Model) -> DataFrame:
    rows = [(int(cid), int(n), [float(v) for v in c]) for cid, (n, c) in sorted(model.items())]
    return spark.createDataFrame(rows, "cid INT, n BIGINT, c ARRAY<DOUBLE>")


# ---------------------------------------------------------------------------------------
# assign / update
# ---------------------------------------------------------------------------------------

# "arrow": vectorised numpy kernel over Arrow batches (bit-identical to "sql", 16-35x faster)
# "sql": pure higher-order array expressions (no Python worker)
ASSIGN_METHOD = "arrow"


def assign(points: DataFrame, model: Model, max_shift: int = 1, length: int = DAY,
           method: str | None = None) -> DataFrame:
    """Assign every point to its nearest centroid under the K-SC distance.

    For each shift q in [-max_shift, max_shift] the point is rotated, centre-cropped to
    ``length`` and normalised once; every (shift, centroid) pair is then scored and the
    minimum of ``(dist, cid, q)`` wins, i.e. ties go to the lowest cid, then the smallest q.

    ``points``: ``meter_id, day, x`` -> adds ``cid INT, q INT, dist DOUBLE, z ARRAY<DOUBLE>``.
    Points need at least ``length`` finite values (see ``stable`` and ``prepare.is_finite``);
    any other point is an error.
    """
    if not model:
        raise ValueError("empty model")
    method = method or ASSIGN_METHOD
    if method == "arrow":
        best = assign_udf(model, max_shift, length)(F.col("x"))
        return points.withColumn("_best", best).select(
            *points.columns,
            *[F.col(f"_best.{c}").alias(c) for c in ("cid", "q", "dist", "z")],
        )
    cents = model_literal(model)
    good = is_finite() & (F.size("x") >= length)
    points = points.withColumn("x", F.when(good, F.col("x")).otherwise(F.raise_error(F.lit(
        f"a point needs {length} hours, all finite")).cast("array<double>")))
    scored = F.flatten(
        F.transform(
            F.col("_cands"),
            lambda s: F.transform(
                cents,
                lambda c: F.struct(
                    F.sqrt(sq_distance(s["z"], c["c"], check=False)).alias("dist"),
                    c["cid"].alias("cid"),
                    s["q"].alias("q"),
                    s["z"].alias("z"),
                ),
            ),
        )
    )
    return (
        points.withColumn("_cands", shift_candidates("x", max_shift, length))
        .withColumn("_best", F.array_min(scored))
        .select(
            *[c for c in points.columns],
            F.col("_best.cid").alias("cid"),
            F.col("_best.q").alias("q"),
            F.col("_best.dist").alias("dist"),
            F.col("_best.z").alias("z"),
        )
    )


def update(assigned: DataFrame, length: int = DAY) -> DataFrame:
    """New centroids: per-position mean of the assigned shapes, and the sum of the shapes'
    squared lengths. ``cid, n, c, ss``.

    A cluster that received no point has no row (the effective K can shrink).
    """
    squares = " + ".join(f"z[{i}] * z[{i}]" for i in range(length))
    return assigned.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("array(" + ", ".join(f"avg(z[{i}])" for i in range(length)) + ")").alias("c"),
        F.expr(f"sum({squares})").alias("ss"),
    )


def movement(new_centroids: DataFrame, old: Model, delta: float) -> DataFrame:
    """Adds ``moved`` (distance from the previous centroid) and ``over`` (moved > delta)."""
    before = model_frame(new_centroids.sparkSession, old).select("cid", F.col("c").alias("_old"))
    both = new_centroids.join(F.broadcast(before), "cid")   # K rows
    return both.withColumn("moved", F.sqrt(sq_distance("c", "_old"))).drop("_old").withColumn(
        "over", F.col("moved") > F.lit(delta))


# ---------------------------------------------------------------------------------------
# fit
# ---------------------------------------------------------------------------------------

@dataclass
class FitResult:
    k: int
    model: Model               # centroids after the last update (cluster means)
    assigning_model: Model     # model the final assignment was made with
    iterations: int
    converged: bool
    squares: float = 0.0       # sum of the squared lengths of the finally assigned shapes
    history: list = field(default_factory=list)   # (iteration, n_moved, total_moved)


#: points of one task of an iteration, about
POINTS_PER_TASK = 50_000


def stable(points: DataFrame) -> DataFrame:
    """Points ready for iterating: without points that have a missing or non-finite value,
    checkpointed, then spread over a partition count sized from their row count (at least the
    task slots) and persisted. Adaptive execution sizes partitions by bytes, which can leave
    these small but CPU-heavy rows in one task; the shuffle partitions of the session, sized for
    the raw input, would start far more tasks a turn than the points need."""
    kept = reliable(points.where(is_finite()))
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // POINTS_PER_TASK))
    return cached(spread(kept, tasks))


def rejected(points: DataFrame) -> int:
    """How many points ``stable`` leaves out."""
    return points.where(~is_finite()).count()


def fit(points: DataFrame, seeds: Model, max_iter: int = 100, delta: float = 1e-4,
        max_shift: int = 1, length: int = DAY) -> FitResult:
    """Iterate assign -> update until no centroid moves more than ``delta`` or
    ``max_iter`` iterations ran. Pass ``stable(points)`` (each iteration scans them)."""
    model = dict(seeds)
    prev = model
    history = []
    converged = False
    it, squares = 0, 0.0
    while it < max_iter and not converged:
        rows = update(assign(points, model, max_shift, length), length).collect()   # K rows
        over = [moved for r in rows if (moved := math.dist(r["c"], model[int(r["cid"])][1])) > delta]
        prev = model
        model = {int(r["cid"]): (int(r["n"]), [float(v) for v in r["c"]]) for r in rows}
        squares = math.fsum(r["ss"] for r in rows)
        history.append((it, len(over), float(sum(over))))
        converged = len(over) == 0
        it += 1
    return FitResult(len(seeds), model, prev, it, converged, squares, history)


def update_many(points: DataFrame, models: dict[int, Model], max_shift: int = 1, length: int = DAY) -> DataFrame:
    """One pass over the points for several models: ``k, cid, n, c, ss``, as ``update`` of each.

    Every model scores a batch of points in the same Python worker; a point then counts once
    for each model, and at most the models' centroids cross the network for each task."""
    best = points.select(*[assign_udf(m, max_shift, length)(F.col("x")).alias(f"b{k}") for k, m in models.items()])
    items = ", ".join(f"named_struct('k', {int(k)}, 'cid', b{k}.cid, 'z', b{k}.z)" for k in models)
    squares = " + ".join(f"z[{i}] * z[{i}]" for i in range(length))
    return best.selectExpr(f"inline(array({items}))").groupBy("k", "cid").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("array(" + ", ".join(f"avg(z[{i}])" for i in range(length)) + ")").alias("c"),
        F.expr(f"sum({squares})").alias("ss"),
    )


def fit_many(points: DataFrame, seeds: dict[int, Model], max_iter: int = 100, delta: float = 1e-4,
             max_shift: int = 1, length: int = DAY, state: LoopState | None = None,
             group: int = 0) -> tuple[dict[int, FitResult], int]:
    """``fit`` for several models at once, and the number of passes over the points: the
    turns of the model that needs most. A model that has converged takes no further part.

    With ``state`` every turn is stored (as ``group``), and a fit stopped earlier goes on behind its
    last stored turn; the passes counted are those of this run."""
    fits = {k: FitResult(len(m), dict(m), dict(m), 0, False) for k, m in seeds.items()}
    before = state.load(group, fits) if state else 0
    scans = 0
    while active := {k: f.model for k, f in fits.items() if not f.converged and f.iterations < max_iter}:
        found: dict = {k: [] for k in active}
        for r in update_many(points, active, max_shift, length).collect():      # a row for each centroid
            found[r["k"]].append(r)
        scans += 1
        for k, rows in found.items():
            f = fits[k]
            over = [moved for r in rows if (moved := math.dist(r["c"], f.model[int(r["cid"])][1])) > delta]
            f.assigning_model = f.model
            f.model = {int(r["cid"]): (int(r["n"]), [float(v) for v in r["c"]]) for r in rows}
            f.squares = math.fsum(r["ss"] for r in rows)
            f.history.append((f.iterations, len(over), float(sum(over))))
            f.iterations, f.converged = f.iterations + 1, not over
        if state:
            state.save(group, before + scans, fits)
    return fits, scans


# ---------------------------------------------------------------------------------------
# the text's variant: free scale, distance divided by the point's norm, spectral centroids
# ---------------------------------------------------------------------------------------

def assign_scaled(points: DataFrame, model: Model, max_shift: int = 1, length: int = DAY) -> DataFrame:
    """As ``assign`` under ``shapes.scaled_distance``: adds ``cid, q, dist, alpha`` and the raw
    shifted shape ``z``. Ties go to the lowest cid, then the smallest q."""
    scored = F.transform(model_literal(model), lambda m: F.struct(m["cid"].alias("cid"), scaled_distance("x", m["c"], max_shift, length).alias("d")))
    best = F.array_min(F.transform(scored, lambda s: F.struct(
        s["d"]["dist"].alias("dist"), s["cid"].alias("cid"), *[s["d"][c].alias(c) for c in ("q", "alpha", "z")])))
    return points.withColumn("_best", best).select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in ("cid", "q", "dist", "alpha", "z")])


def update_scaled(assigned: DataFrame, length: int = DAY) -> Model:
    """The centroids that the assigned shapes are nearest to: with every shape scaled to norm 1,
    the sum of squared distances of a cluster is n - c'Mc for the unit centroid c and
    M = sum of z z' / |z|^2, so c is M's leading eigenvector (its sum is made positive).

    A task adds up one matrix for each cluster it meets; K matrices of ``length`` squared sums reach
    the driver. Zero shapes have no direction: they count, but do not pull."""
    def partial(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            cids = b.column(0).to_numpy(zero_copy_only=False)
            z = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cids), length)
            norm = np.sqrt((z * z).sum(axis=1))
            z = z / np.where(norm > 0, norm, 1.0)[:, None]
            for c in np.unique(cids):
                mine = z[cids == c]
                n, m = sums.get(int(c), (0, 0.0))
                sums[int(c)] = (n + len(mine), m + mine.T @ mine)
        for c, (n, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)),
                                              pa.array([n] * m.size, pa.int64()), pa.array(m.ravel())], ["cid", "at", "n", "s"])
    sums = assigned.select("cid", "z").mapInArrow(partial, "cid INT, at INT, n BIGINT, s DOUBLE")
    model: dict = {}
    for r in sums.groupBy("cid", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():     # K * length^2 numbers
        n, m = model.setdefault(r["cid"], (r["n"], np.zeros(length * length)))
        m[r["at"]] = r["s"]
    out = {}
    for cid, (n, m) in sorted(model.items()):
        lead = np.linalg.eigh(m.reshape(length, length))[1][:, -1]
        out[cid] = (int(n), [float(v) for v in (lead if lead.sum() >= 0 else -lead)])
    return out


def fit_scaled(points: DataFrame, seeds: Model, max_iter: int = 100, delta: float = 1e-4, max_shift: int = 1, length: int = DAY) -> FitResult:
    """``fit`` in the text's variant. ``squares`` is the sum of squared distances of the last
    assignment, which no turn can raise."""
    res = FitResult(len(seeds), dict(seeds), dict(seeds), 0, False)
    while res.iterations < max_iter and not res.converged:
        a = assign_scaled(points, res.model, max_shift, length)
        res.assigning_model, res.model = res.model, update_scaled(a, length)
        unit = {c: np.array(v) / (np.linalg.norm(v) or 1.0) for c, (_, v) in res.assigning_model.items()}
        over = [d for c, (_, v) in res.model.items() if (d := math.dist(v, unit[c])) > delta]
        res.history.append((res.iterations, len(over), float(sum(over))))
        res.iterations, res.converged = res.iterations + 1, not over
    total = assign_scaled(points, res.assigning_model, max_shift, length).agg(F.sum(F.col("dist") * F.col("dist"))).first()[0]
    res.squares = float(total or 0.0)
    return res


# ---------------------------------------------------------------------------------------
# quality
# ---------------------------------------------------------------------------------------

def quality(model: Model, squares: float, k_requested: int) -> dict:
    """Quality of an assignment whose cluster means are ``model`` and whose shapes' squared
    lengths sum to ``squares``; needs no pass over the points.

    With N points, K weighted means c_k and their weighted mean m: SSB = sum n_k |c_k - m|^2,
    SSW = squares - sum n_k |c_k|^2, SST = SSB + SSW, coverage = SSB / SST and
    Calinski-Harabasz = SSB (N - K) / (SSW (K - 1)) with the requested K (None for K = 1
    or SSW = 0).
    """
    weight = np.array([n for n, _ in model.values()], float)
    means = np.array([c for _, c in model.values()], float)
    spread_ = means - np.average(means, axis=0, weights=weight)
    ssb = float(weight @ np.einsum("kl,kl->k", spread_, spread_))
    ssw = max(0.0, float(squares - weight @ np.einsum("kl,kl->k", means, means)))
    n, sst = int(weight.sum()), ssb + ssw
    return {"k": int(k_requested), "k_effective": len(model), "n_points": n, "sst": sst, "ssb": ssb, "ssw": ssw,
            "coverage": ssb / sst if sst else None,
            "ch": ssb * (n - k_requested) / (ssw * (k_requested - 1)) if k_requested > 1 and ssw else None}


# ---------------------------------------------------------------------------------------
# K sweep
# ---------------------------------------------------------------------------------------

def sample_seeds(pool: DataFrame, k: int, salt: str = "k") -> DataFrame:
    """A fresh sample of ``k`` centroids from the seed pool, renumbered 1..k."""
    key = F.md5(F.concat_ws("|", F.lit(salt), F.lit(k).cast("string"), F.col("cid").cast("string")))
    top = pool.select(key.alias("_key"), F.col("cid").alias("_src"), "c").orderBy("_key", "_src").limit(k)
    w = Window.orderBy("_key", "_src")
    return top.select(F.row_number().over(w).cast("int").alias("cid"), F.lit(1).cast("long").alias("n"), "c")


#: models that a sweep fits in one pass: at most so many less one are fitted in vain
TOGETHER = 4


@dataclass
class SweepResult:
    table: list          # dicts with k, iterations, converged, quality fields
    fit: FitResult       # fit of the last K tried
    assigned: DataFrame  # final assignment of the last K (persisted)
    scans: int = 0       # passes over the points


def sweep(points: DataFrame, pool: DataFrame, k_start: int, k_end: int, least_coverage: float,
          max_iter: int = 100, delta: float = 1e-4, max_shift: int = 1, length: int = DAY,
          together: int | None = None, state: LoopState | None = None) -> SweepResult:
    """Raise K from ``k_start`` until the coverage reaches ``least_coverage`` (or ``k_end``).

    Every K starts from a fresh sample of the seed pool. The first K that reaches the coverage is
    kept. ``together`` (default ``TOGETHER``) Ks are fitted at a time, each turn one pass over the
    points for all of them, so a group of Ks costs the passes of its slowest; results do not depend
    on it. With ``state`` a sweep stopped earlier goes on behind its last stored turn.
    """
    if k_start > k_end or k_start < 1:
        raise ValueError("need 1 <= k_start <= k_end")
    together = together or TOGETHER
    table: list = []
    res, scans, done = None, 0, False
    pool = cached(pool)  # at most a few hundred rows, sampled once per K
    for first in range(k_start, k_end + 1, together):
        ks = range(first, min(first + together, k_end + 1))
        fits, n = fit_many(points, {k: collect_model(sample_seeds(pool, k)) for k in ks}, max_iter, delta, max_shift, length, state, first)
        scans += n
        for k in ks:
            res = fits[k]
            q = quality(res.model, res.squares, k)
            table.append({**q, "iterations": res.iterations, "converged": res.converged})
            done = q["coverage"] is not None and q["coverage"] >= least_coverage
            if done:
                break
        if done:
            break
    pool.unpersist()
    # only the kept K's assignment is persisted, for tags and entropy
    return SweepResult(table, res, cached(assign(points, res.assigning_model, max_shift, length)), scans)


def sweep_frame(spark, table: list) -> DataFrame:
    schema = ("k INT, k_effective INT, iterations INT, converged BOOLEAN, n_points BIGINT, "
              "sst DOUBLE, ssb DOUBLE, ssw DOUBLE, coverage DOUBLE, ch DOUBLE")
    rows = [(r["k"], r["k_effective"], r["iterations"], r["converged"], r["n_points"], r["sst"],
             r["ssb"], r["ssw"], r["coverage"], r["ch"]) for r in table]
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------------------
# outputs: shares, tags, entropy
# ---------------------------------------------------------------------------------------

def centroid_shares(centroids: DataFrame) -> DataFrame:
    """``cid, n, share`` (% of all points), ordered by share descending then cid.

    Runs on the centroid table (at most a few hundred rows), so the global window is cheap.
    """
    total = F.sum("n").over(Window.partitionBy())
    return (centroids.select("cid", "n", (F.lit(100.0) * F.col("n") / total).alias("share"), "c")
            .orderBy(F.desc("share"), "cid"))


def one_per_id(points: DataFrame) -> DataFrame:
    """One point of each (meter, day): of several, the one with the least values. Combined
    map-side, so many copies of one id do not meet in one task."""
    return points.groupBy("meter_id", "day").agg(F.min("x").alias("x"))


def tag_points(assigned: DataFrame, length: int = DAY) -> DataFrame:
    """``meter_id, day, cid, original, shifted``: the centre day normalised, and the
    shifted shape the point was assigned with. The original rides along with the
    assignment, so no join is needed. A (meter, day) that occurs more than once is tagged
    as often; pass ``one_per_id`` points for one tag each."""
    return assigned.select(
        "meter_id", "day", "cid",
        normalize(crop("x", length)).alias("original"),
        F.col("z").alias("shifted"),
    )


def meter_entropy(assigned: DataFrame) -> DataFrame:
    """Per meter: ``-sum p ln p`` over the share of its days in each cluster.

    ``meter_id, n_days, n_clusters, entropy`` (exactly 0.0 for a single cluster). Two
    partial aggregates, no window: with n_k days in cluster k and T = sum n_k,
    -sum (n_k/T) ln(n_k/T) = ln T - sum n_k ln n_k / T.
    """
    per = assigned.groupBy("meter_id", "cid").agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy("meter_id").agg(
        F.sum("_n").alias("n_days"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum(F.col("_n") * F.log(F.col("_n").cast("double"))).alias("_s"),
    )
    h = F.log(F.col("n_days").cast("double")) - F.col("_s") / F.col("n_days")
    return g.select("meter_id", "n_days", "n_clusters",
                    F.when(F.col("n_clusters") == 1, F.lit(0.0)).otherwise(F.greatest(h, F.lit(0.0))).alias("entropy"))


def entropy_histogram(entropy: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width histogram of ``entropy`` between its min and max; the maximum falls in
    the last bin. ``bin (1..bins), lo, hi, n`` with empty bins included."""
    spark = entropy.sparkSession
    entropy = cached(entropy.select("entropy"))  # one number per meter, read twice
    lo, hi = entropy.agg(F.min("entropy"), F.max("entropy")).first()
    if lo is None:
        return spark.createDataFrame([], "bin INT, lo DOUBLE, hi DOUBLE, n BIGINT")
    width = (hi - lo) / bins
    if width > 0:
        b = F.least(F.floor((F.col("entropy") - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(bins))
    else:
        b = F.lit(1)
    counts = entropy.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + (F.col("id") - 1) * F.lit(width)).alias("lo"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("hi"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def entropy_class(entropy: DataFrame, threshold: float) -> DataFrame:
    """Adds ``predictable`` (entropy <= threshold)."""
    return entropy.withColumn("predictable", F.col("entropy") <= F.lit(threshold))
