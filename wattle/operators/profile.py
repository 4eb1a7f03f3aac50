"""Per (meter, hour) load regression and the activity profile.

For every meter and hour of day, the reading is regressed on the readings of the three
previous days (previous *rows* of that meter-hour ordered by date) and three temperature
terms, with an intercept:

    y = b0 + b1 lag1 + b2 lag2 + b3 lag3 + b4 max(t-20,0) + b5 max(16-t,0) + b6 max(5-t,0)

A group with fewer than 7 usable observations or a singular design (e.g. an hour never
below 5 C) gets all-zero coefficients and ``fallback = true``. The activity load removes
the temperature part: ``reading - b4 x4 - b5 x5 - b6 x6`` (intercept and lags stay), and
its mean and population standard deviation per (meter, hour) form the profile.

Plan (robust to copies and to hot keys): exact copies of a row are collapsed into (row,
multiplicity m) by an aggregate that runs partial before its shuffle, so a group of copies
holding any share of the data never reaches one task as rows. A (meter, hour) is cut into
blocks by calendar month; the windows run over one block, and only the three last rows of each block are
carried to the next (``runs``), so a meter-hour holding any share of the rows is spread over as
many tasks as it has months. Inside a run of m copies the lags are determined by the copy's position,
so each distinct row yields at most four observation templates (copies 1, 2, 3, and copies 4..m
with weight m - 3). The regression moments and the whole-group moments are one weighted
co-moment matrix per block, combined map-side and merged over the blocks (``_moments``);
the activity load is linear in them, so its mean and population variance follow in closed
form from the betas: no join back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import solve_ldl
from ..functions.regimes import temperature_terms
from ..session import tasks_for

N_REGRESSORS = 6
MIN_OBS = N_REGRESSORS + 1
PIVOT_TOL = 1e-10
BETAS = [f"b{i}" for i in range(N_REGRESSORS + 1)]
KEY = ["meter_id", "hour"]
ORDER = ["read_date", "reading", "temperature"]
COPY_CHUNK = 4096
SALTS = 16
ROWS_PER_TASK = 500_000   # rows that one task sorts for the windows


def with_temperature_terms(weather: DataFrame) -> DataFrame:
    cdd, hdd, cold = temperature_terms(F.col("temperature"))
    return weather.withColumns({"x4": cdd, "x5": hdd, "x6": cold})


def block():
    """Month number of a row's date (0 for a null date): a block of a (meter, hour)."""
    return F.coalesce(F.year("read_date") * 12 + F.month("read_date"), F.lit(0))


def collapsed(weather: DataFrame) -> DataFrame:
    """Distinct rows with their copy count ``m`` and ``block``. Rows without meter or hour
    belong to no group and are left out."""
    d = weather.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).groupBy(*KEY, *ORDER).agg(F.count(F.lit(1)).alias("m"))
    return d.withColumn("block", block())


def carried(d: DataFrame) -> DataFrame:
    """What each block of ``collapsed`` rows takes over: ``c1, c2, c3``, the last rows before it
    as (reading, m) (null where there are fewer), and ``ref``, a typical (reading, temperature)
    of the whole (meter, hour): the middle one of the first block's last readings.

    At most three rows of a block are collected; the window over a meter-hour's blocks sees
    one row for each."""
    w = Window.partitionBy(*KEY, "block").orderBy(*ORDER)
    last = d.withColumns({"_n": F.row_number().over(w), "_more": F.lead("m", 3).over(w)}).where("_more IS NULL")
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("_n", "reading", "m", "temperature"))))      # latest first
    last = last.groupBy(*KEY, "block").agg(rows.alias("e"))
    middle = F.expr("coalesce(element_at(array_sort(transform(e, r -> r.reading)), CAST(size(e) div 2 + 1 AS INT)), 0.0D)")
    last = last.select(*KEY, "block", F.transform("e", lambda r: F.struct(r["reading"], r["m"])).alias("last"),
                       F.struct(middle.alias("reading"), F.expr("coalesce(e[0].temperature, 0.0D)").alias("temperature")).alias("r"))
    w = Window.partitionBy(*KEY).orderBy("block")
    before = F.concat(*[F.coalesce(F.lag("last", i).over(w), F.slice("last", 1, 0)) for i in (1, 2, 3)])
    last = last.select(*KEY, "block", before.alias("c"), F.first("r").over(w).alias("ref"))
    return last.select(*KEY, "block", *[F.get("c", F.lit(i - 1)).alias(f"c{i}") for i in (1, 2, 3)], "ref")


def runs(weather: DataFrame) -> DataFrame:
    """Distinct rows of each (meter, hour) with their copy count ``m`` and run context.

    ``s``: rows (copies included) before the run in date order, counted up to the copies of
    its three last distinct rows (so ``s >= 3`` is exact); ``t1, t2, t3``: readings at the last
    three of those positions (null where there are fewer). Equal dates are ordered by value,
    so copies are adjacent. ``ref``: a typical (reading, temperature) of the (meter, hour), to take differences from.

    A segmented window: the window runs over a block, and the first three rows of a block
    look on into the rows that it took over (``carried``), joined on the block.
    """
    # one shuffle, which both sides of the join read; its explicit count is kept, while adaptive
    # coalescing by bytes would leave the sorts and windows of small rows to a few tasks. The
    # count follows the rows, so that what a task sorts does not grow with the table
    n = tasks_for(weather.sparkSession, weather.count(), ROWS_PER_TASK)
    d = collapsed(weather).repartition(n, *KEY, "block")
    w = Window.partitionBy(*KEY, "block").orderBy(*ORDER)
    own = d.withColumns({"_n": F.row_number().over(w), **{f"_r{i}": F.lag("reading", i).over(w) for i in (1, 2, 3)},
                         **{f"_m{i}": F.lag("m", i).over(w) for i in (1, 2)}})
    own = own.join(carried(d), [*KEY, "block"])

    def previous(i, value, name):
        """``value`` of the i-th distinct row before: of the block, else of those taken over."""
        over = "".join(f" WHEN _n = {n} THEN c{i + 1 - n}.{value}" for n in range(1, i + 1))
        return f"CASE WHEN _n > {i} THEN _{value[0]}{i}{over} END AS {name}"
    own = own.selectExpr(*KEY, *ORDER, "block", "m", "_n", "ref",
                         *[previous(i, "reading", f"p{i}") for i in (1, 2, 3)], *[previous(i, "m", f"k{i}") for i in (1, 2)],
                         "CASE WHEN _n > 3 THEN 1 WHEN _n = 3 THEN c1.m WHEN _n = 2 THEN c2.m ELSE c3.m END AS k3")
    return own.selectExpr(
        *KEY, *ORDER, "block", "m", "coalesce(k1, 0) + coalesce(k2, 0) + coalesce(k3, 0) AS s", "ref", "p1 AS t1",
        "CASE WHEN k1 >= 2 THEN p1 ELSE p2 END AS t2",
        "CASE WHEN k1 >= 3 THEN p1 WHEN k1 + k2 >= 3 THEN p2 ELSE p3 END AS t3",
    )


def with_lags(weather: DataFrame) -> DataFrame:
    """Every row with ``lag1..lag3``: the readings of the 1..3 previous rows of the same
    (meter, hour) by date (gaps in the calendar are ignored; equal dates are ordered by
    value). Copies are expanded from their run, so the window never sees them. The first
    ``COPY_CHUNK`` copies of a run are expanded in place; the lags of the others are the
    reading itself, so they need no window and are dealt out in chunks: no array holds more than
    ``COPY_CHUNK`` positions and no task regenerates a huge run alone."""
    c = F.lit(COPY_CHUNK).cast("long")
    r = runs(weather).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("m"), c))))
    r = r.selectExpr(
        *KEY, *ORDER,
        "CASE WHEN _k >= 2 THEN reading ELSE t1 END AS lag1",
        "CASE WHEN _k >= 3 THEN reading WHEN _k = 2 THEN t1 ELSE t2 END AS lag2",
        "CASE WHEN _k >= 4 THEN reading WHEN _k = 3 THEN t1 WHEN _k = 2 THEN t2 ELSE t3 END AS lag3",
    )
    more = collapsed(weather).where(F.col("m") > c)
    more = more.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("m") - 1) / c))))
    more = more.repartition(*KEY, *ORDER, "_c")
    more = more.withColumn("_k", F.explode(F.sequence(F.col("_c") * c + 1, F.least(F.col("_c") * c + c, F.col("m")))))
    return r.unionByName(more.select(*KEY, *ORDER, *[F.col("reading").alias(f"lag{i}") for i in (1, 2, 3)]))


_OBS = ["y", "l1", "l2", "l3", "x4", "x5", "x6"]
_ACT = ["y", "x4", "x5", "x6"]
#: the two weights of a template row and the columns whose co-moments they weigh
_SETS = {"o": _OBS, "a": _ACT}


def _upper(names: list[str]) -> list[tuple[str, str]]:
    return [(u, v) for i, u in enumerate(names) for v in names[i:]]


def _templates(rs: DataFrame) -> DataFrame:
    """Weighted observations, as differences from the group's ``ref``: ``o`` weighs the
    regression (null where a lag or value is missing), ``a`` the whole-group moments (the
    row's copies, once)."""
    r = with_temperature_terms(rs).where("reading IS NOT NULL AND temperature IS NOT NULL")
    ref = dict(zip(("ref_x4", "ref_x5", "ref_x6"), temperature_terms(F.col("ref.temperature"))))
    r = r.withColumns({"ref_y": F.col("ref.reading"), **ref})
    r = r.withColumns({**{v: F.col(c) - F.col("ref_y") for v, c in (("y", "reading"), ("t1", "t1"), ("t2", "t2"), ("t3", "t3"))},
                       **{x: F.col(x) - F.col(f"ref_{x}") for x in ("x4", "x5", "x6")}})

    def item(o, a, l1, l2, l3):
        return f"named_struct('o', CAST({o} AS DOUBLE), 'a', CAST({a} AS DOUBLE), 'l1', {l1}, 'l2', {l2}, 'l3', {l3})"
    first = item("CASE WHEN s >= 3 THEN 1 END", "m", "t1", "t2", "t3")
    rest = [item("CASE WHEN s >= 2 THEN 1 END", "NULL", "y", "t1", "t2"),
            item("CASE WHEN m >= 3 AND s >= 1 THEN 1 END", "NULL", "y", "y", "t1"),
            item("CASE WHEN m >= 4 THEN m - 3 END", "NULL", "y", "y", "y")]
    e = r.selectExpr(*KEY, "ref_y", *ref, "y", "x4", "x5", "x6",
                     f"inline(CASE WHEN m = 1 THEN array({first}) ELSE array({first}, {', '.join(rest)}) END)")
    return e.withColumn("o", F.expr("CASE WHEN l1 + l2 + l3 IS NOT NULL THEN o END"))


def _moments(rs: DataFrame) -> DataFrame:
    """Per (meter, hour): regression moments (means, covariances, n_obs) and whole-group
    activity moments.

    One mergeable co-moment each: weight W, weighted sums D and weighted products S of
    differences from the group's reference r, added up map-side and merged by addition. Then
    mean = r + D / W and the covariance is (S_uv - D_u D_v / W) / W. Differences keep the digits
    of large readings. A regressor whose least and greatest value are equal has no spread at all,
    which the singularity test relies on (sums of rounded differences would leave some).
    """
    sums = {f"_W{k}": f"sum({k})" for k in _SETS}
    for k, names in _SETS.items():
        sums |= {f"_D{k}_{v}": f"sum({k} * {v})" for v in names}
        sums |= {f"_S{k}_{u}_{v}": f"sum({k} * {u} * {v})" for u, v in _upper(names)}
    for v in _OBS[1:]:
        sums |= {f"_lo_{v}": f"min(CASE WHEN o > 0 THEN {v} END)", f"_hi_{v}": f"max(CASE WHEN o > 0 THEN {v} END)"}
    # the references are the same for all rows of a group
    refs = ["ref_y", "ref_x4", "ref_x5", "ref_x6"]
    g = _templates(rs).groupBy(*KEY).agg(*[F.first(c).alias(c) for c in refs], *[F.expr(e).alias(n) for n, e in sums.items()])

    def mean(k, v):
        return f"{'ref_y' if v in ('y', 'l1', 'l2', 'l3') else 'ref_' + v} + _D{k}_{v} / _W{k}"

    def cov(k, u, v):
        c = f"(_S{k}_{u}_{v} - _D{k}_{u} * _D{k}_{v} / _W{k}) / _W{k}"
        flat = " OR ".join(f"_lo_{x} = _hi_{x}" for x in dict.fromkeys((u, v)) if k == "o" and x != "y")
        return f"CASE WHEN {flat} THEN 0.0D ELSE {c} END" if flat else c
    obs = {1: "l1", 2: "l2", 3: "l3", 4: "x4", 5: "x5", 6: "x6"}
    out = ["CAST(coalesce(_Wo, 0) AS BIGINT) AS n_obs", f"{mean('o', 'y')} AS _my"]
    out += [f"{mean('o', v)} AS _m{i}" for i, v in obs.items()]
    out += [f"{cov('o', vi, vj)} AS _s{i}{j}" for i, vi in obs.items() for j, vj in obs.items() if i <= j]
    out += [f"{cov('o', 'y', v)} AS _t{i}" for i, v in obs.items()]
    out += [f"{mean('a', 'y')} AS _ar", f"{cov('a', 'y', 'y')} AS _vr"]
    out += [f"{mean('a', f'x{k}')} AS _a{k}" for k in (4, 5, 6)]
    out += [f"{cov('a', 'y', f'x{k}')} AS _cr{k}" for k in (4, 5, 6)]
    out += [f"{cov('a', u, v)} AS _c{u[1]}{v[1]}" for u, v in _upper(["x4", "x5", "x6"])]
    return g.selectExpr(*KEY, *out)


def _solve(g: DataFrame) -> DataFrame:
    idx = [1, 2, 3, 4, 5, 6]
    s = {(a, b): f"_s{idx[a]}{idx[b]}" for a in range(6) for b in range(6) if a <= b}
    g = solve_ldl(g, s, [f"_t{i}" for i in idx], BETAS[1:], PIVOT_TOL)
    intercept = F.col("_my")
    for i in idx:
        intercept = intercept - F.col(f"b{i}") * F.col(f"_m{i}")
    ok = (F.col("n_obs") >= MIN_OBS) & F.col("_solved")
    return g.withColumns({
        **{name: F.when(ok, c).otherwise(F.lit(0.0))
           for name, c in [("b0", intercept)] + [(f"b{i}", F.col(f"b{i}")) for i in idx]},
        "fallback": ~ok,
    })


def fit_betas(weather: DataFrame) -> DataFrame:
    """``meter_id, hour, n_obs, b0..b6, fallback`` from weather readings
    (``meter_id, read_date, hour, reading, temperature``)."""
    g = _solve(_moments(runs(weather)))
    return g.select(*KEY, "n_obs", *BETAS, "fallback")


def activity_profile(weather: DataFrame) -> DataFrame:
    """``meter_id, hour, mean, sd`` (population sd) of the activity load.

    activity = reading - b4 x4 - b5 x5 - b6 x6, so over a group
    mean = E[r] - sum b_k E[x_k] and var = var(r) - 2 sum b_k cov(r, x_k)
    + sum_k sum_l b_k b_l cov(x_k, x_l).
    """
    g = _solve(_moments(runs(weather)))
    b = {k: F.col(f"b{k}") for k in (4, 5, 6)}
    mean = F.col("_ar")
    var = F.col("_vr")
    for k in b:
        mean = mean - b[k] * F.col(f"_a{k}")
        var = var - F.lit(2.0) * b[k] * F.col(f"_cr{k}")
    for k in b:
        for l in b:
            var = var + b[k] * b[l] * F.col(f"_c{min(k, l)}{max(k, l)}")
    return g.select(*KEY, mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def activity(weather: DataFrame) -> DataFrame:
    """Per-row activity load (``reading`` minus the fitted temperature-driven load).

    The models are a row for each meter-hour; every one is handed out ``SALTS`` times and the
    rows take turns, so a meter-hour holding any share of the rows, copies or not, is no hot
    key. (Which row takes which does not matter for the result.)"""
    rows = with_temperature_terms(weather).withColumn("_salt", F.monotonically_increasing_id() % SALTS)
    betas = fit_betas(weather).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    act = F.col("reading") - F.col("b4") * F.col("x4") - F.col("b5") * F.col("x5") - F.col("b6") * F.col("x6")
    return rows.join(betas, [*KEY, "_salt"]).withColumn("activity", act).drop("_salt")


def profile_arrays(profile: DataFrame, hours: int = 24) -> DataFrame:
    """``meter_id, mean ARRAY<DOUBLE>, sd ARRAY<DOUBLE>`` with 0.0 for missing hours."""
    def slots(c):
        return F.expr("array(" + ", ".join(f"coalesce(max(CASE WHEN hour = {h} THEN `{c}` END), 0.0D)"
                                           for h in range(hours)) + ")")
    return profile.groupBy("meter_id").agg(slots("mean").alias("mean"), slots("sd").alias("sd"))
