"""DuckDB SQL for every registered query that plain SQL can express.

The SQL is an independent formulation over the same parquet views: list lambdas for
array math (left-to-right folds, like the Spark side), window functions for lag/lead and
numbering, and unrolled CTEs for the fixed-iteration K-SC fits.
"""

from __future__ import annotations

from . import params as P

DAY = 24
D = P.DIGITS


def _with(ctes: list[tuple[str, str]], body: str) -> str:
    seen, parts = set(), []
    for name, sql in ctes:
        if name in seen:
            continue
        seen.add(name)
        parts.append(f"{name} AS (\n{sql}\n)")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def r(expr: str) -> str:
    return f"(round({expr}, {D}) + 0.0)"


def lsum(expr: str) -> str:
    return f"list_reduce({expr}, lambda a, b: a + b)"


def sqdist(a: str, b: str) -> str:
    return lsum(f"list_transform({a}, lambda v, i: CASE WHEN isnan(v) OR isnan(({b})[i]) THEN 0.0 "
                f"ELSE (v - ({b})[i]) * (v - ({b})[i]) END)")


def normalize(expr: str) -> str:
    s = lsum(expr)
    return f"(CASE WHEN {s} = 0 THEN {expr} ELSE list_transform({expr}, lambda v: v / {s}) END)"


def crop_expr(x: str, w: int) -> str:
    if w <= DAY:
        return x
    s = (w - DAY) // 2
    return f"{x}[{s + 1}:{s + DAY}]"


# --------------------------------------------------------------------------- fixtures

def meter_days():
    slots = ", ".join(
        f"round(coalesce(sum(CASE WHEN hour(ts) = {h} THEN value END), 0.0), 2)" for h in range(DAY)
    )
    return [("meter_days", f"SELECT CAST(user_id AS BIGINT) AS meter_id, CAST(ts AS DATE) AS day, "
                           f"[{slots}] AS v FROM events GROUP BY 1, 2")]


def hours():
    return meter_days() + [("hours", "SELECT meter_id, day, unnest(range(24)) AS hour, unnest(v) AS reading "
                                     "FROM meter_days")]


def lines():
    sql = """SELECT line FROM (
  SELECT concat_ws(chr(9), CAST(meter_id AS VARCHAR), ts_txt, rd_txt) AS line, unnest(range(copies)) AS cp
  FROM (
    SELECT meter_id,
      CASE WHEN k % 1009 = 0 THEN 0 WHEN k % 1013 = 0 THEN 2 ELSE 1 END AS copies,
      strftime(day, '%Y-%m-%d') || ' ' || lpad(CAST(hour AS VARCHAR), 2, '0') || ':00:00'
        || CASE WHEN k % 971 = 0 THEN '-06' ELSE '' END AS ts_txt,
      CASE WHEN k % 997 = 0 THEN '' WHEN k % 991 = 0 THEN '1a5' WHEN k % 983 = 0 THEN '.5'
           WHEN k % 977 = 0 THEN '1e1' ELSE CAST(CAST(reading AS DECIMAL(12, 2)) AS VARCHAR) END AS rd_txt
    FROM (SELECT *, (meter_id * 1000 + dayofyear(day)) * 24 + hour AS k FROM hours)))"""
    return hours() + [("lines", sql)]


def readings():
    sql = r"""SELECT * FROM (
  SELECT try_cast(f[1] AS BIGINT) AS meter_id,
    CAST(try_strptime(string_split(f[2], ' ')[1], '%Y-%m-%d') AS DATE) AS day,
    try_cast(string_split(string_split(f[2], ' ')[2], ':')[1] AS INTEGER) AS hour,
    CASE WHEN len(f) > 2 AND length(f[3]) > 0 AND regexp_full_match(f[3], '-?\d+(.\d+)?')
         THEN try_cast(f[3] AS DOUBLE) END AS reading
  FROM (SELECT string_split(line, chr(9)) AS f FROM lines))
WHERE meter_id IS NOT NULL AND day IS NOT NULL AND hour BETWEEN 0 AND 23 AND reading IS NOT NULL"""
    return lines() + [("readings", sql)]


def cdays():
    sql = """SELECT meter_id, day, list(reading ORDER BY hour) AS x FROM readings GROUP BY 1, 2
HAVING count(*) = 24 AND count(DISTINCT hour) = 24 AND sum(reading) > 0"""
    return readings() + [("cdays", sql)]


def fdays():
    """Days without injected faults."""
    return meter_days() + [("fdays", f"SELECT meter_id, day, v AS x FROM meter_days WHERE {lsum('v')} > 0")]


def points(w: int = P.WINDOW, days: str = "fdays"):
    name = f"pts{w}" if days == "fdays" else f"{days}{w}"
    n = (w - DAY) // 2
    source = fdays() if days == "fdays" else cdays()
    if n == 0:
        return source + [(name, f"SELECT meter_id, day, x FROM {days}")]
    sql = f"""SELECT meter_id, day, list_concat(list_concat(prev[{DAY - n + 1}:{DAY}], x), nxt[1:{n}]) AS x FROM (
  SELECT meter_id, day, x, lag(x) OVER w AS prev, lead(x) OVER w AS nxt FROM {days}
  WINDOW w AS (PARTITION BY meter_id ORDER BY day))
WHERE prev IS NOT NULL AND nxt IS NOT NULL"""
    return source + [(name, sql)]


def pool(w: int = P.WINDOW, days: str = "fdays"):
    source = f"pts{w}" if days == "fdays" else f"{days}{w}"
    sql = f"""SELECT CAST(row_number() OVER (ORDER BY key, meter_id, day) AS INTEGER) AS cid, c FROM (
  SELECT md5(concat_ws('|', 'seed', CAST(meter_id AS VARCHAR), strftime(day, '%Y-%m-%d'))) AS key,
         meter_id, day, {normalize(crop_expr('x', w))} AS c
  FROM {source} ORDER BY key, meter_id, day LIMIT {P.POOL})"""
    return points(w, days) + [("pool", sql)]


def seeds(k: int, name: str):
    sql = f"""SELECT CAST(row_number() OVER (ORDER BY key, cid) AS INTEGER) AS cid, CAST(1 AS BIGINT) AS n, c FROM (
  SELECT md5(concat_ws('|', 'k', '{k}', CAST(cid AS VARCHAR))) AS key, cid, c FROM pool
  ORDER BY key, cid LIMIT {k})"""
    return pool() + [(name, sql)]


def cands(w: int = P.WINDOW, q_max: int = P.MAX_SHIFT):
    s = (w - DAY) // 2 if w > DAY else 0
    width = min(w, DAY)
    idx = f"(((i + {s} + (CASE WHEN abs(q) >= {w} THEN 0 ELSE q END)) % {w} + {w}) % {w}) + 1"
    sql = f"""SELECT meter_id, day, q, CASE WHEN s = 0 THEN sc ELSE list_transform(sc, lambda v: v / s) END AS z FROM (
  SELECT meter_id, day, q, sc, {lsum('sc')} AS s FROM (
    SELECT meter_id, day, q, list_transform(range({width}), lambda i: x[{idx}]) AS sc
    FROM pts{w}, (SELECT unnest(range({-q_max}, {q_max + 1})) AS q) qs))"""
    return points(w) + [("cands", sql)]


def assign(model: str, name: str):
    sql = f"""SELECT meter_id, day, cid, q, dist, z FROM (
  SELECT s.meter_id, s.day, m.cid, CAST(s.q AS INTEGER) AS q, s.z, sqrt({sqdist('s.z', 'm.c')}) AS dist
  FROM cands s CROSS JOIN {model} m)
QUALIFY row_number() OVER (PARTITION BY meter_id, day ORDER BY dist, cid, q) = 1"""
    return cands() + [(name, sql)]


def update(assigned: str, name: str):
    avgs = ", ".join(f"avg(z[{i + 1}])" for i in range(DAY))
    return [(name, f"SELECT cid, count(*) AS n, [{avgs}] AS c FROM {assigned} GROUP BY cid")]


def fit(seed_name: str, prefix: str, iters: int = P.MAX_ITERS, delta: float = P.DELTA):
    """Fit until nothing moves: a recursive CTE whose one row a turn carries the model.
    Defines {prefix}_stop, {prefix}_model, {prefix}_asg."""
    avgs = ", ".join(f"avg(z[{i + 1}])" for i in range(DAY))
    run = f"""SELECT 0 AS it, list({{'cid': cid, 'n': n, 'c': c}} ORDER BY cid) AS m, list({{'cid': cid, 'n': n, 'c': c}} ORDER BY cid) AS prev,
  CAST(1 AS BIGINT) AS n_over FROM {seed_name}
UNION ALL
SELECT it + 1, list({{'cid': cid, 'n': n, 'c': c}} ORDER BY cid), any_value(m),
  count(*) FILTER (WHERE sqrt({sqdist('c', "list_filter(m, lambda e: e.cid = u.cid)[1].c")}) > {delta!r})
FROM (
  SELECT it, any_value(m) AS m, cid, count(*) AS n, [{avgs}] AS c FROM (
    SELECT it, m, e.cid AS cid, z, row_number() OVER (PARTITION BY meter_id, day ORDER BY sqrt({sqdist('z', 'e.c')}), e.cid, q) AS k
    FROM (SELECT it, m, unnest(m) AS e FROM {prefix}_run WHERE n_over > 0 AND it < {iters}) CROSS JOIN cands)
  WHERE k = 1 GROUP BY it, cid) u
GROUP BY it"""
    ctes = cands() + [
        (f"{prefix}_run", run),
        (f"{prefix}_last", f"SELECT * FROM {prefix}_run QUALIFY row_number() OVER (ORDER BY it DESC) = 1"),
        (f"{prefix}_stop", f"SELECT it - 1 AS it FROM {prefix}_last"),
        (f"{prefix}_model", f"SELECT unnest(m, recursive := true) FROM {prefix}_last"),
        (f"{prefix}_prev", f"SELECT unnest(prev, recursive := true) FROM {prefix}_last"),
    ]
    return ctes + assign(f"{prefix}_prev", f"{prefix}_asg")


def quality(prefix: str, k: int):
    mu = "[" + ", ".join(f"sum(n * c[{i + 1}]) / sum(n)" for i in range(DAY)) + "]"
    ctes = [
        (f"{prefix}_mu", f"SELECT {mu} AS mu FROM {prefix}_model"),
        (f"{prefix}_ssb", f"SELECT sum(n * {sqdist('c', 'mu')}) AS ssb FROM {prefix}_model CROSS JOIN {prefix}_mu"),
        (f"{prefix}_q", f"""SELECT {k} AS k, (SELECT count(*) FROM {prefix}_model) AS k_effective,
  count(*) AS n_points, sum({sqdist('a.z', 'mu')}) AS sst,
  (SELECT ssb FROM {prefix}_ssb) AS ssb, sum({sqdist('a.z', 'm.c')}) AS ssw,
  (SELECT it FROM {prefix}_stop) + 1 AS iterations
FROM {prefix}_asg a JOIN {prefix}_model m USING (cid) CROSS JOIN {prefix}_mu"""),
    ]
    return ctes


def quality_cols(src: str) -> str:
    return (f"CAST(k AS INTEGER) AS k, CAST(k_effective AS INTEGER) AS k_effective, n_points, {r('sst')} AS sst, "
            f"{r('ssb')} AS ssb, {r('ssw')} AS ssw, {r('ssb / sst')} AS coverage, "
            f"{r('CASE WHEN k > 1 AND ssw <> 0 THEN ssb * (n_points - k) / (ssw * (k - 1)) END')} AS ch FROM {src}")


def fitted():
    return seeds(P.K_FIT, "f_seed") + fit("f_seed", "f")


def entropy():
    sql = """SELECT meter_id, CAST(sum(n) AS BIGINT) AS n_days, count(*) AS n_clusters,
  -sum((n / t) * ln(n / t)) + 0.0 AS entropy FROM (
  SELECT meter_id, cid, n, sum(n) OVER (PARTITION BY meter_id) AS t FROM (
    SELECT meter_id, cid, count(*) AS n FROM f_asg GROUP BY 1, 2))
GROUP BY meter_id"""
    return fitted() + [("ent", sql)]


# --------------------------------------------------------------------------- queries

def long_form(src: str, keys: str, arr: str, value: str = "value") -> str:
    return (f"SELECT {keys}, CAST(unnest(range(len({arr}))) AS INTEGER) AS pos, "
            f"{r('unnest(' + arr + ')')} AS {value} FROM {src}")


def build() -> dict[str, str]:
    q = {}
    q["ingest_clean"] = _with(readings(), f"SELECT meter_id, day, CAST(hour AS INTEGER) AS hour, {r('reading')} AS reading FROM readings")
    q["complete_days"] = _with(cdays(), f"SELECT meter_id, day, {r(lsum('x'))} AS total, {r('list_max(x)')} AS peak FROM cdays")
    q["daily_points_24"] = _with(points(24), long_form("pts24", "meter_id, day", "x"))
    q["daily_points_26"] = _with(points(P.WINDOW), long_form(f"pts{P.WINDOW}", "meter_id, day", "x"))
    q["seed_centroids"] = _with(pool(), long_form("pool", "cid", "c"))
    q["shape_shifts"] = _with(cands(), long_form("cands", "meter_id, day, CAST(q AS INTEGER) AS q", "z"))

    z0 = normalize(crop_expr("p.x", P.WINDOW))
    dot = lsum("list_transform(z0, lambda v, i: v * c[i])")
    na, nb = lsum("list_transform(z0, lambda v: v * v)"), lsum("list_transform(c, lambda v: v * v)")
    q["shape_distance"] = _with(cands() + pool(), f"""SELECT meter_id, day, cid, {r('ksc_dist')} AS ksc_dist, best_q,
  {r('sqrt(' + sqdist('z0', 'c') + ')')} AS euclid0,
  {r(f'CASE WHEN sqrt({na}) * sqrt({nb}) <> 0 THEN {dot} / (sqrt({na}) * sqrt({nb})) END')} AS cosine0
FROM (
  SELECT s.meter_id, s.day, m.cid, m.c, sqrt({sqdist('s.z', 'm.c')}) AS ksc_dist, CAST(s.q AS INTEGER) AS best_q
  FROM cands s CROSS JOIN (SELECT * FROM pool WHERE cid <= {P.K_FIT}) m
  QUALIFY row_number() OVER (PARTITION BY s.meter_id, s.day, m.cid ORDER BY ksc_dist, s.q) = 1) d
JOIN (SELECT meter_id, day, {z0} AS z0 FROM pts{P.WINDOW} p) USING (meter_id, day)""")

    base = seeds(P.K_FIT, "a_seed") + assign("a_seed", "a_asg")
    q["ksc_assign"] = _with(base, f"SELECT meter_id, day, cid, q, {r('dist')} AS dist FROM a_asg")
    upd = base + update("a_asg", "a_new")
    q["ksc_update"] = _with(upd, f"""SELECT cid, n, {r('moved')} AS moved, moved > {P.DELTA!r} AS over,
  CAST(unnest(range(24)) AS INTEGER) AS pos, {r('unnest(c)')} AS value FROM (
  SELECT a.cid, a.n, a.c, sqrt({sqdist('a.c', 'b.c')}) AS moved FROM a_new a JOIN a_seed b USING (cid))""")

    fq = fitted() + quality("f", P.K_FIT)
    q["ksc_fit"] = _with(fq, f"""SELECT cid, n, {r('100.0 * n / sum(n) OVER ()')} AS share,
  CAST((SELECT it FROM f_stop) + 1 AS INTEGER) AS iterations,
  CAST(unnest(range(24)) AS INTEGER) AS pos, {r('unnest(c)')} AS value FROM f_model""")
    q["cluster_quality"] = _with(fq, "SELECT " + quality_cols("f_q"))
    q["centroid_share"] = _with(fq, f"SELECT cid, n, {r('100.0 * n / sum(n) OVER ()')} AS share FROM f_model")
    orig = normalize(crop_expr("x", P.WINDOW))
    tagged = fitted() + [("tag", f"SELECT a.meter_id, a.day, a.cid, {orig} AS original, a.z AS shifted "
                                 f"FROM f_asg a JOIN pts{P.WINDOW} p USING (meter_id, day)")]
    q["tagged_points"] = _with(tagged, f"""SELECT meter_id, day, cid, CAST(unnest(range(24)) AS INTEGER) AS pos,
  {r('unnest(original)')} AS original, {r('unnest(shifted)')} AS shifted FROM tag""")
    q["tagged_top10"] = _with(tagged + [("top", f"SELECT * FROM tag ORDER BY cid, meter_id, day LIMIT {P.TOP_TAGGED}")],
                              long_form("top", "meter_id, day, cid", "original", "original"))
    q["meter_entropy"] = _with(entropy(), f"SELECT meter_id, n_days, n_clusters, {r('entropy')} AS entropy FROM ent")
    q["entropy_histogram"] = _with(entropy() + [
        ("rng", "SELECT min(entropy) AS lo, max(entropy) AS hi, (max(entropy) - min(entropy)) / "
                f"{P.ENTROPY_BINS} AS w FROM ent"),
        ("binned", f"""SELECT CASE WHEN w > 0 THEN least(CAST(floor((entropy - lo) / w) AS INTEGER) + 1, {P.ENTROPY_BINS})
  ELSE 1 END AS bin FROM ent, rng"""),
    ], f"""SELECT CAST(b.bin AS INTEGER) AS bin, {r('lo + (b.bin - 1) * w')} AS lo, {r('lo + b.bin * w')} AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest(range(1, {P.ENTROPY_BINS + 1})) AS bin) b CROSS JOIN rng
LEFT JOIN (SELECT bin, count(*) AS n FROM binned GROUP BY bin) c ON c.bin = b.bin""")
    q["entropy_class"] = _with(entropy(), f"SELECT entropy <= {P.ENTROPY_THRESHOLD!r} AS predictable, count(*) AS meters "
                                          "FROM ent GROUP BY 1")

    sweep = []
    ks = list(range(P.SWEEP_START, P.SWEEP_END + 1))
    for k in ks:
        sweep += seeds(k, f"s{k}_seed") + fit(f"s{k}_seed", f"s{k}") + quality(f"s{k}", k)
    allq = " UNION ALL ".join(f"SELECT * FROM s{k}_q" for k in ks)
    sweep += [("sw", allq),
              ("sw_stop", f"SELECT coalesce(min(k) FILTER (WHERE ssb / sst >= {P.LEAST_COVERAGE!r}), {ks[-1]}) AS k FROM sw")]
    q["k_sweep"] = _with(sweep, f"SELECT CAST(k AS INTEGER) AS k, CAST(k_effective AS INTEGER) AS k_effective, "
                                f"CAST(iterations AS INTEGER) AS iterations, n_points, {r('sst')} AS sst, {r('ssb')} AS ssb, "
                                f"{r('ssw')} AS ssw, {r('ssb / sst')} AS coverage, "
                                f"{r('CASE WHEN k > 1 AND ssw <> 0 THEN ssb * (n_points - k) / (ssw * (k - 1)) END')} AS ch "
                                "FROM sw WHERE k <= (SELECT k FROM sw_stop)")
    return q


ORACLE = build()


# --------------------------------------------------------------------------- regression family

def weather():
    sql = """SELECT meter_id, day AS read_date, CAST(hour AS INTEGER) AS hour, reading,
  CAST((meter_id * 7 + dayofyear(day) * 13 + hour * 5) % 36 - 2 AS DOUBLE) AS temperature,
  greatest(temperature - 20.0, 0.0) AS x4, greatest(16.0 - temperature, 0.0) AS x5,
  greatest(5.0 - temperature, 0.0) AS x6
FROM hours"""
    return hours() + [("weather", sql)]


def lags():
    sql = """SELECT *, lag(reading, 1) OVER w AS lag1, lag(reading, 2) OVER w AS lag2, lag(reading, 3) OVER w AS lag3
FROM weather WINDOW w AS (PARTITION BY meter_id, hour ORDER BY read_date, reading, temperature)"""
    return weather() + [("lags", sql)]


def betas():
    """Least squares by modified Gram-Schmidt on each group's columns: another way than the
    moments and the LDL^T solve of the Spark side. A column is singular if next to nothing of it is
    left after the columns before it."""
    xs = ["lag1", "lag2", "lag3", "x4", "x5", "x6"]
    k, tol = len(xs), 1e-10
    lists = ", ".join(f"list({x} ORDER BY read_date, reading, temperature) AS v{i}" for i, x in enumerate(xs, 1))
    cols = (f"SELECT meter_id, hour, count(*) AS n_obs, list(reading ORDER BY read_date, reading, temperature) AS v0, {lists} "
            "FROM lags WHERE lag3 IS NOT NULL GROUP BY 1, 2")
    means = ", ".join(f"list_avg(v{i}) AS m{i}" for i in range(k + 1))
    cur = f"SELECT meter_id, hour, n_obs, {', '.join(f'v{i}' for i in range(k + 1))}, {means} FROM ({cols})"
    # centred; a constant column is exactly zero
    flat = ", ".join(f"CASE WHEN list_min(v{i}) = list_max(v{i}) THEN list_transform(v{i}, lambda e: 0.0::DOUBLE) "
                     f"ELSE list_transform(v{i}, lambda e: e - m{i}) END AS v{i}" for i in range(k + 1))
    cur = f"SELECT * REPLACE ({flat}) FROM ({cur})"
    cur = "SELECT *, " + ", ".join(f"list_dot_product(v{i}, v{i}) AS s{i}" for i in range(1, k + 1)) + f" FROM ({cur})"
    for i in range(1, k + 1):
        left = f"CASE WHEN list_dot_product(v{i}, v{i}) > {tol!r} * s{i} THEN list_dot_product(v{i}, v{i}) END"
        cur = f"SELECT *, {left} AS d{i} FROM ({cur})"
        later = [0, *range(i + 1, k + 1)]
        cur = "SELECT *, " + ", ".join(f"list_dot_product(v{i}, v{j}) / d{i} AS r{i}_{j}" for j in later) + f" FROM ({cur})"
        less = ", ".join(f"list_transform(list_zip(v{j}, v{i}), lambda e: e[1] - coalesce(r{i}_{j}, 0.0) * e[2]) AS v{j}" for j in later)
        cur = f"SELECT * REPLACE ({less}) FROM ({cur})"
    for i in reversed(range(1, k + 1)):
        cur = f"SELECT *, r{i}_0" + "".join(f" - r{i}_{j} * b{j}" for j in range(i + 1, k + 1)) + f" AS b{i} FROM ({cur})"
    ok = "coalesce(n_obs >= 7 AND " + " AND ".join(f"d{i} IS NOT NULL" for i in range(1, k + 1)) + ", false)"
    b0 = "m0" + "".join(f" - b{i} * m{i}" for i in range(1, k + 1))
    out = [f"CASE WHEN {ok} THEN {b0} ELSE 0.0 END AS b0"] + [f"CASE WHEN {ok} THEN b{i} ELSE 0.0 END AS b{i}" for i in range(1, k + 1)]
    sql = (f"SELECT meter_id, hour, coalesce(n_obs, 0) AS n_obs, {', '.join(out)}, NOT {ok} AS fallback "
           f"FROM (SELECT DISTINCT meter_id, hour FROM weather) LEFT JOIN ({cur}) USING (meter_id, hour)")
    return lags() + [("betas", sql)]


def profile():
    sql = """SELECT meter_id, hour, avg(act) AS mean, stddev_pop(act) AS sd FROM (
  SELECT l.meter_id, l.hour, l.reading - b.b4 * l.x4 - b.b5 * l.x5 - b.b6 * l.x6 AS act
  FROM lags l JOIN betas b USING (meter_id, hour)) GROUP BY 1, 2"""
    return betas() + [("profile", sql)]


def build_regression(q: dict) -> dict:
    q["temperature_features"] = _with(weather(), f"SELECT meter_id, read_date, hour, {r('temperature')} AS temperature, "
                                                 f"{r('x4')} AS cooling, {r('x5')} AS heating, {r('x6')} AS cold FROM weather")
    q["regression_lags"] = _with(lags(), f"SELECT meter_id, read_date, hour, {r('reading')} AS reading, {r('lag1')} AS lag1, "
                                         f"{r('lag2')} AS lag2, {r('lag3')} AS lag3 FROM lags")
    q["regression_betas"] = _with(betas(), "SELECT meter_id, CAST(hour AS INTEGER) AS hour, n_obs, "
                                           + ", ".join(f"{r(f'b{i}')} AS b{i}" for i in range(7)) + ", fallback FROM betas")
    q["activity_profile"] = _with(profile(), f"SELECT meter_id, CAST(hour AS INTEGER) AS hour, {r('mean')} AS mean, "
                                             f"{r('sd')} AS sd FROM profile")
    return q


ORACLE = build_regression(build())


# --------------------------------------------------------------------------- generator family

def _u(d: str, slot: int) -> str:
    return f"((('0x' || substr({d}, {8 * slot + 1}, 8))::UBIGINT + 0.5) / 4294967296.0)"


def _g(d: str, slot: int) -> str:
    return f"(sqrt(-2.0 * ln({_u(d, slot)})) * cos(2.0 * pi() * {_u(d, slot + 1)}))"


def _dbl(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def synthetic():
    # Fixed values, stated again so that a wrong constant in the generator shows: the slopes
    # (as 32-bit floats) and the number of buckets of the profile numbering.
    s0, s1, s2 = (f"CAST(CAST({v} AS FLOAT) AS DOUBLE)" for v in ("-0.0059", "0.0155", "0.2233"))
    nb = 1021
    seed = P.SYNTH_SEED
    hours_n = 24 * P.SYNTH_DAYS
    mean_slots = ", ".join(f"coalesce(max(CASE WHEN hour = {h} THEN mean END), 0.0)" for h in range(DAY))
    ctes = profile() + [
        ("prof", f"SELECT meter_id, [{mean_slots}] AS mean FROM profile GROUP BY meter_id"),
        ("prof_b", f"SELECT *, CAST(('0x' || substr(md5(CAST(meter_id AS VARCHAR)), 1, 8))::UBIGINT % {nb} AS BIGINT) AS b "
                   "FROM prof"),
        ("prof_off", "SELECT b, coalesce(sum(cnt) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off "
                     "FROM (SELECT b, count(*) AS cnt FROM prof_b GROUP BY b)"),
        ("numbered", "SELECT meter_id, mean, off + row_number() OVER (PARTITION BY b ORDER BY meter_id) - 1 AS idx "
                     "FROM prof_b JOIN prof_off USING (b)"),
        ("tseed", "SELECT row_number() OVER (ORDER BY read_date, hour) - 1 AS pos, avg(temperature) AS t "
                  "FROM weather GROUP BY read_date, hour"),
        ("series", f"""SELECT series_id, md5(concat_ws('|', '{seed}', 'series', CAST(series_id AS VARCHAR))) AS d1,
  md5(concat_ws('|', '{seed}', 'thermal', CAST(series_id AS VARCHAR))) AS d2
FROM (SELECT range AS series_id FROM range(0, (SELECT count(*) FROM prof)))"""),
        ("sparams", f"""SELECT series_id, CAST(floor({_u('d1', 0)} * (SELECT count(*) FROM prof)) AS BIGINT) AS idx,
  abs({_g('d1', 1)}) / 1.5 AS y0, CAST(10 + floor({_u('d1', 3)} * 6) AS DOUBLE) AS x1,
  CAST(10 + floor({_u('d1', 3)} * 6) + 4 + floor({_u('d2', 0)} * 9) AS DOUBLE) AS x2 FROM series"""),
        ("srows", f"""SELECT s.series_id, n.meter_id AS seed_meter_id, n.mean, s.y0, s.x1, s.x2, unnest(range({hours_n})) AS i
FROM sparams s JOIN numbered n USING (idx)"""),
        ("strows", f"""SELECT r.*, CAST(i // 24 AS INTEGER) AS day_index,
  t.t + 2.0 * {_g("md5(concat_ws('|', '" + str(seed) + "', 'hour', CAST(r.series_id AS VARCHAR), CAST(r.i AS VARCHAR)))", 0)} AS temperature,
  greatest(r.mean[(r.i % 24) + 1] + 0.1 * {_g("md5(concat_ws('|', '" + str(seed) + "', 'hour', CAST(r.series_id AS VARCHAR), CAST(r.i AS VARCHAR)))", 2)}, 0.0) AS activity
FROM srows r JOIN tseed t ON t.pos = r.i % (SELECT count(*) FROM tseed)"""),
        ("sx0", "SELECT *, min(temperature) OVER (PARTITION BY series_id) AS x0 FROM strows"),
        ("sth", f"""SELECT *, least(greatest(CASE
    WHEN temperature < x1 THEN {s0} * (temperature - x0) + y0
    WHEN temperature < x2 THEN {s1} * (temperature - x1) + ({s0} * (x1 - x0) + y0)
    ELSE {s2} * (temperature - x2) + {s1} * (x2 - x1) + ({s0} * (x1 - x0) + y0) END, 0.0), 0.2) AS thermal FROM sx0"""),
        ("sload", """SELECT *, activity + thermal AS l0, avg(activity + thermal) OVER (PARTITION BY series_id, day_index) AS dm
FROM sth"""),
        ("synth", f"""SELECT series_id, seed_meter_id, i, day_index, activity, thermal, x0, y0, x1, x2, temperature,
  TIMESTAMP '{P.SYNTH_START} 00:00:00' + to_hours(CAST(i AS BIGINT)) AS read_ts,
  CASE WHEN l0 - dm > 0 THEN dm + (l0 - dm) * {P.PEAKY_RATIO!r} ELSE l0 END AS load FROM sload"""),
    ]
    return ctes


def build_synth(q: dict) -> dict:
    q["synth_series"] = _with(synthetic(), f"SELECT series_id, seed_meter_id, read_ts, {r('load')} AS load, "
                                           f"{r('temperature')} AS temperature FROM synth")
    q["synth_thermal"] = _with(synthetic(), f"""SELECT series_id, {r('first(x0)')} AS x0, {r('first(y0)')} AS y0,
  {r('first(x1)')} AS x1, {r('first(x2)')} AS x2, {r('min(thermal)')} AS thermal_min, {r('max(thermal)')} AS thermal_max,
  {r('min(activity)')} AS activity_min FROM synth GROUP BY series_id""")
    q["synth_daily"] = _with(synthetic(), f"""SELECT series_id, day_index, {r('avg(load)')} AS mean_load,
  {r('stddev_pop(load)')} AS sd_load, {r('min(load)')} AS min_load, {r('max(load)')} AS max_load
FROM synth GROUP BY series_id, day_index""")
    return q


ORACLE = build_synth(build_regression(build()))


def build_io(q: dict) -> dict:
    mean_slots = ", ".join(f"coalesce(max(CASE WHEN hour = {h} THEN {{c}} END), 0.0)" for h in range(DAY))
    ctes = pool() + profile() + [
        ("profarr", f"SELECT meter_id, [{mean_slots.format(c='mean')}] AS mean, [{mean_slots.format(c='sd')}] AS sd "
                    "FROM profile GROUP BY meter_id"),
    ]
    q["export_roundtrip"] = _with(ctes, f"""SELECT 'points' AS "table", count(*) AS rows, round(sum({lsum('x')}), 3) AS checksum FROM pts{P.WINDOW}
UNION ALL SELECT 'centroids', count(*), round(sum({lsum('c')}), 3) FROM pool
UNION ALL SELECT 'profiles', count(*), round(sum({lsum('mean')} + {lsum('sd')}), 3) FROM profarr
UNION ALL SELECT 'weather', count(*), round(sum(reading + temperature), 3) FROM weather""")
    q["meter_slice"] = f"""WITH top AS (SELECT arg_max(user_id, (s, user_id)) AS m FROM
  (SELECT user_id, sum(value) AS s FROM events GROUP BY user_id))
SELECT user_id AS meter_id, date_trunc('hour', ts) AS read_ts, {r('sum(value)')} AS reading, count(*) AS events
FROM events WHERE user_id = (SELECT m FROM top)
  AND ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-07 23:59:59'
GROUP BY 1, 2"""
    return q


ORACLE = build_io(ORACLE)


def build_more(q: dict) -> dict:
    orig = normalize(crop_expr("x", P.WINDOW))
    q["cluster_members"] = _with(fitted() + [
        ("top", "SELECT cid FROM f_model ORDER BY n DESC, cid LIMIT 1"),
    ], f"""SELECT a.meter_id, a.day, a.cid, {r('list_max(' + orig + ')')} AS peak_share
FROM f_asg a JOIN pts{P.WINDOW} p USING (meter_id, day) WHERE a.cid = (SELECT cid FROM top)""")
    q["activity_load"] = _with(betas(), f"""SELECT l.meter_id, l.read_date, l.hour, {r('l.reading')} AS reading,
  {r('l.reading - b.b4 * l.x4 - b.b5 * l.x5 - b.b6 * l.x6')} AS activity, b.fallback
FROM lags l JOIN betas b USING (meter_id, hour)""")
    return q


ORACLE = build_more(ORACLE)


def build_files(q: dict) -> dict:
    """Files and jobs must give back what they were given."""
    q["raw_file_ingest"] = q["ingest_clean"]
    q["point_files"] = q["daily_points_26"]
    q["job_train_profiles"] = q["activity_profile"]
    q["job_prepare_points"] = _with(points(P.WINDOW, "cdays"), long_form(f"cdays{P.WINDOW}", "meter_id, day", "x"))
    q["result_files"] = _with(entropy(), f"""SELECT 'share' AS kind, CAST(cid AS BIGINT) AS id, {r('100.0 * n / sum(n) OVER ()')} AS value FROM f_model
UNION ALL SELECT 'entropy', meter_id, {r('entropy')} FROM ent""")
    orig = normalize(crop_expr("x", P.WINDOW))
    q["tagged_files"] = _with(fitted(), f"""SELECT a.cid, {r('list_max(' + orig + ')')} AS peak, {r('list_max(a.z)')} AS peak_shifted
FROM f_asg a JOIN pts{P.WINDOW} p USING (meter_id, day)""")
    bad = "((meter_id + dayofyear(day)) % 7 = 0 OR (meter_id + dayofyear(day)) % 11 = 0)"
    q["point_screen"] = _with(points(), f"""SELECT meter_id, count(*) FILTER (WHERE NOT {bad}) AS kept,
  CAST((SELECT count(*) FROM pts{P.WINDOW} WHERE {bad}) AS BIGINT) AS rejected FROM pts{P.WINDOW}
GROUP BY meter_id HAVING count(*) FILTER (WHERE NOT {bad}) > 0""")
    q["tagged_repeated"] = _with(points() + [("one", f"SELECT meter_id, day, least(x, list_reverse(x)) AS x FROM pts{P.WINDOW}")],
                                 long_form("one", "meter_id, day", "x"))
    q["temperature_seed_file"] = _with(weather(), f"""SELECT row_number() OVER (ORDER BY read_date, hour) - 1 AS pos,
  {r('avg(temperature)')} AS temperature FROM weather GROUP BY read_date, hour""")
    return q


ORACLE = build_files(ORACLE)


def build_order(q: dict) -> dict:
    """The order of rows and lines is compared as numbers."""
    place = "row_number() OVER (ORDER BY {}) - 1 AS pos"
    orig = normalize(crop_expr("x", P.WINDOW))
    q["point_positions"] = _with(points(), f"SELECT {place.format('meter_id, day')}, meter_id, day FROM pts{P.WINDOW}")
    q["point_file_order"] = _with(points(), f"SELECT {place.format('meter_id, day')}, meter_id, day, {r('list_max(x)')} AS peak FROM pts{P.WINDOW}")
    joined = f"f_asg a JOIN pts{P.WINDOW} p USING (meter_id, day)"
    q["tagged_file_order"] = _with(fitted(), f"""SELECT {place.format('a.cid, a.meter_id, a.day')}, a.cid,
  {r('list_max(' + orig + ')')} AS peak, {r('list_max(a.z)')} AS peak_shifted FROM {joined}""")
    q["tagged_file_top10"] = _with(fitted() + [
        ("tag", f"SELECT row_number() OVER (ORDER BY a.cid, a.meter_id, a.day) - 1 AS line, a.cid, {orig} AS original FROM {joined}"),
        ("top", f"SELECT * FROM tag WHERE line < {P.TOP_TAGGED}"),
    ], long_form("top", "line, cid", "original", "original"))
    q["share_file_order"] = _with(fitted(), f"SELECT {place.format('cid')}, CAST(cid AS INTEGER) AS cid, {r('100.0 * n / sum(n) OVER ()')} AS share FROM f_model")
    q["temperature_first_line"] = _with(weather(), f"""SELECT CAST(hour AS BIGINT) AS pos, {r('avg(temperature)')} AS temperature,
  (SELECT count(DISTINCT read_date) FROM weather) AS lines
FROM weather WHERE read_date = (SELECT min(read_date) FROM weather) GROUP BY hour""")
    return q


ORACLE = build_order(ORACLE)


def build_jobs(q: dict) -> dict:
    """Everything that the clustering and the generation job write."""
    orig = normalize(crop_expr("x", P.WINDOW))
    less = P.K_FIT - 1
    ctes = entropy() + quality("f", P.K_FIT) + seeds(less, "e_seed") + fit("e_seed", "e") + quality("e", less) + [
        ("elbow", "SELECT * FROM e_q UNION ALL SELECT * FROM f_q")]
    q["job_ksc_clustering"] = _with(ctes, f"""SELECT 'share' AS kind, CAST(cid AS BIGINT) AS id, -1 AS pos, {r('100.0 * n / sum(n) OVER ()')} AS value FROM f_model
UNION ALL SELECT 'centroid', cid, unnest(range({DAY})), {r('unnest(c)')} FROM f_model
UNION ALL SELECT 'entropy', meter_id, -1, {r('entropy')} FROM ent
UNION ALL SELECT 'original', a.cid, -1, {r('list_max(' + orig + ')')} FROM f_asg a JOIN pts{P.WINDOW} p USING (meter_id, day)
UNION ALL SELECT 'shifted', cid, -1, {r('list_max(z)')} FROM f_asg
UNION ALL SELECT 'coverage', k, -1, {r('ssb / sst')} FROM elbow
UNION ALL SELECT 'ch', k, -1, {r('ssb * (n_points - k) / (ssw * (k - 1))')} FROM elbow""")
    q["job_generate"] = _with(synthetic(), f"""SELECT series_id, strftime(read_ts, '%Y-%m-%d ') || hour(read_ts) || ':00:00' AS read_ts,
  {r('load')} AS load, {r('temperature')} AS temperature FROM synth""")
    q["job_prepare_seeds"] = _with(pool(P.WINDOW, "cdays"), long_form("pool", "cid", "c"))
    q["shape_shifts_wrap"] = _with(cands(q_max=P.WRAP_SHIFT), long_form("cands", "meter_id, day, CAST(q AS INTEGER) AS q", "z"))
    return q


ORACLE = build_jobs(ORACLE)


def build_scaled(q: dict) -> dict:
    """Free scale, division by the norm; the leading eigenvector by power iteration."""
    w, start = P.WINDOW, (P.WINDOW - DAY) // 2
    idx = f"(((i + {start} + q) % {w} + {w}) % {w}) + 1"
    dot, zz = lsum("list_transform(z, lambda v, i: v * c[i])"), lsum("list_transform(z, lambda v: v * v)")
    cc = lsum("list_transform(c, lambda v: v * v)")
    ctes = seeds(P.K_FIT, "a_seed") + [
        ("raw", f"""SELECT meter_id, day, CAST(q AS INTEGER) AS q, list_transform(range({DAY}), lambda i: x[{idx}]) AS z
FROM pts{w}, (SELECT unnest(range({-P.MAX_SHIFT}, {P.MAX_SHIFT + 1})) AS q) qs"""),
        ("dots", f"SELECT meter_id, day, q, cid, z, {dot} AS xc, {zz} AS xx, {cc} AS cc FROM raw CROSS JOIN a_seed"),
        ("near", """SELECT *, CASE WHEN xx * cc > 0 THEN sqrt(greatest(1 - xc * xc / (xx * cc), 0.0)) ELSE 1.0 END AS dist FROM dots
QUALIFY row_number() OVER (PARTITION BY meter_id, day ORDER BY dist, cid, q) = 1"""),
        ("cells", f"""SELECT cid, count(*) AS n, i, j, sum(z[i] * z[j] / xx) AS s
FROM near, (SELECT unnest(range(1, {DAY + 1})) AS i), (SELECT unnest(range(1, {DAY + 1})) AS j) GROUP BY cid, i, j"""),
        ("mat", "SELECT cid, any_value(n) AS n, list(r ORDER BY i) AS m FROM (SELECT cid, i, any_value(n) AS n, list(s ORDER BY j) AS r FROM cells GROUP BY cid, i) GROUP BY cid"),
        ("pw", f"""SELECT cid, 0 AS it, list_transform(range({DAY}), lambda i: 1.0::DOUBLE) AS u FROM mat
UNION ALL
SELECT cid, it + 1, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) FROM (
  SELECT pw.cid, it, list_transform(m, lambda r: list_dot_product(r, u)) AS v FROM pw JOIN mat USING (cid) WHERE it < 300)"""),
        ("lead", "SELECT cid, n, u FROM pw JOIN mat USING (cid) WHERE it = 300"),
    ]
    q["scaled_assign"] = _with(ctes, f"SELECT meter_id, day, cid, q, {r('dist')} AS dist, {r('xc / cc')} AS alpha FROM near")
    q["scaled_update"] = _with(ctes, long_form("lead", "cid, n", "u"))
    return q


ORACLE = build_scaled(ORACLE)


def build_resumed(q: dict) -> dict:
    """A fit taken up after two turns ends like one that ran through."""
    q["ksc_resumed"] = _with(fitted(), f"""SELECT cid, n, CAST((SELECT it FROM f_stop) + 1 AS INTEGER) AS iterations,
  CAST(greatest((SELECT it FROM f_stop) - 1, 0) AS INTEGER) AS passes, CAST(unnest(range({DAY})) AS INTEGER) AS pos, {r('unnest(c)')} AS value FROM f_model""")
    return q


ORACLE = build_resumed(ORACLE)


def build_tables(q: dict) -> dict:
    """Tables by date and by meter change plans, not results."""
    q["date_slice"] = _with(fdays(), f"""SELECT meter_id, day, {r(lsum('x'))} AS total, {r('list_max(x)')} AS peak FROM fdays
WHERE day BETWEEN DATE '{P.SLICE_FIRST}' AND DATE '{P.SLICE_LAST}'""")
    q["bucketed_points"], q["bucketed_entropy"] = q["daily_points_26"], q["meter_entropy"]
    q["bucketed_profiles"] = q["job_train_profiles"]
    return q


ORACLE = build_tables(ORACLE)


def build_pool(q: dict) -> dict:
    """All seeds of the pool are scored for every point."""
    q["ksc_assign_pool"] = _with(pool() + assign("pool", "p_asg"), f"SELECT meter_id, day, cid, q, {r('dist')} AS dist FROM p_asg")
    return q


ORACLE = build_pool(ORACLE)


def build_source(q: dict) -> dict:
    """The data source gives the lines back; rejected ones with the first field that is wrong."""
    reasons = r"""SELECT line, CASE WHEN len(f) < 3 THEN 'fields' WHEN try_cast(f[1] AS BIGINT) IS NULL THEN 'meter_id'
  WHEN try_strptime(string_split(f[2], ' ')[1], '%Y-%m-%d') IS NULL
    OR coalesce(try_cast(string_split(string_split(f[2], ' ')[2], ':')[1] AS INTEGER), 24) NOT BETWEEN 0 AND 23 THEN 'day'
  WHEN NOT regexp_full_match(f[3], '-?\d+(.\d+)?') OR try_cast(f[3] AS DOUBLE) IS NULL THEN 'reading' END AS reason
FROM (SELECT line, string_split(line, chr(9)) AS f FROM lines)"""
    screened = lines() + [("screened", reasons)]
    q["source_readings"] = q["ingest_clean"]
    q["source_rejected"] = _with(screened, "SELECT line, reason FROM screened WHERE reason IS NOT NULL")
    q["source_balance"] = _with(screened, """SELECT string_split(line, chr(9))[1] AS meter, count(*) AS n_lines,
  count(*) FILTER (WHERE reason IS NULL) AS n_kept, count(reason) AS n_rejected FROM screened GROUP BY 1""")
    q["source_points"] = _with(points() + [("cut", f"""SELECT * FROM pts{P.WINDOW}
WHERE day BETWEEN DATE '{P.SLICE_FIRST}' AND DATE '{P.SLICE_LAST}'""")], long_form("cut", "meter_id, day", "x"))
    q["source_results"] = q["result_files"]
    return q


ORACLE = build_source(ORACLE)
