"""Small dense solves written as column expressions (one system per row).

Used for per-group least squares: the groups' moment matrices come from one
``groupBy().agg(covar_pop…)`` and are solved here row-wise, inside whole-stage codegen,
with no Python worker and no per-group collection of rows. The expressions are emitted as
SQL text, one projection per elimination level, so building the plan costs a handful of
driver calls instead of thousands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def solve_ldl(df: DataFrame, s: dict, t: list[str], out: list[str], tol: float = 1e-10,
              ok_col: str = "_solved") -> DataFrame:
    """Solve ``S b = t`` for a symmetric positive (semi-)definite ``S`` per row.

    ``s[(i, j)]`` (i <= j) and ``t[i]`` name columns. LDL^T without pivoting; a pivot
    ``d_i <= tol * S_ii`` (a zero, constant or collinear regressor) makes the row
    unsolvable: its ``out`` columns are null and ``ok_col`` is false. Level i computes the
    pivot d_i, the multipliers L_ji (j > i) and the forward substitution w_i.
    """
    k = len(t)

    def S(i, j):
        return f"`{s[(min(i, j), max(i, j))]}`"

    for i in range(k):
        acc = S(i, i) + "".join(f" - _l{i}_{m} * _l{i}_{m} * _d{m}" for m in range(i))
        exprs = [f"CASE WHEN ({acc}) > {tol!r} * {S(i, i)} THEN ({acc}) END AS _d{i}"]
        df = df.selectExpr("*", *exprs)
        exprs = []
        for j in range(i + 1, k):
            num = S(j, i) + "".join(f" - _l{j}_{m} * _l{i}_{m} * _d{m}" for m in range(i))
            exprs.append(f"({num}) / _d{i} AS _l{j}_{i}")
        exprs.append(f"`{t[i]}`" + "".join(f" - _l{i}_{m} * _w{m}" for m in range(i)) + f" AS _w{i}")
        df = df.selectExpr("*", *exprs)
    for i in reversed(range(k)):  # back: D L^T b = w
        acc = f"_w{i} / _d{i}" + "".join(f" - _l{m}_{i} * `{out[m]}`" for m in range(i + 1, k))
        df = df.selectExpr("*", f"{acc} AS `{out[i]}`")
    ok = " AND ".join(f"_d{i} IS NOT NULL" for i in range(k))
    tmp = [f"_d{i}" for i in range(k)] + [f"_w{i}" for i in range(k)] + \
          [f"_l{j}_{i}" for i in range(k) for j in range(i + 1, k)]
    return df.selectExpr("*", f"({ok}) AS `{ok_col}`").drop(*tmp)
