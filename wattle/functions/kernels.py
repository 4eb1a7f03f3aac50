"""Vectorised K-SC assignment kernel for Arrow batches.

The same arithmetic as ``shapes.ksc_distance`` + the (dist, cid, q) argmin in
``operators.ksc.assign``, evaluated on a whole Arrow batch with numpy: every sum runs
left to right over the hours (as Spark's ``aggregate`` does), so the results are
bit-identical to the SQL expression path. Spark still partitions, schedules and retries
the work; only the per-row arithmetic runs here.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's code with the UDF so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT_TYPE = T.StructType([
    T.StructField("cid", T.IntegerType()),
    T.StructField("q", T.IntegerType()),
    T.StructField("dist", T.DoubleType()),
    T.StructField("z", T.ArrayType(T.DoubleType())),
])
CHUNK_ROWS = 2048
CENTROID_BLOCK = 128
SLACK = 1e-13   # of |z|^2 + |c|^2; the product's rounding is below 1e-14 of it for 24 hours
_ARROW_TYPE = pa.struct([("cid", pa.int32()), ("q", pa.int32()), ("dist", pa.float64()),
                         ("z", pa.list_(pa.float64()))])


def shifted_shapes(X: np.ndarray, max_shift: int, length: int) -> np.ndarray:
    """(S, n, width) normalised centre crops of every rotation q = -max_shift..max_shift."""
    n, w = X.shape
    start = (w - length) // 2 if w > length else 0
    width = min(w, length)
    out = np.empty((2 * max_shift + 1, n, width))
    for s, q in enumerate(range(-max_shift, max_shift + 1)):
        q_eff = 0 if abs(q) >= w else q
        Z = X[:, (np.arange(width) + start + q_eff) % w]
        tot = np.zeros(n)
        for i in range(width):          # left-to-right, like aggregate(…, 0D, +)
            tot = tot + Z[:, i]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[s] = np.where((tot == 0.0)[:, None], Z, Z / tot[:, None])
    return out


def nearest(X: np.ndarray, cids: np.ndarray, C: np.ndarray, max_shift: int, length: int):
    """Per row: (cid, q, dist, z) minimising (dist, cid, q), and the number of exact distances.

    A matrix product gives every squared distance as |z|^2 + |c|^2 - 2 zc, off by no more than
    ``SLACK`` (|z|^2 + |c|^2). What lies further than that above the least one cannot win and is
    skipped; the rest, mostly one (centroid, shift) a row, is measured hour by hour, so the
    answer is that of measuring all. Not-a-number and overflow skip nothing.

    Centroids are scored in blocks with a running minimum, so memory does not grow with
    their number; a later block wins only by a smaller distance (ties: the lower cid).
    """
    Zs = shifted_shapes(X, max_shift, length)          # (S, n, L)
    S, n, width = Zs.shape
    flat = Zs.transpose(1, 0, 2).reshape(n * S, width)
    dist, k_best, s_best = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    exact = 0
    for k0 in range(0, C.shape[0], CENTROID_BLOCK):
        B = C[k0:k0 + CENTROID_BLOCK, :width]
        with np.errstate(all="ignore"):
            zz, cc = np.einsum("ij,ij->i", flat, flat), np.einsum("ij,ij->i", B, B)
            about = (zz[:, None] + cc - 2.0 * (flat @ B.T)).reshape(n, S, len(B)).transpose(0, 2, 1)
            slack = 2.0 * SLACK * (zz.reshape(n, S).max(axis=1) + cc.max())
            bound = np.fmin(np.fmin.reduce(about, axis=(1, 2)), dist * dist) + slack
            row, k, s = np.nonzero(~(about > bound[:, None, None]))      # by row, cid, q
        if not len(row):
            continue
        exact += len(row)
        D2 = np.zeros(len(row))
        for i in range(width):          # left-to-right, like aggregate(…, 0D, +)
            diff = Zs[s, row, i] - B[k, i]
            D2 = D2 + diff * diff
        d = np.sqrt(D2)
        have, first = np.unique(row, return_index=True)
        least = np.minimum.reduceat(d, first)
        hit = np.nonzero(d == np.repeat(least, np.diff(np.append(first, len(row)))))[0]
        hit = hit[np.unique(row[hit], return_index=True)[1]]             # the first of equals
        closer = hit[d[hit] < dist[row[hit]]]
        r = row[closer]
        dist[r], k_best[r], s_best[r] = d[closer], k0 + k[closer], s[closer]
    return (cids[k_best].astype(np.int32), (s_best - max_shift).astype(np.int32), dist, Zs[s_best, np.arange(n), :], exact)


def _to_matrix(arr: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = arr.value_lengths().to_numpy(zero_copy_only=False)
    values = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return lengths, values


def assign_udf(model: dict, max_shift: int, length: int):
    """Scalar Arrow UDF ``x -> STRUCT<cid, q, dist, z>`` for a fixed model (shipped with the
    function, like a broadcast variable: at most a few hundred centroids)."""
    items = sorted(model.items())
    cids = np.array([c for c, _ in items], dtype=np.int64)
    C = np.array([v for _, (_, v) in items], dtype=np.float64)

    @F.arrow_udf(RESULT_TYPE)
    def nearest_centroid(x: pa.Array) -> pa.Array:
        n = len(x)
        lengths, values = _to_matrix(x)
        if n and lengths.min() < length:
            raise ValueError(f"a point has {int(lengths.min())} hours, the centroids have {length}")
        if not np.isfinite(values).all():
            raise ValueError("a point has a value that is missing or not finite; see prepare.is_finite")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        zw = np.minimum(lengths, length)
        same = n == 0 or bool((zw == zw[0]).all())
        cid = np.zeros(n, np.int32)
        q = np.zeros(n, np.int32)
        dist = np.zeros(n)
        Z = np.zeros((n, int(zw[0]) if n else length)) if same else [None] * n
        for w in np.unique(lengths):
            sel = np.nonzero(lengths == w)[0]
            if len(sel) == n:
                X = values.reshape(n, int(w))
            else:  # mixed window sizes in one batch (not produced by daily_points)
                X = np.stack([values[offsets[r]:offsets[r] + w] for r in sel])
            for lo in range(0, len(sel), CHUNK_ROWS):   # bounds the (rows, K, S) tensors
                part = sel[lo:lo + CHUNK_ROWS]
                c_, q_, d_, z_, _ = nearest(X[lo:lo + CHUNK_ROWS], cids, C, max_shift, length)
                cid[part], q[part], dist[part] = c_, q_, d_
                if same:
                    Z[part] = z_
                else:
                    for j, r in enumerate(part):
                        Z[r] = z_[j]
        if same:
            width = Z.shape[1]
            z_arr = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)),
                                             pa.array(Z.ravel()))
        else:
            z_arr = pa.array([list(v) for v in Z], type=pa.list_(pa.float64()))
        return pa.StructArray.from_arrays(
            [pa.array(cid), pa.array(q), pa.array(dist), z_arr], fields=list(_ARROW_TYPE))

    return nearest_centroid
