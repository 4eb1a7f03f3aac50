"""The assignment kernel skips distances by a bound and must answer as if it measured all."""

import numpy as np
import pytest

from wattle.functions import kernels


def measured(X, cids, C, max_shift, length):
    """Every distance, hour by hour; the least (dist, cid, q)."""
    Zs = kernels.shifted_shapes(X, max_shift, length)
    out = []
    for r in range(len(X)):
        best = None
        for k, c in enumerate(C):
            for s in range(len(Zs)):
                d2 = np.float64(0.0)
                for i in range(length):
                    d2 = d2 + (Zs[s, r, i] - c[i]) * (Zs[s, r, i] - c[i])
                if best is None or np.sqrt(d2) < best[0]:
                    best = (np.sqrt(d2), int(cids[k]), s - max_shift)
        out.append(best)
    return out


def same(X, C, max_shift=1, length=24):
    cids = np.arange(1, len(C) + 1) * 3
    cid, q, dist, z, exact = kernels.nearest(X, cids, C, max_shift, length)
    assert list(zip(dist.tolist(), cid.tolist(), q.tolist())) == measured(X, cids, C, max_shift, length)
    Zs = kernels.shifted_shapes(X, max_shift, length)
    assert all((z[r] == Zs[q[r] + max_shift, r]).all() for r in range(len(X)))
    return exact


@pytest.mark.parametrize("k", [1, 5, 130])
def test_answers_are_those_of_measuring_all(k):
    rnd = np.random.default_rng(k)
    X = rnd.gamma(1.0, 1.0, (60, 26))
    C = kernels.shifted_shapes(rnd.gamma(1.0, 1.0, (k, 26)), 0, 24)[0]
    assert 60 <= same(X, C) <= 60 * 3 * -(-k // kernels.CENTROID_BLOCK)


def test_ties_and_equal_points():
    rnd = np.random.default_rng(7)
    X = rnd.integers(0, 3, (40, 26)).astype(float)
    C = kernels.shifted_shapes(X[:20], 0, 24)[0]
    same(X, np.concatenate([C, C[::-1], C + 1e-16]))        # repeated centroids, and almost
    same(np.ones((5, 26)), np.full((4, 24), 1 / 24))        # every shift and centroid equal
    same(np.zeros((3, 26)), C[:4])


def test_very_large_small_and_offset_values():
    rnd = np.random.default_rng(8)
    X = rnd.gamma(1.0, 1.0, (12, 26))
    C = kernels.shifted_shapes(rnd.gamma(1.0, 1.0, (6, 26)), 0, 24)[0]
    with np.errstate(all="ignore"):
        same(X, C * 1e200)                                  # squares overflow: nothing is skipped
        same(X, C * 1e-200)
        same(X, C + 1e9)                                    # the product loses all digits
        X[:, 3] = -X[:, :3].sum(axis=1) - X[:, 4:].sum(axis=1) + 1e-12   # totals of almost zero: huge shapes
        same(X, C)


def test_empty_batch():
    assert kernels.nearest(np.zeros((0, 26)), np.array([1]), np.zeros((1, 24)), 1, 24)[4] == 0
