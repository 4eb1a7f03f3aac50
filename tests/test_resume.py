"""Fits and the clustering job stopped after a turn, or while writing, go on where they were."""

import os

import pytest

from wattle.operators import ksc, loopstate
from wattle.operators.loopstate import LoopState
from wattle.plans import catalog as C
from wattle.plans import jobs
from wattle.sources import text as tx

from conftest import SF001


class Stop(Exception):
    pass


def stop_after(monkeypatch, saves):
    """The state's ``saves``-th turn is stored, then the job dies."""
    save, left = LoopState.save, [saves]

    def dying(self, *args):
        save(self, *args)
        left[0] -= 1
        if left[0] == 0:
            raise Stop
    monkeypatch.setattr(LoopState, "save", dying)


def files(spark, out):
    return {name: sorted(r[0] for r in spark.read.text(os.path.join(out, name)).collect()) for name in ("centroid", "taggedpoints", "entropy", "elbow")}


def test_job_goes_on_after_a_stop(spark, scratch, monkeypatch):
    pts = C.points(spark, SF001).cache()
    tx.write_points(pts, f"{scratch}/points")
    tx.write_centroids(C.pool(pts), f"{scratch}/seeds")
    args = dict(max_iter=6, k_start=2, k_end=5, least_coverage=0.99, together=2)
    whole = jobs.ksc_clustering(spark, f"{scratch}/points", f"{scratch}/seeds", f"{scratch}/whole", **args)

    run = lambda **more: jobs.ksc_clustering(
        spark, f"{scratch}/points", f"{scratch}/seeds", f"{scratch}/out", state_dir=f"{scratch}/state", **{**args, **more})
    passes, update_many = [], ksc.update_many
    monkeypatch.setattr(ksc, "update_many", lambda p, m, *a: passes.append(sorted(m)) or update_many(p, m, *a))
    with monkeypatch.context() as m:
        stop_after(m, 8)      # in the second pair of Ks, or in a turn of the first
        with pytest.raises(Stop):
            run()
    before = len(passes)
    assert before == 8
    with monkeypatch.context() as m:   # dies again, this time between two outputs
        def broken(df, path, mode):
            df.limit(1).selectExpr("'half' AS value").write.text(path)
            os.remove(os.path.join(path, "_SUCCESS"))
            raise Stop
        m.setattr(tx, "write_entropy", broken)
        with pytest.raises(Stop):
            run()
    after = len(passes)
    assert run() == whole and len(passes) == after        # nothing is fitted again
    assert after == sum(max(r["iterations"] for r in whole[i:i + 2]) for i in (0, 2))
    assert files(spark, f"{scratch}/out") == files(spark, f"{scratch}/whole")
    with pytest.raises(ValueError, match="other settings"):
        run(delta=0.5)


def test_a_turn_cut_short_is_passed_over(spark, scratch):
    pts = ksc.stable(C.points(spark, SF001))
    seeds = {3: ksc.collect_model(ksc.sample_seeds(C.pool(pts), 3)), 4: ksc.collect_model(ksc.sample_seeds(C.pool(pts), 4))}
    whole, scans = ksc.fit_many(pts, seeds, 5)
    ksc.fit_many(pts, seeds, 3, state=LoopState(spark, scratch, {}))
    os.remove(f"{scratch}/group=000000/turn=000003/_SUCCESS")
    assert len(loopstate.finished(spark, f"{scratch}/group=000000/turn=*")) == 2
    fits, left = ksc.fit_many(pts, seeds, 5, state=LoopState(spark, scratch, {}))
    assert left == scans - 2
    for k, f in whole.items():
        assert (f.iterations, f.converged) == (fits[k].iterations, fits[k].converged)
        assert [h[:2] for h in f.history] == [h[:2] for h in fits[k].history]
        for cid, (n, c) in f.model.items():
            assert fits[k].model[cid][0] == n and fits[k].model[cid][1] == pytest.approx(c, abs=1e-12)
