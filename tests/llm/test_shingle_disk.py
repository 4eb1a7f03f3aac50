"""What the n-gram join writes: pairs once and packed, a family's sets not once for each of its chunks."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_methods import families, frame, linked, shingles

from wattle.llm import ngram_join as nj


def texts(count, words, seed=3):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(1 << 30)}" for _ in range(words)) for _ in range(count)]


def stored_bytes(top):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet"))


def test_pairs_are_stored_once_and_packed(spark):
    docs = spark.createDataFrame(list(enumerate(texts(400, 400))), "doc_id long, text string")
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = stored_bytes(top)
    out = nj.report(docs)
    assert out.where("component_id = doc_id AND n_shingles = 398").count() == 400
    pairs = 400 * (2 * 10 * 398 // 100 + nj._spare(398))
    assert stored_bytes(top) - before < 9 * pairs


def test_a_familys_sets_are_not_sent_for_every_chunk(spark, monkeypatch):
    base, rnd = texts(1, 120)[0].split(), random.Random(5)
    family = [base] + [[*base[:k], f"new{rnd.random()}", *base[k + 1:]] for k in (rnd.randrange(120) for _ in range(150))]
    sent, joined = [], nj._joined
    monkeypatch.setattr(nj, "_joined", lambda dealt, percent: sent.append(dealt.count()) or joined(dealt, percent))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(family)], "doc_id long, text string")
    assert {r["component_id"] for r in nj.label(docs, chunk=300).collect()} == {0}
    assert sum(sent) < 3 * len(family)   # 60 chunks


@pytest.mark.parametrize("buckets, held", [(1, 1 << 20), (7, 50), (100, 400)])
def test_packed_pairs_meet(monkeypatch, buckets, held):
    monkeypatch.setattr(nj, "HELD", held)
    r, percent = random.Random(buckets), 90
    values = [r.randrange(1 << nj.BITS) for _ in range(80)] + [0, (1 << nj.BITS) - 1]
    n = {(1 << 33) * (k % 3) + k: r.randrange(20, 60) for k in range(120)}
    sets = {row: r.sample(values[3:], 12) + [v for v in values[:3] if r.random() < 0.6] for row in n}
    batches = []
    for part in ([*sets][:50], [], [*sets][50:]):
        raw = [np.array(sets[x], np.int64).view(np.uint8).reshape(-1, 8)[:, :nj.BITS // 8].tobytes() for x in part]
        batches.append(pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([n[x] for x in part], pa.int32()), pa.array(raw, pa.binary())], ["row", "n", "pairs"]))
    dealt = pa.Table.from_batches([*nj.deal(buckets)(iter(batches))]).sort_by("bucket")
    assert set(dealt["bucket"].to_pylist()) <= set(range(buckets))
    got = Counter()
    for b in nj.meet(buckets, percent)(iter(dealt.to_batches(max_chunksize=9))):
        for x in b.to_pylist():
            assert (x["n"], x["bn"]) == (n[x["a"]], n.get(x["b"], 0))
            assert x["shared"] > 0
            got[x["a"], x["b"]] += x["shared"]
    want = Counter()
    for v in values:
        have = sorted((n[x], x, s.index(v)) for x, s in sets.items() if v in s)
        if len(have) > nj.FEW:
            want.update((x, -1 - v) for _, x, _ in have)
            continue
        for (an, a, ap), (bn, b, bp) in itertools.combinations(have, 2):
            if 100 * an >= percent * bn and (abs(ap - bp) + abs(an - ap - bn + bp)) * (100 + percent) <= (100 - percent) * (an + bn):
                want[a, b] += 1
    assert got == want
    assert any(b < 0 for _, b in want) and any(b >= 0 for _, b in want)


def test_a_common_passage_ties_no_others(spark, monkeypatch):
    monkeypatch.setattr(nj, "shingle_ranks", lambda *_: [0] * nj.RANKS)   # as in large tables, where buckets hide it
    passage, docs = " ".join(f"p{k}" for k in range(100)), texts(60, 300)
    docs = spark.createDataFrame([(k, f"{t} {passage}") for k, t in enumerate(docs)], "doc_id long, text string")
    d, doc_id, text = nj._plain(docs)
    base = nj._base(d, doc_id, text, nj._functions(docs, 3, 90)[0])
    classes = base.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.min("row").alias("row"))
    tied, score = nj.ties(base, nj.stored(classes, "classes"), 90)
    assert score.count() > 0 and tied.count() == 0


@pytest.mark.parametrize("few, percent", [(2, 90), (3, 75), (5, 90)])
def test_crowded_pairs_leave_no_link_out(spark, monkeypatch, few, percent):
    monkeypatch.setattr(nj, "FEW", few)
    docs, rnd = families(few, 4, 40, 70) + ["the same text here " * 9] * 2, random.Random(few)
    passage = [f"p{k}" for k in range(60)]
    for k in range(40):   # mostly one passage, in part similar
        own = [f"d{k // 4}x{i}" for i in range(rnd.randrange(4, 30))]
        docs.append(" ".join(passage[:rnd.randrange(30, 60)] + own))
    sets = [shingles(t) for t in docs]
    got = {r["_0"]: r["component_id"] for r in nj.label(frame(spark, docs), percent=percent, chunk=400).collect()}
    assert [got[i] for i in range(len(docs))] == linked(sets, percent)
