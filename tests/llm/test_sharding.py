"""Interleaved shards: the law, the mixture, whole rows, defined cases."""

import os
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import helpers as H
from conftest import SF001, SF01
from wattle.llm import sharding


def check_law(rows, shards):
    n = Counter(r["shard"] for r in rows)
    assert set(n) <= set(range(shards)) and max(n.values()) - min(n.get(i, 0) for i in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_every_document_has_one_place(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = sharding.report(docs).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(text))
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    check_law(rows, 8)


@pytest.mark.parametrize("shards", [1, 3, 8, 17])
def test_every_shard_matches_the_mixture(spark, shards):
    # a third of the rows in one source, some sources of a few rows, many of one
    kinds = ["hot"] * 1000 + ["a"] * 500 + ["b"] * 300 + ["c"] * 40 + ["d"] * 7 + [None] * 153 + [f"s{i}" for i in range(1000)]
    docs = spark.createDataFrame([(i, f"text {i}", k) for i, k in enumerate(kinds)], "doc_id long, text string, source string")
    plan = sharding.assign(docs, shards, seed=5).collect()
    check_law(plan, shards)
    per, total = Counter((r["source"], r["shard"]) for r in plan), Counter(kinds)
    for s, n in total.items():
        for i in range(shards):
            assert abs(per[s, i] - n / shards) <= 1 + 0.05 * n / shards + 3 * (n > 100), (s, i, per[s, i], n)
    # within a shard, too, the sources alternate
    hot = sorted(r["slot"] for r in plan if r["shard"] == 0 and r["source"] == "hot")
    assert max(b - a for a, b in zip(hot, hot[1:])) <= 12
    # single rows are spread by their phases
    ones = [per_shard for per_shard in (sum(per[f"s{k}", i] for k in range(1000)) for i in range(shards))]
    assert min(ones) > 0.6 * 1000 / shards


def test_reruns_and_partitionings_agree_and_seeds_differ(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    a, b, c = [{r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.report(d, seed=s).collect()} for d, s in (
        (docs, 0), (docs.repartition(13, "text"), 0), (docs, 1))]
    assert a == b and a != c


def test_whole_rows_and_files(spark, scratch):
    docs = H.edge(spark)
    out = sharding.shard(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert H.as_multiset(out.drop("shard", "slot").collect()) == H.as_multiset(docs.collect())
    check_law(out.collect(), 3)
    path = os.path.join(scratch, "shards")
    sharding.write(docs, path, 3)
    back = spark.read.parquet(path)
    assert H.as_multiset(back.drop("shard", "slot").collect()) == H.as_multiset(docs.collect())
    check_law(back.collect(), 3)
    for f in sorted(os.listdir(path)):
        if f.startswith("shard="):
            for part in sorted(x for x in os.listdir(f"{path}/{f}") if x.endswith(".parquet")):
                slots = [r["slot"] for r in spark.read.parquet(f"{path}/{f}/{part}").collect()]
                assert slots == sorted(slots)


def test_defined_cases(spark):
    rows = sharding.report(H.edge(spark)).collect()
    assert len(rows) == len(H.EDGE)
    check_law(rows, 8)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    clash = sharding.report(H.clashing(spark)).collect()
    assert H.as_multiset(clash) == H.as_multiset(rows)
    extra = sharding.shard(H.edge(spark).withColumns({"SHARD": F.lit(9), "slot": F.lit("x"), "key": F.lit(1), "_bin": F.lit(2)}), 2)
    assert extra.columns == [*H.edge(spark).columns, "key", "_bin", "shard", "slot"] and extra.count() == len(H.EDGE)
    assert sharding.report(H.empty(spark)).collect() == [] and sharding.shard(H.empty(spark)).collect() == []
    for missing in ("text", "source", "doc_id"):
        assert sharding.report(H.edge(spark).withColumn(missing, F.lit(None).cast("string"))).count() == len(H.EDGE)


def test_native_and_no_single_task_orders_all_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = sharding.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
