"""The pipeline: its stages keep columns, work on what the one before kept, and remove what they decide."""

import corpus_pipeline as P
import helpers as H
from conftest import SF001
from wattle.llm import decontaminate, line_dedup, ngram_join


def test_stages_and_run(spark, scratch):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "source_mix"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(P.STAGES):
        before = docs
        out = stage(spark, docs, SF001)
        if i < len(P.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"{scratch}/{i}")
        docs = spark.read.parquet(f"{scratch}/{i}")
        counts.append(docs.count())
        if i == 0:
            assert counts[1] >= 0.95 * counts[0]
        if i == 1:
            assert line_dedup.removed_lines(docs).count() == 0 or docs.count() <= before.count()
            assert docs.where("n_chars <> length(text)").count() == 0
        if i == 2:
            assert ngram_join.report(docs).groupBy("component_id").count().where("count > 1").count() == 0
        if i == 3:
            bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
            assert decontaminate.report(docs, bench).where("contaminated").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.columns == [*names, "size", "source_size", "target", "taken"]
    assert docs.where("taken not in (size, 2 * size) or taken = 0").count() == 0
    assert H.as_multiset(P.run(spark, SF001).collect()) == H.as_multiset(docs.collect())


def test_pipeline_of_nothing_and_of_edges(spark):
    for docs in (H.empty(spark), H.edge(spark), H.clashing(spark)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF001)
        docs.collect()


def test_near_duplicates_are_those_of_five_words_and_four_fifths(spark):
    import random

    from conftest import SF01
    from test_methods import documents, frame, linked, shingles

    rnd = random.Random(7)
    texts = [r["text"] for r in documents(spark, SF01).where("n_chars > 600").orderBy("doc_id").limit(150).collect()]
    texts += [t + " " + " ".join(f"more{rnd.random()}" for _ in range(len(H.words(t)) * 3 // 20)) for t in texts[:40]]  # 0.87 at five words
    for t in texts[40:80]:  # one edit in 50 words: 0.82 at five words, 0.89 at three
        w = H.words(t)
        w[25::50] = [f"edit{rnd.random()}" for _ in w[25::50]]
        texts.append(" ".join(w))
    sets = [shingles(t, 5) for t in texts]
    roots = linked(sets, 80)
    expected = [i for i, r in enumerate(roots) if r == i or not sets[i]]
    got = P.near_duplicates(spark, frame(spark, texts), SF01)
    assert sorted(r["doc_id"] for r in got.collect()) == expected
    assert len(expected) < len(set(linked([shingles(t) for t in texts], 90)))
