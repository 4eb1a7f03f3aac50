"""What a Python worker of the n-gram join holds at once."""

import pyarrow as pa

from wattle.llm import ngram_join as nj


def test_texts_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in nj.report(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert int(spark.conf.get(key)) <= 1 << 20


def test_sets_are_sorted_and_distinct_within_each_text():
    import numpy as np

    texts = ["a b c a b c a b c", None, "", "x", "a b c", "c b a c b a", "x"]
    ranks = np.arange(nj.RANKS, dtype=np.int64) % 128
    together = nj.ordered_sets(pa.array(texts, pa.string()), 3, ranks)
    for t, s in zip(texts, together):
        w = (t or "").split()
        assert len(s) == len({tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else ())
        assert list(s) == sorted(set(s.tolist())) == list(nj.ordered_sets(pa.array([t], pa.string()), 3, ranks)[0])
