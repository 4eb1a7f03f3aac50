"""The n-gram report makes the digests of the texts once."""

import helpers as H
from wattle.llm import ngram_join as nj


def test_report_reads_no_text_after_the_digests_are_stored(spark):
    docs = H.edge(spark).unionByName(H.edge(spark).limit(4))
    out = nj.report(docs)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    want = nj.label(docs.select("doc_id", "text")).selectExpr("_0", "n_shingles", "component_id")
    assert H.as_multiset(out.collect()) == H.as_multiset(r.__class__(**dict(zip(out.columns, r))) for r in want.collect())
