"""Common words are looked up in slots, whatever the number of words of a histogram."""

from collections import Counter
from math import log2, sqrt

from wattle.llm import quality as Q


def test_slots_hold_every_common_word_apart(spark):
    refs = {"a": [f"w{i}" for i in range(300)], "b": ["x"], None: []}
    signs = [chr(0x100 + i) for i in range(300)]
    for r in Q._slots(spark, refs, signs).collect():
        held = {w: s for w, s in zip(r.slot_word, r.slot_sign) if w is not None}
        assert held == dict(zip(refs[r.r], signs)) and len(r.slot_word) == r.mask + 1


def test_common_counts_match_brute_force(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % (5 + 40 * (i % 3))}" for j in range(60)), lang)
            for i, lang in enumerate(["a", "b", None, "a", "", "zz", "b"])] + [(99, None, "a"), (100, "  \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = Q.common_words(docs.where("lang IS NULL OR lang <> 'zz'"), 40)
    got = {r.doc_id: r for r in Q.document_counts(docs, refs, 40).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        ref = lang if lang in refs else None
        n = Counter((text or "").split())
        common = [n[w] for w in refs[ref]]
        assert got[i].ref == ref
        assert list(got[i].common) == common + [0] * (40 - len(common)) + [sum(n.values()) - sum(common)]


def test_distance_matches_brute_force(spark):
    d = spark.createDataFrame([([3, 0, 1], [2.0, 2.0, 0.0]), ([0, 0, 0], [1.0, 0.0, 0.0])], "c array<bigint>, r array<double>")
    x = d.select(Q.distance("c", "r").alias("x"))

    def js(p, q):
        return sqrt(sum(0.5 * x * log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b) if x > 0))
    a, b = (r.x for r in x.collect())
    assert abs(a - js([0.75, 0, 0.25], [0.5, 0.5, 0])) < 1e-12 and b == 0
