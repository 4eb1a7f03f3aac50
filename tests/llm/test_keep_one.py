"""Of similar rows under one id the same one stays, however they are partitioned."""

from wattle.llm import ngram_join


def test_ties_of_one_id_do_not_depend_on_partitions(spark):
    words = " ".join(f"word{i}" for i in range(400))
    rows = [(7, f"{words} tail{k}", f"s{k % 3}") for k in range(6)] + [(7, f"{words} tail0", "z"), (9, f"{words} tail9", "a"), (7, "another text altogether", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "map('k', source) AS m")
    kept = []
    for tasks, shuffled in ((1, d), (5, d), (3, d.orderBy("text")), (4, d.orderBy("source", "text"))):
        out = ngram_join.keep_one(shuffled.repartition(tasks))
        kept.append(sorted((r["doc_id"], r["text"], r["source"]) for r in out.collect()))
    assert kept[0] == kept[1] == kept[2] == kept[3]
    assert len(kept[0]) == 2 and {r[0] for r in kept[0]} == {7}
