"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

import helpers as H
import public_tokenizers
from wattle.llm import decontaminate, lang_id, licenses, line_dedup, mixing, ngram_join, quality, secrets, token_count, url_filter

BENCH = [(1, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 and6 word7"), (2, None), (None, "no id"), (3, ""), (4, "naïve"), (4, "naïve")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def identify(d):
    return lang_id.identify(d, lang_id.learn(d))


def files(d):
    from pyspark.sql import functions as F

    from wattle.llm.common import columns

    return columns(d, "doc_id", "text", "source").withColumn("path", F.concat_ws("/", F.lit("top"), "source", F.col("doc_id")))


OPERATORS = {
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "licenses": lambda d: licenses.scan(files(d)),
    "mixing": lambda d: mixing.report(d),
    "lang_id": identify,
    "token_count": lambda d: token_count.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    "ngram_join": lambda d: ngram_join.report(d),
    "quality": lambda d: quality.score(d),
    "secrets": lambda d: secrets.scan(d).drop("text"),
    "decontaminate": lambda d: decontaminate.report(d, bench(d.sparkSession)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_document(spark, name):
    plain = OPERATORS[name](H.edge(spark)).collect()
    assert len(plain) == len(H.EDGE)
    if name not in ("line_dedup",):
        clash = OPERATORS[name](H.clashing(spark)).collect()
        assert H.as_multiset(clash) == H.as_multiset(plain)
    else:
        clash = OPERATORS[name](H.clashing(spark))
        assert clash.columns[:5] == H.edge(spark).columns
        assert H.as_multiset(r[1] for r in clash.collect()) == H.as_multiset(r[1] for r in plain)
    if "doc_id" in plain[0].asDict():
        twins = [r for r in plain if r["doc_id"] == 3]
        assert len(twins) == 3 and len({repr(r) for r in twins}) <= 2  # the repeated row has its twin's answer


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](H.empty(spark)).collect() == []


@pytest.mark.parametrize("missing", ["text", "lang", "source"])
def test_missing_or_null_columns(spark, missing):
    from pyspark.sql import functions as F

    d = H.edge(spark).withColumn(missing, F.lit(None).cast("string"))
    for name, op in OPERATORS.items():
        if missing == "text" or name in ("lang_id", "quality", "mixing", "licenses"):
            assert len(op(d).collect()) == len(H.EDGE), name


def test_stages_keep_columns_and_repeat_names(spark):
    for d in (H.edge(spark), H.clashing(spark)):
        for stage in (lang_id.accepted, line_dedup.clean, ngram_join.keep_one,
                      lambda x: decontaminate.decontaminate(x, bench(spark)),
                      lambda x: decontaminate.decontaminate(x, bench(spark), "spans"), secrets.redact):
            out = stage(d)
            assert out.columns == d.columns
            out.collect()
    for stage in (lang_id.accepted, line_dedup.clean, ngram_join.keep_one, lambda x: decontaminate.decontaminate(x, bench(spark)), secrets.redact):
        assert stage(H.empty(spark)).collect() == []


def test_empty_benchmark_is_harmless(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.report(H.edge(spark), none).collect()
    assert len(rows) == len(H.EDGE) and not any(r["contaminated"] or r["items"] for r in rows)


def test_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme casino"), (3, "no scheme casino"), (4, "http://"), (5, "x://A.NET/?q"), (6, "https://a.example.net/en/porn#://"),
            (7, "https://b.net"), (8, "ftp://host.org/fr"), (9, "https://x.com/" + "cheap-" * 50_000 + "pills"), (None, "http://h/adulterate")]
    d = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in url_filter.filter_urls(d).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "block"), 4: ("", "", None, "allow"),
        5: ("a.net", "/", "net/", "block"), 6: ("a.example.net", "/en/porn", "example.net/en/", "allow"), 7: ("b.net", "", None, "allow"),
        8: ("host.org", "/fr", None, "allow"), 9: ("x.com", "/cheap-ch", None, "block"), None: ("h", "/adultera", None, "allow")}
    assert url_filter.filter_urls(d.limit(0)).collect() == []
    assert url_filter.filter_urls(d.selectExpr("page_id", "url", "1 AS host", "2 AS URL2", "3 AS verdict")).count() == len(urls)
