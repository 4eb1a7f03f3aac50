"""Letters and digits of every script bound a term, in the operator and in its SQL."""

import duckdb

from wattle.llm import url_filter
from wattle.llm.oracle import ORACLE

URLS = ["http://x.com/éporn", "http://x.com/porné", "http://x.com/pornд", "http://x.com/٣porn", "http://x.com/Ⅷporn", "http://x.com/你porn好", "http://x.com/²porn",
        "http://x.com/porn", "http://x.com/-porn_", "http://x.com/PORN?", "http://x.com/porn ", "http://x.com/\U0001F600porn", "http://x.com/cheapé-win",
        "http://x.com/cheap é win", "http://x.com/pornporn", "http://x.com/porn.porn", "É://x.net/porn", "http://x.com/áporn", "", None]


def test_operator_and_sql_agree_on_any_neighbour(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(d.repartition(3)).collect()}
    pages = d.toPandas()  # noqa: F841 (read by the SQL)
    con = duckdb.connect()
    con.register("pages", pages)
    rows = con.execute(ORACLE["op8_url_filters"]).fetchdf()
    assert dict(zip(rows["page_id"], rows["verdict"])) == got
    assert [i for i, v in got.items() if v == "block"] and {got[i] for i in (0, 1, 2, 3, 4, 5, 6, 12, 14)} == {"allow"}
    assert {got[i] for i in (7, 8, 9, 10, 11, 13, 15, 17)} == {"block"}


def test_clashing_and_repeated_names(spark):
    d = spark.createDataFrame([(1, "http://a/porn", "x", "y"), (1, "http://a/porn", "x", "y")], "page_id long, url string, r string, v string")
    d = d.selectExpr("*", "'z' AS host", "'http://b/' AS URL", "1 AS rule", "2 AS strict_hits", "3 AS page_id")
    got = [(r["page_id"], r["host"], r["verdict"]) for r in url_filter.filter_urls(d).collect()]
    assert got == [(1, "a", "block")] * 2
