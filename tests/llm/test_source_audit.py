"""Divergence audit against plain Python, on copies, edge cases and many sources."""

import random
import re
from collections import Counter, defaultdict

import helpers as H
from conftest import SF001
from wattle.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=3, top=200):
    """rows: (text, lang, source). The definition, densely."""
    groups, df, count = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(H.lower(text))
        groups.add((lang, source))
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        mine = sorted(s for x, s in groups if x == lang)

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in mine}
        q = shares(sum((count[lang, s] for s in mine), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)]
    return out


def audited(spark, rows, **options):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return [tuple(r) for r in source_audit.audit(d, **options).collect()]


def texts(seed, n, sources, langs=("en", "de", None), words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["É", "é", "naïve", "你好"]
    out = []
    for _ in range(n):
        t = " ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rnd.randint(0, words)))
        out.append((t, rnd.choice(langs), rnd.choice(sources)))
    return out


def test_equals_the_definition(spark):
    rows = texts(1, 300, ["a", "b", "c", None, ""])
    rows += [rows[7]] * 20 + [(rows[7][0], rows[7][1], s) for s in ("a", "b", "z")]  # copies within and across sources
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("1 2 3", "xx", "other"), ("one two", "yy", "single")]
    assert sorted(audited(spark, rows)) == sorted(brute(rows))
    assert sorted(audited(spark, rows, min_docs=1, top=5)) == sorted(brute(rows, 1, 5))


def test_more_sources_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK", 3)
    monkeypatch.setattr(source_audit, "HELD", 50)  # sums are given out many times
    rows = texts(2, 200, [f"s{i}" for i in range(11)], langs=("en",), words=25)
    assert sorted(audited(spark, rows)) == sorted(brute(rows))


def test_a_text_holding_a_third_of_all_rows_is_split_into_terms_once(spark):
    rows = texts(3, 200, ["a", "b"], langs=("en",))
    rows += [("the very same text of some words", "en", s) for s in "abcd" for _ in range(25)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(7)
    same = source_audit.collapsed(d).where("text = 'the very same text of some words'").collect()
    assert len(same) == 1 and dict(zip(same[0]["sources"], same[0]["copies"])) == dict.fromkeys("abcd", 25)
    assert sorted(tuple(r) for r in source_audit.audit(d).collect()) == sorted(brute(rows))


def test_long_division_is_exact(spark):
    rnd = random.Random(4)
    cases = [(c, m) for m in [1, 2, 7, 10**9, 10**12 + 7, 9 * 10**15 - 1] for c in {0, m - 1, *(rnd.randrange(m) for _ in range(20))}]
    cases = [(c, m) for c, m in cases if (c + 1) * 1000 < 2**63]
    d = spark.createDataFrame(cases, "c long, m long").selectExpr("c", "m", f"{source_audit._share('c', 'm')} AS p")
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["m"] for r in d.collect())


def test_defined_cases(spark):
    d = H.edge(spark)
    want = sorted(brute([(r["text"], r["lang"], r["source"]) for r in d.collect()]))
    assert sorted(tuple(r) for r in source_audit.audit(d).collect()) == want
    extra = d.selectExpr("*", "1 AS TEXT", "2 AS Lang", "3 AS term", "4 AS n", "5 AS p", "6 AS h", "7 AS rank")
    assert sorted(tuple(r) for r in source_audit.audit(extra).collect()) == want
    assert source_audit.audit(H.empty(spark)).collect() == []


def test_query_equals_the_definition_on_the_table(spark):
    from wattle.llm.queries import op12_source_audit

    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op12_source_audit(spark, SF001).collect())
    assert got == sorted(brute([(r["text"], r["lang"], r["source"]) for r in docs]))


def test_sources_of_one_block_meet_without_a_join(spark):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(texts(8, 60, ["a", "b", "c"]))], SCHEMA)
    out = source_audit.audit(d)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert not re.search(r"Join \[lang#\d+, term#\d+\]", final)


def test_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK", 2)
    rows = texts(9, 80, [f"s{i}" for i in range(7)])
    assert sorted(audited(spark, rows)) == sorted(brute(rows))
