"""Prefix trie against plain Python: rebuilt conversations, nodes, ends, savings."""

import hashlib
import random
import zlib

import helpers as H
from conftest import SF001, SF01
from wattle.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn, role or "", text or ""))

    def order(t):
        return (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest())

    turns = {c: [t[1:] for t in sorted(v, key=order)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    return out


def brute(rows):
    nodes = {}
    for c, seq in rebuilt(rows).items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    seqs = rebuilt(rows)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        value = (len(members) - 1) * len(H.words(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += children[p] == 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if seqs[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def nodes(spark, rows, partitions=3):
    d = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    out = prefix_trie.report(d)
    assert out.columns == FIELDS
    return sorted(repr(tuple(r)) for r in out.collect())


def conversations(seed, n, length=6, texts=4):
    rnd = random.Random(seed)
    return [(c, i, rnd.choice(["user", "assistant"]), " ".join(rnd.choices("ab", k=rnd.randint(0, texts)))) for c in range(n) for i in range(rnd.randint(1, length))]


def test_equals_the_definition(spark):
    for seed in (1, 2):
        rows = conversations(seed, 160)
        assert nodes(spark, rows) == brute(rows)


def test_hot_groups_long_conversations_and_busy_nodes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 5)  # conversations over many segments
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "HOT", 4)
    rows = conversations(3, 60, texts=1)
    rows += [(c, i, "user", f"same turn {i} of all") for c in range(100, 190) for i in range(5)]  # a third are copies
    rows += [(c, 0, "user", "one first turn") for c in range(300, 400)] + [(c, 1, "assistant", f"answer {c}") for c in range(300, 400)]
    rows += [(c, i, "user", f"long {i}") for c in (500, 501, 520) for i in range(83)]
    rows += [(541, i, "user", f"long {i}") for i in range(40)]
    assert nodes(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(None, 0, "user", "left out"), (20, None, "user", "null turn first"), (20, 0, None, "no role"), (20, 1, "user", None),
            (21, 0, "user", "one"), (22, -5, "user", "before"), (22, 2, "user", "tie"), (22, 2, "user", "tie"), (22, 2, "assistant", "other"),
            (43, 0, "user", "base absent"), (47, 0, "user", "x"), (48, 0, "", ""), (49, 0, "user", "a\tb  c " * 20_000), (-3, 0, "user", "negative id"),
            (10**17, 0, "user", "large id"), (10**17 + 1, 0, "user", "large id")]
    assert nodes(spark, rows) == brute(rows)
    turnless = [c for c, s in rebuilt(rows).items() if not s]
    assert turnless  # members of the root alone
    assert prefix_trie.report(spark.createDataFrame([], SCHEMA)).collect() == []
    d = spark.createDataFrame(rows, SCHEMA)
    extra = d.selectExpr("*", "1 AS CONV_ID", "2 AS Text", "3 AS seg", "4 AS x", "5 AS depth", "6 AS n_convs", "7 AS h")
    assert sorted(repr(tuple(r)) for r in prefix_trie.report(extra).collect()) == brute(rows)


def test_nodes_with_their_turns(spark):
    rows = conversations(5, 50)
    d = spark.createDataFrame(rows, SCHEMA)
    convs, turns = prefix_trie.rebuild(d)
    got = prefix_trie.with_turns(prefix_trie.trie(convs, turns), d, turns).collect()
    seqs = rebuilt(rows)
    assert len(got) == len(brute(rows))
    assert all((r["role"], r["text"]) == (seqs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None)) for r in got)


def test_query_equals_the_definition_on_the_table(spark):
    from wattle.llm.queries import op11_prefix_trie

    for sf in (SF001, SF01):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert sorted(repr(tuple(r)) for r in op11_prefix_trie(spark, sf).select(*FIELDS).collect()) == brute(rows)
