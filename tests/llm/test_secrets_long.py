"""Spans of very long texts: right at every position, at a cost that grows with the length."""

import random
import re
import string
import time

from wattle.llm import secrets

from test_methods import PATTERNS, base_spans, frame

EVERY = [3.0] * ((len(secrets.ALPHABET) + 1) * len(secrets.ALPHABET))   # every token looks random


def brute(text):
    """Base spans, and the tokens that overlap none of them."""
    taken = [m.span() for kind, p in PATTERNS.items() for m in p.finditer(text)
             if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]]
    free = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{8,}", text)
            if not any(s < m.end() and m.start() < e for s, e in taken) and (len(m[0]) >= 20 or re.search("[A-Za-z0-9]", m[0]))]
    return base_spans(text), free


def test_spans_of_texts_around_the_block_size(spark):
    rnd, texts = random.Random(3), []
    for n in (0, 1, 63, 64, 65, 127, 128, 129, 500):
        words = [rnd.choice(["é", "token=abcdef12", "secret: zz", "deadbeef" * 3, "deadbeef" * 2, "AKIA" + "Q7" * 9, "identifier_x", "=" * 9, "ab"]) for _ in range(n)]
        texts += [" ".join(words), "-".join(words), "é" + "\n".join(words) + "ß"]
    d = secrets.scan(frame(spark, texts), EVERY).select("doc_id", secrets.joined("assign", "access", "hex").alias("b"), "markov")
    got = {r["doc_id"]: (r["b"], [(m["start"], m["end"]) for m in r["markov"]]) for r in d.collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_a_megabyte_of_tokens_costs_its_length(spark):
    rnd = random.Random(4)
    token = lambda: "".join(rnd.choices(string.ascii_lowercase, k=9))
    plain = " ".join(token() for _ in range(100_000))
    mixed = " ".join(f"token=abcdefgh1234 {token()}" for _ in range(30_000))
    began = time.time()
    rows = secrets.scan(frame(spark, [plain, mixed]), EVERY).selectExpr("doc_id", "size(assign) a", "size(markov) m", "element_at(markov, -1).end e").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 100_000, len(plain)), (1, 30_000, 30_000, len(mixed))]
    assert time.time() - began < 60   # 2 to 3 s alone; minutes when positions are appended one by one
