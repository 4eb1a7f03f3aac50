"""The mix's flow on many overlapping patterns; token boundaries of every kind of file."""

import random
import time

import public_tokenizers
import pytest

from wattle.llm import mixing, token_count


def test_flow_of_many_patterns():
    rnd = random.Random(5)
    sources = [f"s{i}" for i in range(40)]
    patterns = {}
    while len(patterns) < 10_000:
        patterns[tuple(sorted(rnd.sample(sources, rnd.randint(1, 6))))] = rnd.randint(0, 1000)
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in sources}
    quotas = {s: rnd.randint(0, sizes[s]) for s in sources}
    start = time.perf_counter()
    given = mixing.flow(patterns, quotas)
    assert time.perf_counter() - start < 10
    got = dict.fromkeys(sources, 0)
    for p, parts in given.items():
        assert set(parts) == set(p) and min(parts.values()) >= 0 and sum(parts.values()) <= 2 * patterns[p]
        for s, n in parts.items():
            got[s] += n
    assert all(got[s] <= quotas[s] for s in sources)
    # largest: no source with room left can be reached from a pattern with words left
    left = {s for s in sources if got[s] < quotas[s]}
    more = True
    while more:
        more = {t for p, parts in given.items() if left & set(p) for t, n in parts.items() if n} - left
        left |= more
    assert not any(left & set(p) and sum(parts.values()) < 2 * patterns[p] for p, parts in given.items())
    assert given == mixing.flow(patterns, quotas)


def test_flow_without_patterns_or_quotas():
    assert mixing.flow({}, {}) == {}
    assert mixing.flow({(): 5, ("a",): 3}, {}) == {(): {}, ("a",): {"a": 0}}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


TEXTS = [None, "", " ", "a", "  two  spaces ", "new\nline\n\nand more\t tab", " lead", "trail ", "x\x0by\x0cz\r\n", "a b " * 3000, "naïve café 東京 　 wide"]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_default_boundary_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(p.encode(t or "")) for t in TEXTS]
    else:
        from tokenizers import Tokenizer

        p = Tokenizer.from_file(path)
        p.no_truncation()
        want = [len(p.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(frame(spark, TEXTS), path).collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    with open(path, "rb") as f:
        assert token_count.safe_boundary(f.read(), name.rsplit(".", 1)[1]) == ("space" if name.startswith("word") else "none")
