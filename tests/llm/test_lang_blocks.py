"""Every label has its dictionary: blocks of languages answer like one pass, and like plain Python."""

import math
import random

import zstandard

from wattle.llm import lang_id

from test_methods import documents


def by_hand(model, text):
    """Language, score and margin of one text."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0
    raw = text.encode().translate(lang_id.LETTERS)
    sizes = []
    for lang, content in model:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(lang_id.LEVEL, write_content_size=False)
        packer = zstandard.ZstdCompressor(dict_data=own, compression_params=how)
        sizes.append((sum(len(packer.compress(raw[i:i + lang_id.BLOCK])) for i in range(0, len(raw), lang_id.BLOCK)), len(sizes), lang))
    sizes.sort()
    best = sizes[0][0]
    score = 1 / sum(math.exp((best - s) / 2) if s - best < 1000 else 0.0 for s, _, _ in sizes)
    return sizes[0][2], score, (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0


def test_blocks_equal_one_pass_and_plain_python(spark):
    d = documents(spark)
    for block in (1, 3, 200):
        model = lang_id.learn(d, block)
        got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9), round(r["margin"], 9)) for r in lang_id.identify(d, model).collect()}
        if block == 1:
            plain = list(model)
            want = {r["doc_id"]: (lambda a, b, c: (a, round(b, 9), round(c, 9)))(*by_hand(plain, r["text"])) for r in d.collect()}
        assert got == want
    same = lambda block: sorted(r["doc_id"] for r in lang_id.accepted(d, block=block).collect())
    assert same(2) == same(200) and lang_id.accepted(d, block=2).columns == d.columns


def test_the_rarest_of_250_labels_is_predicted(spark):
    rnd = random.Random(5)
    vocabulary = {f"l{k:03d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(40)] for k in range(250)}
    text = lambda lang: " ".join(rnd.choices(vocabulary[lang], k=60))
    rows = [(text(lang), lang) for k, lang in enumerate(vocabulary) for _ in range(3 if k < 249 else 2)]
    model = lang_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model) == 250 and model.names[-1] == "l249"
    asked = [(k, text(lang)) for k, lang in enumerate(vocabulary) if k % 50 == 49]
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {k: f"l{k:03d}" for k, _ in asked} and 249 in got
