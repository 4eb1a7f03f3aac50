"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is cut at ASCII white space. For a tokenizer that drops white space those are safe
boundaries: none of its tokens spans one, so the count of a text is the sum over its
pieces, however long the text is. The pieces of one Arrow batch (bounded in bytes, see
``common.small_batches``) are deduplicated, the distinct ones that the worker has not met
lately are encoded in groups of about equal bytes, and only the lengths are kept. Tokenizers whose tokens may
hold white space (byte-level ones, all ``.model`` files) get whole texts: ``safe_boundary`` decides, unless
``boundary`` says "space" or "none".

Defined cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty
result; repeated rows get equal answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches

#: Bytes of distinct pieces encoded by one library call.
GROUP_BYTES = 256 << 10
#: Lengths that a Python worker remembers; a full memory is emptied (about 100 MB).
REMEMBERED = 600_000
#: ASCII white space, where texts are cut.
SPACE = " \t\n\x0b\x0c\r"


def groups_by_bytes(sizes, limit: int):
    """Consecutive slices ``(start, end)`` of about ``limit`` bytes; a larger item is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def safe_boundary(spec: bytes, kind: str) -> str:
    """"space" if the count of a text is the sum over its pieces between ASCII white space: a
    step before the model removes white space, no added token holds any, and the library agrees
    on every such character alone, at the ends and between words. Else "none"."""
    if kind != "json":
        return "none"
    import json

    from tokenizers import Tokenizer

    told = json.loads(spec)
    steps = [told.get("pre_tokenizer") or {}]
    for step in steps:
        steps += step.get("pretokenizers", [])
    removes = any(s.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or s.get("type") == "Split" and s.get("behavior") == "Removed"
                  for s in steps)
    if not removes or any(c in t["content"] for t in told.get("added_tokens") or [] for c in SPACE):
        return "none"
    t = Tokenizer.from_str(spec.decode())
    t.no_truncation()
    t.no_padding()
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    one = count("a") + count("b1.")
    return "space" if all(count(c) == 0 and count(f"{c}a{c}{c}b1.{c}") == one for c in SPACE) else "none"


def token_counter(spec: bytes, kind: str, boundary: str, group_bytes: int):
    """Arrow function: text -> number of tokens."""

    def encoder():
        if kind == "json":
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(spec.value.decode())
            t.no_truncation()
            t.no_padding()
            return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=spec.value)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]

    made, known = [], {}

    @F.arrow_udf("bigint")
    def count(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not made:
            made.append(encoder())
        texts = pc.fill_null(texts, "")
        if boundary == "none":
            pieces, owner = texts, np.arange(len(texts))
        else:
            cut = pc.ascii_split_whitespace(texts)
            pieces, owner = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        lengths = np.fromiter((known.get(p, -1) for p in distinct), np.int64, len(distinct))
        new = np.flatnonzero(lengths < 0)
        sizes = pc.binary_length(coded.dictionary.take(pa.array(new))).to_numpy() if len(new) else []
        for a, b in groups_by_bytes(sizes, group_bytes):
            lengths[new[a:b]] = made[0]([distinct[i] for i in new[a:b]])
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update((distinct[i], lengths[i]) for i in new[:REMEMBERED])
        each = lengths[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
        return pa.array(np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64), pa.int64())

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, boundary: str | None = None,
                 group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    ``path``: a ``.json`` file of *tokenizers* or a ``.model`` file of *sentencepiece*; it is
    read on the driver and sent to the tasks, so executors need no copy of it.
    """
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "model") or boundary not in (None, "space", "none"):
        raise ValueError(f"unknown tokenizer file or boundary: {path}, {boundary}")
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    boundary = boundary or safe_boundary(data, kind)
    spec = spark.sparkContext.broadcast(data)
    d = columns(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return d.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_counter(spec, kind, boundary, group_bytes)(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
