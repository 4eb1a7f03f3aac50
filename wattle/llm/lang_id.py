"""Language ID by compression: a text belongs to the language whose dictionary packs it best.

*Learning.* Each language gets one zstandard raw-content dictionary made of slices of
labelled texts. The sample is bounded: ``SLICES`` texts of ``SLICE_CHARS`` characters per
language, one for each bucket of a hash of the text, found by a map-side combined minimum
over all labelled rows (the row of a bucket with the smallest hash). Only those slices
reach the driver, for the ``MAX_LANGS`` most frequent labels.

*Prediction.* Letters are kept, everything else ASCII becomes a space, and the whole text is
compressed in blocks of ``BLOCK`` bytes with every dictionary; the sizes are summed over the
blocks and the smallest sum wins (equal sums: the more frequent language). The score is the
winner's share of ``exp(-bytes / 2)`` over all languages. A prediction is rejected when the
runner-up is less than ``min_margin`` (as a part of its size) behind.

Every label has its dictionary. Languages are scored in blocks of ``LANG_BLOCK``, the most
frequent first, with a running result; each further block is one more pass over the texts,
written in between, so memory does not grow with the number of languages.

Only text and label are read while learning; only text while predicting.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected, as
is every text when no labelled row was given; with a single language its margin is 1.
Null labels are not learned from. Repeated rows get equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, position, small, small_batches, stored

SLICES = 128        # labelled texts per language (bound of the sample)
SLICE_CHARS = 512   # characters of each
LANG_BLOCK = 200    # languages scored in one pass: 200 x 64 KB on the driver and in a task
LEVEL = 7
BLOCK = 2048        # bytes compressed at a time
MIN_MARGIN = 0.005
#: ASCII bytes: letters lower-cased, the rest a space; bytes of other characters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Running result over blocks of languages: smallest size, its language, the size behind it, sum of exp((best - size) / 2).
STATE = "struct<lang:string,best:long,second:long,mass:double>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Languages:
    """The learned languages, most frequent first, and the table of their slices."""

    names: list[str]
    slices: DataFrame | None      # lang, h, s
    block: int

    def __len__(self) -> int:
        return len(self.names)

    def dictionaries(self, first: int) -> list[tuple[str, bytes]]:
        """``(language, dictionary content)`` of the block that starts at ``first``."""
        names = self.names[first:first + self.block]
        content: dict[str, list] = {}
        for r in self.slices.where(F.col("lang").isin(names)).collect():    # SLICES rows for each
            content.setdefault(r["lang"], []).append((r["h"], r["s"]))
        return [(n, b" ".join(s.encode().translate(LETTERS) for _, s in sorted(content[n]))) for n in names]

    def __iter__(self):
        for first in range(0, len(self.names), self.block):
            yield from self.dictionaries(first)


def learn(labelled: DataFrame, block: int = LANG_BLOCK) -> Languages:
    """A sample of ``SLICES`` slices of the texts of every label (columns ``text`` and ``lang``)."""
    d = columns(labelled, "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    d = d.select("lang", "text", F.xxhash64("text").alias("h"))
    bucket = F.pmod(F.col("h"), F.lit(SLICES))
    # one row per language and bucket: a few hundred rows per language
    least = stored(d.groupBy("lang", bucket.alias("b")).agg(F.min("h").alias("h"), F.count("*").alias("n")), "least")
    names = [r["lang"] for r in least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    if not names:
        return Languages([], None, block)
    slices = d.join(small(least.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, SLICE_CHARS)).alias("s"))
    return Languages(names, stored(slices, "slices"), block)


def scorer(spark, dictionaries: list[tuple[str, bytes]]):
    """Arrow function: text and the result over earlier blocks (null: none) -> the result over
    them and these dictionaries; null for a text without a letter."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(dictionaries)
    packers = []

    def prepare():
        import zstandard as z

        for lang, content in sent.value:
            own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False)
            own.precompute_compress(compression_params=how)
            packers.append((lang, z.ZstdCompressor(dict_data=own, compression_params=how)))

    def judge(text, before):
        if not text or not any(c.isalpha() for c in text):
            return None
        import math

        raw = text.encode("utf-8", "replace").translate(LETTERS)
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in packers]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        found = [(packers[i][0], sizes[i]) for i in order[:2]]
        if before:
            found += [(before["lang"], before["best"])] + ([(None, before["second"])] if before["second"] is not None else [])
            found.sort(key=lambda x: (x[1], x[0] != before["lang"]))     # equal sizes: the earlier block
        weight = lambda size: math.exp((best - size) / 2) if size - best < 1000 else 0.0
        (lang, best), second = found[0], found[1][1] if len(found) > 1 else None
        mass = sum(map(weight, sizes)) + (before["mass"] * weight(before["best"]) if before else 0.0)
        return {"lang": lang, "best": best, "second": second, "mass": mass}

    @F.arrow_udf(STATE)
    def score(texts, states):
        import pyarrow as pa

        if not packers:
            prepare()
        kind = pa.struct([("lang", pa.string()), ("best", pa.int64()), ("second", pa.int64()), ("mass", pa.float64())])
        return pa.array([judge(t, s) for t, s in zip(texts.to_pylist(), states.to_pylist())], kind)

    return score


def judged(d: DataFrame, text: str, model: Languages, min_margin: float) -> DataFrame:
    """``d`` plus ``lang_pred, score, margin, rejected`` by the column ``text``."""
    state, spark = F.lit(None).cast(STATE), d.sparkSession
    for first in range(0, len(model), model.block):
        if first:
            d = stored(d, "scored")
        d = d.withColumn("_state", scorer(spark, model.dictionaries(first))(F.col(text).cast("string"), state))
        state = F.col("_state")
    d = d if len(model) else d.withColumn("_state", state)
    best, second = F.col("_state.best"), F.col("_state.second")
    margin = F.when(best.isNull(), 0.0).otherwise(F.coalesce((second - best) / second, F.lit(1.0)))
    return d.select(
        *[c for c in d.columns if c != "_state"], F.coalesce("_state.lang", F.lit("und")).alias("lang_pred"),
        F.coalesce(F.lit(1.0) / F.col("_state.mass"), F.lit(0.0)).alias("score"), margin.alias("margin"),
        (best.isNull() | (margin < min_margin)).alias("rejected"))


def identify(docs: DataFrame, model: Languages, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` of every document."""
    d = judged(columns(docs, "doc_id", "text"), "text", model, min_margin)
    return d.select("doc_id", "lang_pred", "score", "margin", "rejected")


def accepted(docs: DataFrame, min_margin: float = MIN_MARGIN, block: int = LANG_BLOCK) -> DataFrame:
    """``docs`` without the rejected documents, by a model learned from their own labels."""
    have = docs.columns
    model = learn(columns(docs, "text", "lang"), block)
    plain = docs.toDF(*[f"_{i}" for i in range(len(have))])
    at = position(have, "text")
    plain = plain.withColumn("_text", F.lit(None).cast("string") if at is None else F.col(f"_{at}"))
    kept = judged(plain, "_text", model, min_margin).where(~F.col("rejected"))
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(have)])
