"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

An item's windows are its runs of ``N`` consecutive words (a shorter item is one window).
Windows are kept as word numbers of the benchmark's own vocabulary. A document's words are
numbered by that vocabulary (one hash lookup each), every run of known words as long as a
window is hashed and looked up, and a hit is verified word by word, so no document word
outside the vocabulary can be hit and no hash collision can count.

The broadcast is bounded: a block holds about ``MAX_WORDS`` benchmark words. A benchmark
beyond that is dealt into several blocks by a hash of the item; each block scans the
documents once, its hits are checkpointed, and the hits of a document are merged.

Defined cases: null or wordless texts have no words and are clean; items that are null or
wordless have no window; items without an id are left out; repeated items count once;
repeated documents get equal answers. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import columns, position, small_batches

N = 13                   # words of a window
SHARE = 20               # contaminated when SHARE * n_hit >= n_words
MAX_WORDS = 2_000_000    # benchmark words in one broadcast (about 150 MB)
CHUNK_BYTES = 1 << 20    # text handled at once inside a task
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCAN = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>>"


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Windows:
    """The windows of some items: vocabulary, and per length the windows' word numbers,
    sorted by hash, with the items that have them."""

    def __init__(self, items, n: int):
        import numpy as np

        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item_id, text in items:
            w = [numbers.setdefault(x, len(numbers)) for x in item_words(text)]
            size = min(n, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                found.setdefault(size, {}).setdefault(tuple(w[i:i + size]), set()).add(str(item_id))
        self.vocabulary = [x.decode("utf-8", "replace") for x in numbers]
        self.multiplier = 0x9E3779B97F4A7C15
        while True:  # another multiplier in the unlikely case that two windows collide
            self.by_length = {}
            for size, windows in found.items():
                rows = np.array(list(windows), np.int64).reshape(-1, size)
                h = self.hash(rows)
                order = np.argsort(h, kind="stable")
                self.by_length[size] = (h[order], rows[order], [sorted(x) for x in np.array(
                    list(windows.values()), object)[order]])
            if all(len(np.unique(h)) == len(h) for h, _, _ in self.by_length.values()):
                break
            self.multiplier += 2

    def hash(self, rows):
        import numpy as np

        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = (h + rows[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(self.multiplier)
            h ^= h >> np.uint64(29)
        return h


def scan_texts(windows: Windows, vocabulary, texts):
    """``(n_words, spans, items)`` of every text; spans are merged runs of hit words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = [(t or b"").translate(FOLD) for t in texts.cast(pa.binary()).to_pylist()]
    folded = pa.array(raw, pa.binary()).cast(pa.string())
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(folded))
    words, owner = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(counts)])
    hit = np.zeros(len(words) + 1, np.int64)
    items: dict[int, set] = {}
    if len(words) and windows.by_length:
        ids = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, (hashes, rows, owners) in windows.by_length.items():
            first = np.arange(max(0, len(ids) - size + 1))
            good = (unknown[first + size] == unknown[first]) & (owner[first] == owner[first + size - 1])
            first = first[good]
            for a in range(0, len(first), 200_000):
                part = first[a:a + 200_000]
                got = ids[part[:, None] + np.arange(size)]
                h = windows.hash(got)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                same = (hashes[at] == h) & (rows[at] == got).all(axis=1)
                part, at = part[same], at[same]
                np.add.at(hit, part, 1)
                np.add.at(hit, part + size, -1)
                for doc, w in set(zip(owner[part].tolist(), at.tolist())):
                    items.setdefault(doc, set()).update(owners[w])
    covered = np.cumsum(hit[:-1]) > 0
    out = []
    for i in range(len(texts)):
        spans = []
        if i in items:
            c = np.diff(np.concatenate([[0], covered[begin[i]:begin[i + 1]].astype(np.int8), [0]]))
            spans = [{"first": int(s), "last": int(e) - 1} for s, e in zip(np.flatnonzero(c == 1), np.flatnonzero(c == -1))]
        out.append({"n_words": int(counts[i]), "spans": spans, "items": sorted(items.get(i, ()))})
    return out


def scanner(spark, windows: Windows):
    """(Arrow function text -> SCAN, its broadcast)."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(windows)

    @F.arrow_udf(SCAN)
    def scan(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        vocabulary = pa.array(sent.value.vocabulary, pa.string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        out, a = [], 0
        while a < len(texts):  # chunks of about CHUNK_BYTES, one text at least
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES, side="right")))
            out += scan_texts(sent.value, vocabulary, texts.slice(a, b - a))
            a = b
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]))

    return scan, sent


def span_cutter():
    """Arrow function (text, spans) -> the text without the words of the spans and without
    what stands between the words of one span."""

    @F.arrow_udf("string")
    def without_spans(texts, spans):
        import re

        import pyarrow as pa

        word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        out = []
        for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and cuts:
                raw = text.encode("utf-8", "replace")
                at = [m.span() for m in word.finditer(raw.translate(FOLD))]
                pieces, last = [], 0
                for c in cuts:
                    pieces.append(raw[last:at[c["first"]][0]])
                    last = at[c["last"]][1]
                text = b"".join([*pieces, raw[last:]]).decode("utf-8", "replace")
            out.append(text)
        return pa.array(out, pa.string())

    return without_spans


def merged(spans):
    """Sorted, overlapping or touching spans joined (Spark arrays)."""
    return F.expr(f"""aggregate(array_sort({spans}), cast(array() as array<struct<first:bigint,last:bigint>>),
        (a, s) -> CASE WHEN size(a) > 0 AND s.first <= element_at(a, -1).last + 1
            THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first,
                 'last', greatest(element_at(a, -1).last, s.last))))
            ELSE concat(a, array(s)) END)""")


def scan_documents(docs: DataFrame, bench: DataFrame, n: int = N, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` (columns by position, named ``_0, _1, ...``) plus ``n_words, spans, items``."""
    spark = docs.sparkSession
    have = docs.columns
    at = position(have, "text")
    d = docs.toDF(*[f"_{i}" for i in range(len(have))])
    text = (F.col(f"_{at}") if at is not None else F.lit(None)).cast("string")
    items = columns(bench, "item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (4 * max_words)))  # no word and its space are shorter than 2; 4 is common

    def windows(b):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        return Windows(part.toLocalIterator(prefetchPartitions=True), n)

    if blocks == 1:
        scan, _ = scanner(spark, windows(0))
        return d.withColumn("_s", scan(text)).select(*d.columns, "_s.n_words", "_s.spans", "_s.items")
    ensure_checkpoint_dir(spark)
    pos = position(have, "doc_id")
    who = F.col(f"_{pos}") if pos is not None else F.lit(None)
    key = F.struct(who.cast("string").alias("d"), F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("c"))
    found = None
    for b in range(blocks):
        scan, sent = scanner(spark, windows(b))
        part = d.select(key.alias("_k"), scan(text).alias("_s")).where(F.size("_s.items") > 0).checkpoint()
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("_k").agg(
        F.flatten(F.collect_list("_s.spans")).alias("_all"), F.array_distinct(F.flatten(F.collect_list("_s.items"))).alias("_items"))
    count, _ = scanner(spark, Windows([], n))
    d2 = d.withColumn("n_words", count(text)["n_words"]).withColumn("_k", key)
    d2 = d2.join(found, d2["_k"].eqNullSafe(found["_k"]), "left").withColumn(
        "_all", F.coalesce("_all", F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")))
    return d2.select(*d.columns, "n_words", merged("_all").alias("spans"),
                     F.array_sort(F.coalesce("_items", F.expr("cast(array() as array<string>)"))).alias("items"))


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, bench: DataFrame, n: int = N, share: int = SHARE, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items, contaminated`` of every document."""
    d = scan_documents(columns(docs, "doc_id", "text"), bench, n, max_words).withColumn("n_hit", n_hit())
    return d.select(F.col("_0").alias("doc_id"), "n_words", "n_hit", "spans", "items", contaminated(share).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", n: int = N, share: int = SHARE,
                  max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with every hit
    span cut out of the texts (``remove="spans"``). All columns are kept."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    have = docs.columns
    d = scan_documents(docs, bench, n, max_words).withColumn("n_hit", n_hit())
    at = position(have, "text")
    if remove == "documents":
        d = d.where(~contaminated(share))
    elif at is not None:
        d = d.withColumn(f"_{at}", span_cutter()(F.col(f"_{at}").cast("string"), F.col("spans")))
    return d.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(have)])
