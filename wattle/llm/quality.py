"""Quality rules: Jensen-Shannon distance of a document's histograms to its language's.

Two histograms are compared with the reference of the document's language: character
classes (upper, lower, digit, white space, symbol, punctuation, other) and the language's
``COMMON`` most frequent words plus one bin for every other word. References are summed over
all documents of the language; a document without a label, or with one beyond the
``MAX_LANGS`` most frequent, is compared with the reference of all documents. A document
fails when the distance of its characters (square root of the base-2 divergence) exceeds its
limit plus the noise that a text of its length is expected to have. Words are judged by
divergences, less what sampling alone is expected to give, against a part of the divergence
of a text without any of the reference's common words: over all bins, which tell languages
that share words apart but need some length, and over two bins, common and other words,
whose noise is small from ``MIN_WORDS`` words on. Below that the histograms say too little and
only the base rules count.

Everything is column expressions: one pass counts words per language (map-side combined, so
a hot language costs nothing extra), one pass computes each document's counts, which are
checkpointed (a few hundred bytes a document); references and distances come from those.

Defined cases: a null or wordless text has only zeros and fails the base rules (fewer than
``BASE_WORDS`` words); repeated rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from .common import LOWER, UPPER, columns, words

BASE_WORDS, REPEAT_PERCENT = 50, 50
COMMON = 40        # words of a language's histogram
MAX_LANGS = 200    # references on the driver: 200 x 40 words
MIN_WORDS = 50     # guard: shorter texts are not judged by histograms
CHAR_LIMIT, WORD_LIMIT = 0.18, 0.30
WORD_PART, SHARE_PART = 0.25, 0.4   # of the divergence of a text without common words: all bins, two bins
WORD_SIGMAS = 2                     # standard deviations of the sampled divergence that are let pass

# The character classes, each a letter; a-z is deleted and counted by difference.
WHITE, SYMBOLS, DIGITS = "\t\n\x0b\x0c\r ", "#*$%&|<>", "0123456789"
PUNCTUATION = "!\"'()+,-./:;=?@[\\]^_`{}~"
CLASSES = (("W", WHITE), ("S", SYMBOLS), ("D", DIGITS), ("U", UPPER), ("P", PUNCTUATION))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _class_string(text: Column) -> Column:
    listed = "".join(chars for _, chars in CLASSES) + LOWER
    return F.translate(text, listed, "".join(name * len(chars) for name, chars in CLASSES))


def repeated_words(hashes: str, has_copies: str) -> tuple[Column, Column]:
    """(sorted windows, words covered by windows that occur twice or more).

    ``hashes``: 64-bit hashes of a text's 3-word windows in order. Windows are sorted by
    hash, those equal to a neighbour are put back in order, and their union is measured.
    """
    ordered = F.when(F.col(has_copies), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    covered = F.expr("""coalesce(aggregate(
        sort_array(transform(
            filter(_sorted, (e, j) -> e.h = get(_sorted, j - 1).h OR e.h = get(_sorted, j + 1).h), e -> e.i)),
        named_struct('n', 0L, 'end', 0L),
        (a, i) -> named_struct('n', a.n + i + 3L - greatest(a.end, cast(i AS BIGINT)), 'end', i + 3L),
        a -> a.n), 0L)""")
    return ordered, covered


def common_words(docs: DataFrame, common: int = COMMON) -> dict[str | None, list[str]]:
    """The most frequent words of each language, and of all documents under ``None``."""
    w = columns(docs, "text", "lang").select("lang", F.explode(words(F.col("text"))).alias("w"))
    n = w.groupBy("lang", "w").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    n = reliable(n.select("lang", "w", "n"))  # three small reports read it
    langs = [r["lang"] for r in n.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()]
    top = n.where(F.col("lang").isin(langs)).withColumn("k", rank).where(F.col("k") <= common) if langs else None
    out = {None: [r["w"] for r in n.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(common).collect()]}
    for r in (top.orderBy("lang", "k").collect() if top is not None else []):
        out.setdefault(r["lang"], []).append(r["w"])
    return out


def _slots(spark, refs: dict[str | None, list[str]], signs: list[str]) -> DataFrame:
    """``ref, mask, slot_word, slot_sign``: the common words of every reference, each in the
    slot that the low bits of its hash name. Tables are doubled until no two words share a
    slot, so that looking a word up takes one comparison, however many words are common."""
    listed = sorted({w for ws in refs.values() for w in ws})
    hashed = spark.createDataFrame([(w,) for w in listed], "w string").select("w", F.xxhash64("w").alias("h"))
    h = {r["w"]: r["h"] for r in hashed.collect()}
    rows = []
    for ref, ws in ({"": []} | refs if len(refs) == 1 else refs).items():
        size = 64
        while len({h[w] & (size - 1) for w in ws}) < len(ws):
            size *= 2
        at = {h[w] & (size - 1): (w, s) for w, s in zip(ws, signs)}
        rows.append((ref, size - 1, [at.get(i, (None, None))[0] for i in range(size)], [at.get(i, (None, None))[1] for i in range(size)]))
    return spark.createDataFrame(rows, "r string, mask bigint, slot_word array<string>, slot_sign array<string>")


def document_counts(docs: DataFrame, refs: dict[str | None, list[str]], common: int = COMMON) -> DataFrame:
    """Counts of every document: ``doc_id, ref`` (its reference; null for all documents),
    the base counts, ``chars`` (by class) and ``common`` (by common word, the rest last)."""
    spark = docs.sparkSession
    signs = [chr(0x100 + i) for i in range(common)]
    table = _slots(spark, refs, signs)
    d = columns(docs, "doc_id", "text", "lang")
    known = [k for k in refs if k is not None] or [""]
    d = d.withColumn("ref", F.when(F.col("lang").isin(known), F.col("lang")))
    d = d.join(F.broadcast(table), d["ref"].eqNullSafe(table["r"]))
    d = d.select("doc_id", "ref", F.coalesce("text", F.lit("")).alias("t"), words(F.col("text")).alias("w"), "mask", "slot_word", "slot_sign")
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def sign(x, y):
        i = y.bitwiseAND(F.col("mask")).cast("int")
        return F.when(F.get("slot_word", i) == x, F.get("slot_sign", i)).otherwise("")
    d = d.select(
        "doc_id", "ref", "t", "w", "h",
        _class_string(F.col("t")).alias("cls"),
        F.array_join(F.zip_with("w", "h", sign), "").alias("signs"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.withColumn("h3", F.when(F.size("w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    )).otherwise(F.expr("cast(array() as array<bigint>)")))
    d = d.withColumn("_copies", F.size(F.array_distinct("h3")) < F.size("h3"))
    ordered, covered = repeated_words("h3", "_copies")
    d = d.withColumn("_sorted", ordered)
    n_chars = F.length("t")
    by_class = [_count(F.col("cls"), name) for name, _ in CLASSES]
    counted = [_count(F.col("signs"), s) for s in signs]
    long = lambda c: c.cast("long")
    d = d.select(
        "doc_id", "ref", long(F.size("w")).alias("n_words"), n_chars.alias("n_chars"), F.length("cls").alias("n_cls"),
        F.array(*map(long, by_class)).alias("cls"), F.array(*map(long, counted)).alias("cw"), F.length("signs").alias("n_common"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"))
    return d.select(
        "doc_id", "ref", "n_words",
        long(F.col("n_chars") - F.get("cls", F.lit(0))).alias("word_chars"), F.get("cls", F.lit(1)).alias("n_symbols"),
        "n_dup_lines", "n_repeat_words",
        F.concat("cls", F.array(
            long(F.col("n_chars") - F.col("n_cls")),
            long(F.col("n_cls")) - F.aggregate("cls", F.lit(0).cast("long"), lambda a, x: a + x))).alias("chars"),
        F.concat("cw", F.array(F.col("n_words") - F.col("n_common"))).alias("common"))


def _sums(array: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(array, F.lit(i))).cast("double") for i in range(n)]).alias(array + "_ref")


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of two count arrays, 0 where either is empty."""
    # both sums are taken once, not again for each bin
    return F.expr(f"""get(transform(
        array(named_struct('c', aggregate({counts}, 0D, (a, v) -> a + v), 'r', aggregate({reference}, 0D, (a, v) -> a + v))),
        n -> sqrt(greatest(0D, coalesce(aggregate(zip_with({counts}, {reference}, (x, y) -> named_struct(
            'p', try_divide(cast(x AS DOUBLE), n.c), 'q', try_divide(y, n.r))), 0D,
        (a, s) -> a + CASE WHEN s.p > 0 THEN 0.5 * s.p * log2(2 * s.p / (s.p + s.q)) ELSE 0D END
                    + CASE WHEN s.q > 0 THEN 0.5 * s.q * log2(2 * s.q / (s.p + s.q)) ELSE 0D END), 0D)))), 0)""")


def sampled(bins: int, n: str) -> Column:
    """Expected divergence, from sampling alone, of ``n`` draws to their own distribution."""
    return F.lit(bins - 1) / (F.lit(8 * 0.6931471805599453) * F.greatest(F.col(n), F.lit(1)))


def noise(bins: int, n: str) -> Column:
    """``sampled`` as a distance."""
    return F.sqrt(sampled(bins, n))


def _two(array: str, common: int) -> Column:
    """Common words and the others of a word histogram."""
    own = F.aggregate(F.slice(array, 1, common), F.lit(0.0), lambda a, x: a + x)
    return F.array(own, F.get(array, F.lit(common)).cast("double"))


def odd_words(common: int, word_limit: float) -> Column:
    """Whether ``js_word``, or the share of common words, is beyond what sampling explains."""
    bare = F.pow("js_bare", 2)   # one per reference: the least that a lack of all common words gives
    spread = 1 + WORD_SIGMAS * (2 / common) ** 0.5
    return (F.pow("js_word", 2) > F.least(F.lit(word_limit ** 2), WORD_PART * bare) + spread * sampled(common + 1, "n_words")) | (
        F.pow("js_two", 2) > SHARE_PART * bare + sampled(2, "n_words"))


def score(docs: DataFrame, common: int = COMMON, min_words: int = MIN_WORDS,
          char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Base counts, ``js_char``, ``js_word``, ``base_failed`` and ``kept`` of every document."""
    counts = reliable(document_counts(docs, common_words(docs, common), common))
    sums = [_sums("chars", len(CLASSES) + 2), _sums("common", common + 1)]
    own = counts.where("ref is not null").groupBy("ref").agg(*sums)
    pooled = counts.agg(*sums).withColumn("ref", F.lit(None).cast("string"))
    refs = own.unionByName(pooled).withColumnRenamed("ref", "r").withColumn("bare", F.array(*[F.lit(0.0)] * common, F.lit(1.0)))
    refs = refs.withColumn("js_bare", distance("bare", "common_ref")).withColumn("two_ref", _two("common_ref", common)).drop("bare")
    refs = F.broadcast(refs)  # at most MAX_LANGS + 1 rows
    d = counts.join(refs, counts["ref"].eqNullSafe(refs["r"]))
    d = d.withColumn("js_char", distance("chars", "chars_ref")).withColumn("js_word", distance("common", "common_ref"))
    d = d.withColumn("two", _two("common", common)).withColumn("js_two", distance("two", "two_ref"))
    base_failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    odd = (F.col("js_char") > char_limit + noise(len(CLASSES) + 2, "word_chars")) | odd_words(common, word_limit)
    d = d.withColumn("base_failed", base_failed)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_char", "js_word",
                    "base_failed", (~F.col("base_failed") & ~((F.col("n_words") >= min_words) & odd)).alias("kept"))
