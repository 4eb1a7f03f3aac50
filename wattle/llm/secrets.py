"""Secret scans: fixed patterns, and Markov models of random strings and ordinary names.

*Patterns* (kinds ``assign``, ``access``, ``hex``) are found leftmost, without overlap, per
kind. Spark has no function for the positions of all matches, but the pieces between them
(``split``) and the matches themselves (``regexp_extract_all``) alternate, so their lengths
add up to the positions, in code points. They are added up in blocks, and tokens find the matches
they overlap by halving, so a very long text costs about its length.

*Models.* Two first-order Markov models over the characters of tokens give each bigram a
log-likelihood ratio. The random model learns from labelled random strings: the values that
the patterns find anywhere in the corpus, and a digest of every text written in hexadecimal
(both cases) and base64. The ordinary model learns from all tokens of at least
``LEARN_TOKEN`` characters in texts free of pattern matches. Bigrams are counted map-side,
over the whole corpus; only the counts reach the driver, at most 2 x 68 x 67 of them. Every
token of at least ``MIN_TOKEN`` characters of every text that overlaps no pattern match is
scored; it is a span of kind ``markov`` when the mean ratio of its characters exceeds
``MIN_MEAN``. Signs alone (``========``) are no secret under ``LONG_TOKEN`` characters.

All of it is column expressions; no Python runs on the executors.

Defined cases: a null text counts as empty and has no span; an empty corpus learns smoothed
uniform models, which score every token 0; repeated rows get equal answers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, position

# The patterns of the contract.
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = "(" + KEYWORDS + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"   # maximal runs, so the length may stand in the pattern
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS = 6, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
MIN_TOKEN = 8        # characters of a token that is scored
LONG_TOKEN = 20      # characters from which a token without letters and digits is scored too
LEARN_TOKEN = 8      # characters of a token that is learned from: all that are scored
SMOOTH, PRIOR = 0.5, 8.0   # counts added to a character, and to a bigram's row by the characters' chances
BLOCK = 64           # matches whose positions are added up at a time
MIN_MEAN = 2.5       # nats per character by which a token must look more random than ordinary


def running(values: Column, block: int = BLOCK) -> Column:
    """Running sums of an array of numbers: sums of blocks, their offsets, then the sums within each
    block, so that a text of n matches costs about n * block steps and not n * n."""
    def sums(first, items):
        return F.slice(F.aggregate(items, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, F.size(items))

    def whole(v):
        starts = F.sequence(F.lit(0), (F.size(v) - 1).cast("int"), F.lit(block))
        parts = F.transform(starts, lambda i: F.slice(v, i + 1, block))
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        offsets = F.concat(F.array(F.lit(0)), sums(F.lit(0), totals))
        return F.flatten(F.zip_with(parts, F.slice(offsets, 1, F.size(parts)), lambda p, o: sums(o, p)))

    return F.when(F.size(values) > 0, bound(values, whole)).otherwise(F.expr("cast(array() as array<int>)"))


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often ``use`` names it in lambdas."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start,end,match>>`` of all matches, in code points, end exclusive."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def placed(m):
        gaps = F.slice(between, 1, F.size(m))
        ends = running(F.zip_with(gaps, m, lambda p, x: F.length(p) + F.length(x)))
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("match")))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    return bound(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))


def touches(span: Column, spans: Column) -> Column:
    """Whether a span overlaps one of ``spans`` (in order, apart from each other): the last that
    starts before the span's end is found by halving, and ends after its start or none does."""
    halves = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    before = F.aggregate(halves, F.lit(0), lambda at, w: F.when(
        (w <= F.size(spans) - at) & (F.get(spans, at + w - 1)["start"] < span["end"]), at + w).otherwise(at))
    return F.coalesce(F.when(F.size(spans) > 0, F.get(spans, before - 1)["end"] > span["start"]), F.lit(False))


def with_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``assign, access, hex``: the located matches that pass their length."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn("assign", F.filter(
        located(t, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= MIN_ASSIGN)
    ).withColumn("access", F.filter(located(t, ACCESS), lambda s: F.length(s["match"]) >= MIN_ACCESS)
    ).withColumn("hex", located(t, HEX))


def learn(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of every bigram: row ``1 + index`` of
    the character before it (0 at the start of a token), column its own index."""
    d = with_patterns(columns(docs, "text").where(F.col("text").isNotNull()))
    digest = F.sha2("text", 256)
    values = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["match"], ASSIGN, 2)),
        F.transform("access", lambda s: s["match"]), F.transform("hex", lambda s: s["match"]),
        F.array(digest, F.upper(digest), F.base64(F.unhex(digest))))
    clean = F.size("assign") + F.size("access") + F.size("hex") == 0
    names = F.when(clean, F.regexp_extract_all("text", F.lit(f"{TOKEN}{{{LEARN_TOKEN},}}"), F.lit(0))).otherwise(
        F.expr("cast(array() as array<string>)"))
    tokens = d.select(F.explode(F.array(
        F.struct(F.lit("random").alias("kind"), values.alias("t")), F.struct(F.lit("ordinary").alias("kind"), names.alias("t")))).alias("k"))
    tokens = tokens.select("k.kind", F.explode("k.t").alias("token"))
    c = tokens.select("kind", F.filter(F.split("token", ""), lambda x: F.instr(F.lit(ALPHABET), x) > 0).alias("c"))
    pairs = c.select("kind", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "c").alias("a"), F.col("c").alias("b"))).alias("p"))
    counts = pairs.where("p.b <> ''").groupBy("kind", "p.a", "p.b").agg(F.count("*").alias("n"))
    size = len(ALPHABET)
    n = {k: [[0] * size for _ in range(size + 1)] for k in ("random", "ordinary")}
    for r in counts.collect():
        n[r["kind"]][ALPHABET.index(r["a"]) + 1 if r["a"] else 0][ALPHABET.index(r["b"])] += r["n"]
    chance = {k: _chances(v) for k, v in n.items()}
    return [math.log(x) - math.log(y) for r, o in zip(chance["random"], chance["ordinary"]) for x, y in zip(r, o)]


def _chances(counts: list[list[int]]) -> list[list[float]]:
    """Chance of each character after each one: counts smoothed towards the characters' own
    frequencies, so that what never follows a rare character is judged by how rare it is."""
    own = [SMOOTH + sum(row[i] for row in counts) for i in range(len(ALPHABET))]
    own = [x / sum(own) for x in own]
    return [[(x + PRIOR * p) / (sum(row) + PRIOR) for x, p in zip(row, own)] for row in counts]


def total_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios of a token's bigrams."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded once
    chars = F.filter(F.split(token, ""), lambda x: x != "")
    size = len(ALPHABET)
    step = lambda a, c: F.struct(
        F.instr(F.lit(ALPHABET), c).alias("row"),
        (a["sum"] + F.get(table, a["row"] * size + F.instr(F.lit(ALPHABET), c) - 1)).alias("sum"))
    return F.aggregate(chars, F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def random_tokens(tokens: Column, ratios: list[float], min_mean: float) -> Column:
    """The located tokens that look more random than ordinary."""
    def odd(s):
        size = F.length(s["match"])
        return ((size >= LONG_TOKEN) | s["match"].rlike("[A-Za-z0-9]")) & (total_ratio(s["match"], ratios) > min_mean * size)

    return F.filter(tokens, odd)


def scan(docs: DataFrame, ratios: list[float] | None = None, min_mean: float = MIN_MEAN) -> DataFrame:
    """``doc_id, text`` and the spans of each kind as ``array<struct<start,end,match>>``."""
    ratios = learn(docs) if ratios is None else ratios
    d = with_patterns(columns(docs, "doc_id", "text"))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = located(t, f"{TOKEN}{{{MIN_TOKEN},}}")
    free = F.filter(tokens, lambda s: ~(touches(s, F.col("assign")) | touches(s, F.col("access")) | touches(s, F.col("hex"))))
    return d.withColumn("markov", random_tokens(free, ratios, min_mean))


def joined(*kinds: str) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, comma-joined."""
    def numbered(kind):
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    every = F.concat(*map(numbered, kinds))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float] | None = None, mark: str = "<secret>",
           min_mean: float = MIN_MEAN) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark``."""
    ratios = learn(docs) if ratios is None else ratios
    have = docs.columns
    at = position(have, "text")
    if at is None:
        return docs
    d = docs.toDF(*[f"_{i}" for i in range(len(have))]).withColumn("text", F.col(f"_{at}"))
    d = with_patterns(d).withColumn("_base", F.concat("assign", "access", "hex"))
    tokens = located(F.coalesce("text", F.lit("")), f"{TOKEN}{{{MIN_TOKEN},}}")
    d = d.withColumn("_all", F.concat("_base", random_tokens(tokens, ratios, min_mean)))
    cut = F.aggregate(
        F.array_sort("_all"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    d = d.withColumn(f"_{at}", F.when(F.size("_all") > 0, cut).otherwise(F.col("text")))
    return d.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(have)])
