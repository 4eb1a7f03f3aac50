"""Source divergence audit by duplicate-text collapse.

Equal texts of a language are grouped with their multiplicity in each source, every group is
split into terms once, and its counts and document frequencies are added with those weights.
A language keeps the terms in at least ``MIN_DOCS`` of its documents; each (language, source)
group then has a smoothed share of every kept term, and groups are compared by the chi-square
like sum of ``floor((p - q)^2 / q)``, all in whole numbers.

Pairs of sources are evaluated sparsely: a term that neither has gives a constant, a term that
one has gives a value that depends on its share only (summed from a histogram of shares), and only terms
that both have are visited pair by pair.

Scale: texts move once, one copy of each after a map-side merge, so a text that holds a third of all rows
is one row for each task. Python adds up terms of many texts before they move (at most ``HELD``
sums are held at a time). The sources of a term are kept in blocks of ``BLOCK``, and a pair of
blocks is the unit of work.

Defined cases: null text, lang or source read as empty strings; a group or language without terms
has values of 0; a language of one source has no pairs; repeated rows count each; an empty table
gives none. Only ``text, lang, source`` are read, exact spelling first.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, small, small_batches, stored

#: documents of a language that a kept term is in, at least
MIN_DOCS = 3
#: ranks of the terms of a group that are reported
TOP_TERMS = 200
#: (lang, source, term) sums that one Python worker holds at a time
HELD = 600_000
#: sources of one term that are held in one row
BLOCK = 64
#: shares are counted in this unit plus one
UNIT = 1_000_000_000

#: bytes of terms: letters, lower-cased, and everything beyond ASCII; the rest separates
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def collapsed(docs: DataFrame) -> DataFrame:
    """One row for each text of a language: ``lang, text, sources, copies`` (parallel arrays)."""
    d = columns(docs, "lang", "source", "text")
    d = d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    d = d.withColumn("h", F.unhex(F.md5("text")))
    copies = d.groupBy("lang", "h", "source").agg(F.count("*").alias("n"))
    copies = copies.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "n")).alias("m"))
    texts = d.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "h"]).select("lang", "text", F.col("m.source").alias("sources"), F.col("m.n").alias("copies"))


def _added(batches):
    """Sums of terms over the texts of a task, given out whenever ``HELD`` are held."""
    import pyarrow as pa

    counts: dict = {}
    found: dict = {}

    def given():
        for (lang, source), c in counts.items():
            terms = [t.decode() for t in c]
            f = found[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()),
                 pa.array(c.values(), pa.int64()), pa.array([f[t] for t in c], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        counts.clear()
        found.clear()

    for batch in batches:
        for lang, text, sources, copies in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            terms = text.encode().translate(_FOLD).split()
            once = None
            for source, k in zip(sources, copies):
                c, f = counts.setdefault((lang, source), Counter()), found.setdefault((lang, source), Counter())
                if k == 1 and len(sources) == 1:
                    c.update(terms)
                    f.update(set(terms))
                else:
                    once = Counter(terms) if once is None else once
                    for t, n in once.items():
                        c[t] += k * n
                        f[t] += k
        if sum(map(len, counts.values())) >= HELD:
            yield from given()
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term of a group."""
    small_batches(docs.sparkSession)
    d = collapsed(docs).mapInArrow(_added, "lang string, source string, term string, n long, docs long")
    return d.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, source, n, n_lang, head``: the groups' counts of kept terms; ``head`` marks
    one row of each term of a language."""
    w = Window.partitionBy("lang", "term")
    d = term_counts(docs).withColumns({
        "_docs": F.sum("docs").over(w), "n_lang": F.sum("n").over(w), "head": (F.row_number().over(w.orderBy("source")) == 1).cast("int")})
    return d.where(F.col("_docs") >= min_docs).select("lang", "term", "source", "n", "n_lang", "head")


def _share(count: str, of: str) -> str:
    """1 + floor(UNIT * (count + 1) / of) in long division by thousands, so that no step
    leaves 64 bits before ``of`` reaches 9e15."""
    first = f"(({count} + 1) * 1000)"
    second = f"(({first} % {of}) * 1000)"
    third = f"(({second} % {of}) * 1000)"
    return f"(1 + ({first} div {of}) * 1000000 + ({second} div {of}) * 1000 + {third} div {of})"


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the language's other sources
    (part ``pair``, all ranks) and the terms above the language's share (part ``term``)."""
    d = columns(docs, "lang", "source")
    groups = d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = stored(kept_terms(docs, min_docs), "audit-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_terms"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_all"), F.sum("head").alias("v"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = groups.withColumns({"size": F.expr("n_all + v"), "lang_size": F.expr("lang_all + v")})
    groups = stored(groups.withColumn("p0", F.expr(f"CASE WHEN v > 0 THEN {_share('0', 'size')} END")), "audit-groups")
    few = small(groups.select("lang", "source", "s", "size", "lang_size", "p0"))
    rows = kept.join(few, ["lang", "source"]).withColumn("p", F.expr(_share("n", "size")))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.withColumn("q", F.expr(_share("n_lang", "lang_size"))).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    pairs = distances(groups, rows)
    name = small(groups.select("lang", "s", "source"))
    pairs = pairs.join(name.withColumnRenamed("s", "a"), ["lang", "a"]).join(
        name.select("lang", F.col("s").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).union(terms)


def distances(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every ordered pair of sources (by number) of a language.

    With A and B the terms of each, the sum over all kept terms is

        sum A of f(p, p0_b) + sum B of f(p0_a, q) + (V - |A| - |B|) f(p0_a, p0_b)
        + sum A and B of f(p, q) - f(p, p0_b) - f(p0_a, q) + f(p0_a, p0_b)
    """
    one = groups.select("lang", "v", F.col("s").alias("a"), F.col("p0").alias("pa"), F.col("n_terms").alias("na"))
    other = small(groups.select("lang", F.col("s").alias("b"), F.col("p0").alias("pb"), F.col("n_terms").alias("nb")))
    absent = one.join(other, "lang").where("a <> b").select(
        "lang", "a", "b", F.expr(f"coalesce((v - na - nb) * {_gap('pa', 'pb')}, 0)").alias("value"))

    shares = rows.groupBy("lang", F.col("s").alias("a"), "p0", "p").agg(F.count("*").alias("k"))
    alone = shares.join(other.drop("nb"), "lang").where("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.expr(f"k * {_gap('p', 'pb')}")).alias("to"), F.sum(F.expr(f"k * {_gap('pb', 'p')}")).alias("back"))

    held = rows.groupBy("lang", "term", F.expr(f"s div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("s", "p", "p0")).alias("x"))
    held = stored(held, "audit-postings")
    # two sources of one block meet within its row; only languages of more blocks need a join
    within = held.select("lang", F.explode("x").alias("x"), F.col("x").alias("y"))
    wide = small(groups.where(F.col("s") >= BLOCK).select("lang").distinct())
    wide = held.join(wide, "lang", "left_semi")
    right = wide.select("lang", "term", F.col("x").alias("y"), F.col("block").alias("other"))
    across = wide.join(right, ["lang", "term"]).where("block < other").select("lang", F.explode("x").alias("x"), "y")
    both = within.unionByName(across)
    both = both.select("lang", "x", F.explode("y").alias("y")).where("x.s < y.s")
    both = both.select("lang", F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.p").alias("p"), F.col("y.p").alias("q"),
                       F.col("x.p0").alias("p0"), F.col("y.p0").alias("q0"))

    def more(p, q, p0, q0):
        return F.sum(F.expr(f"{_gap(p, q)} - {_gap(p, q0)} - {_gap(p0, q)} + {_gap(p0, q0)}"))

    both = both.groupBy("lang", "a", "b").agg(more("p", "q", "p0", "q0").alias("to"), more("q", "p", "q0", "p0").alias("back"))
    moved = alone.union(both)
    swapped = moved.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value"))
    every = absent.union(moved.select("lang", "a", "b", F.col("to").alias("value"))).union(swapped)
    return every.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
