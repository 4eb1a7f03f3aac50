"""Mixing sources to target weights: min-cost flow, then seeded choice of documents.

A document may belong to several sources. Documents are aggregated by membership pattern
(the set of their sources); each pattern offers its words once at no cost, again at cost 1,
a third time at cost 2 and so on (convex), and each source asks for its quota. The flow from
patterns to quotas that is largest, and among those cheapest, says how many words each
pattern gives. Every path costs what its pattern's next copy costs, so filling the quotas
copy by copy, with the flow free to be rerouted between sources, is that min-cost flow. Each copy
is sent in layers of shortest ways, all ways of a layer at once.

Only the pattern table (one row for each set of sources, at most ``MAX_PATTERNS``) reaches the
driver. Documents are then taken in the order of a seeded hash: whole copies for all of a
pattern, one more copy for those before the point where the rest is used up. The point is
found from sums over ``BUCKETS`` ranges of the hash, so only one range of a pattern is ever
sorted in one task, however large its source is. Each source's words come within half a
document of its quota, if its documents suffice.

Defined cases: null or wordless texts have size 0 and are taken 0 times; a null source is a
source of its own, listed last; a document with an empty list of sources is never taken; equal rows
(same id and size) are interchangeable; empty tables give empty results.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, n_words, position

WEIGHTS = (3, 1, 2)       # repeating, by the sources' order
SHARE = 1.5               # words asked for, as a part of all words
MAX_COPIES = 2
MAX_PATTERNS = 1_000_000  # rows of the pattern table on the driver
BUCKETS = 4096            # ranges of the seeded hash (three hexadecimal digits)


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES) -> dict:
    """Words asked of each source: weighted shares of ``share * total``, at most ``copies``
    times the source; what is above goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = share * sum(sizes.values()), set(order)
    out = {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > copies * sizes[s]]
        for s in over or open_:
            out[s] = float(copies * sizes[s]) if over else left * weight[s] / total
        left -= sum(out[s] for s in over)
        open_ -= set(over) if over else open_
    return out


def flow(patterns: dict, quotas: dict, copies: int = MAX_COPIES) -> dict:
    """Words from each pattern to each of its sources: ``{pattern: {source: words}}``.

    ``patterns``: set of sources (a tuple) -> words of one copy; ``quotas``: source -> words.
    """
    names = list(patterns)
    sources = list(dict.fromkeys(s for p in names for s in p))
    at = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    end = 1 + len(names) + len(sources)
    # edge e leads to head[e] and has room[e]; e ^ 1 is its way back. First one edge to each pattern
    head, room, edges = [], [], [[] for _ in range(end + 1)]

    def edge(u, v, n):
        for x, y, r in ((u, v, n), (v, u, 0)):
            edges[x].append(len(head))
            head.append(y)
            room.append(r)

    for i in range(len(names)):
        edge(0, 1 + i, 0)
    for i, p in enumerate(names):
        for s in p:
            edge(1 + i, at[s], patterns[p] * copies)
    for s in sources:
        edge(at[s], end, quotas.get(s, 0))
    for _ in range(copies):
        for i, p in enumerate(names):
            room[2 * i] += patterns[p]      # the next copy of every pattern
        while _layer(head, room, edges, end):
            pass
    given, e = {}, 2 * len(names)
    for p in names:
        given[p] = {s: room[e + 2 * i + 1] for i, s in enumerate(p)}
        e += 2 * len(p)
    return given


def _layer(head: list, room: list, edges: list, end: int) -> bool:
    """Sends what the shortest ways from node 0 to node ``end`` carry (a blocking flow); false
    if there is no way."""
    level = {0: 0}
    queue = deque([0])
    while queue and end not in level:
        u = queue.popleft()
        for e in edges[u]:
            if room[e] and head[e] not in level:
                level[head[e]] = level[u] + 1
                queue.append(head[e])
    if end not in level:
        return False
    tried, way, u = [0] * len(edges), [], 0
    while True:
        if u == end:
            n = min(room[e] for e in way)
            for e in way:
                room[e] -= n
                room[e ^ 1] += n
            full = next(i for i, e in enumerate(way) if not room[e])
            u = head[way[full] ^ 1]
            del way[full:]
        while tried[u] < len(edges[u]):
            e = edges[u][tried[u]]
            if room[e] and level.get(head[e]) == level[u] + 1:
                break
            tried[u] += 1
        else:
            if not way:
                return True
            u = head[way.pop() ^ 1]
            tried[u] += 1
            continue
        way.append(e)
        u = head[e]


def _sources(c: Column, kind: str) -> Column:
    return F.array_sort(F.array_distinct(c)) if kind.startswith("array") else F.array(c.cast("string"))


def mix(docs: DataFrame, quotas=None, sources: str = "source", copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """``docs`` plus ``size, source_size, target, taken``; names that ``docs`` already has are
    taken over by the new columns.

    ``quotas``: words asked of each source; by default ``targets`` of the sources' sizes.
    ``sources``: a column with one source or an array of sources. ``source_size`` and ``target`` are sums over
    the document's sources.
    """
    spark = docs.sparkSession
    have = docs.columns
    at = {n: position(have, n) for n in ("doc_id", "text", sources)}
    d = docs.toDF(*[f"_{i}" for i in range(len(have))])
    col = {n: F.lit(None).cast("string") if i is None else F.col(f"_{i}") for n, i in at.items()}
    kind = "string" if at[sources] is None else d.dtypes[at[sources]][1]
    d = d.withColumn("size", n_words(col["text"].cast("string"))).withColumn("_p", F.to_json(_sources(col[sources], kind)))
    rows = d.groupBy("_p").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} different sets of sources")
    import json

    patterns = {tuple(json.loads(r["_p"] or "[]")): r["n"] for r in rows}
    names = {tuple(json.loads(r["_p"] or "[]")): r["_p"] for r in rows}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, copies=copies) if quotas is None else {s: float(quotas.get(s, 0)) for s in sizes}
    given = flow({p: patterns[p] for p in sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])},
                 {s: int(t + 0.5) for s, t in wanted.items()}, copies)
    plan = []
    for p, n in patterns.items():
        take = sum(given[p].values())
        full = take // n if n else 0
        plan.append((names[p], sum(sizes[s] for s in p), float(sum(wanted[s] for s in p)), full, take - full * n))
    plan = spark.createDataFrame(plan, "_q string, source_size long, target double, _full long, _rest long")

    # the seeded order: text of the digest, its first three digits are the range
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), col["doc_id"].cast("string"), F.col("size").cast("string")))
    d = d.withColumn("_u", order).withColumn("_b", F.conv(F.substring("_u", 1, 3), 16, 10).cast("int"))
    sums = d.groupBy("_p", "_b").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("_p").orderBy("_b")
    sums = sums.withColumn("_before", F.sum("n").over(w) - F.col("n"))
    sums = sums.join(F.broadcast(plan), sums["_p"].eqNullSafe(plan["_q"]))
    # the range in which the rest is used up: the last that begins at or before it
    edge = sums.where(F.col("_before") <= F.col("_rest")).groupBy("_q").agg(
        F.max(F.struct("_b", "_before")).alias("e")).select(
            F.col("_q").alias("_r"), F.col("e._b").alias("_edge"), F.col("e._before").alias("_before"))
    plan = plan.join(edge, plan["_q"].eqNullSafe(edge["_r"]), "left").drop("_r")
    d = d.join(F.broadcast(plan), d["_p"].eqNullSafe(plan["_q"]))
    d = d.withColumn("_edge", F.coalesce("_edge", F.lit(-1)))
    out = [F.col(f"_{i}").alias(c) for i, c in enumerate(have) if c.lower() not in ("size", "source_size", "target", "taken")]
    result = lambda extra: [*out, "size", "source_size", "target", (F.col("size") * (F.col("_full") + extra)).alias("taken")]
    sure = d.where(F.col("_b") != F.col("_edge")).select(result(F.when(F.col("_b") < F.col("_edge"), 1).otherwise(0)))
    at_edge = Window.partitionBy("_p").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    within = d.where(F.col("_b") == F.col("_edge")).withColumn("_sum", F.col("_before") + F.sum("size").over(at_edge))
    # a document is in when its middle is before the point
    within = within.select(result(F.when(2 * F.col("_sum") - F.col("size") <= 2 * F.col("_rest"), 1).otherwise(0)))
    return sure.union(within)  # same columns in the same order; names may repeat


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    d = mix(columns(docs, "doc_id", "text", "source"), seed=seed)
    return d.select("doc_id", "size", "source_size", "target", "taken")
