"""N-gram Jaccard join: documents linked when their sets of word n-grams are similar.

A document's set holds the different ``N``-word shingles of its A-Z lower-cased words (with
fewer words, the whole sequence), as 63-bit keys in one global order: rank of the shingle's
hash bucket (rare first, counted over all documents), then hash.

1. *Classes.* Documents with equal sets form a class, found by a 128-bit digest of the set
   with map-side minima; copies, however many, are one class from here on.
2. *Blocks.* Similar sets share a pair of neighbours among the first ``2 (1 - T) n + 1`` pairs
   of their ordered lists, and at least r of them among the first ``2 (1 - T) n + r``
   (``line_dedup`` has the proof). Pairs are ``BITS`` bits of hash: two that meet by chance can only
   add a tie. They travel sorted and packed, a few bytes each, to the task of their range of
   values. Where up to ``FEW`` classes share a pair, the combinations that pass the length and
   positional filters are counted over all pairs, and two classes are tied when they share as many as
   similar sets must, less the crowded pairs (those of more classes) that they can share. Only classes
   with at least as many crowded pairs as similar sets must share, like those of a large family of near
   copies, are tied by crowded pairs: in order of size they are cut where the length filter parts
   two neighbours, and each is tied to one of its run, so their combinations are never listed. The ties' connected components are the
   blocks: every two similar sets are in one block.
3. *Tries.* The full sets of the classes in a block are joined by prefix trees (``trie``). A
   block of more than ``CHUNK`` shingles is dealt into chunks, each joined in a task of its own
   together with the block's leaders: those with the most crowded pairs, as the original of
   a family has. Most of a family is one component then, and is not compared with itself again:
   what is not in the block's largest component (its strays) meets every chunk, so
   that every two sets of a block that are not connected otherwise have been compared. Each task returns
   only links that connect something new.
4. *Components* of the links (alternating stars, written to the shared folder each turn).

Defined cases: a null or wordless text has an empty set (size 0), links with nothing and is
its own component; rows of one doc_id are separate documents; a null doc_id never becomes a
component id unless a whole component has no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, position, small, small_batches, stored

N = 3
PERCENT = 90
RANKS = 16384
CHUNK = 300_000   # shingles of a chunk: about 20 MB in a task
LEAD = 8          # leaders of a block have this part of a chunk
BATCH_BYTES = 1 << 20   # text handed to Python at once: a worker needs about 25 bytes for each
FEW = 32          # classes sharing a pair whose combinations are counted
BITS = 40         # of a pair's hash
HELD = 1 << 20    # pairs that are sorted and packed together: about 100 MB in a task
BUCKET = 400_000  # pairs of one range of values, on average: about 60 MB in a task
SET = "struct<n:int,h1:bigint,h2:bigint,pairs:binary>"
MET = "a long, n long, b long, bn long, shared long"


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts, n: int):
    """(64-bit hash of every shingle, its text's row) of an Arrow array of texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words, owner = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    w = own[coded.indices.to_numpy()]
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.minimum(count, n)                              # words of a text's shingles
    starts = np.arange(len(w)) <= (first + count - size)[owner]
    at, owner = np.flatnonzero(starts), owner[starts]
    size = size[owner]
    h = size.astype(np.uint64)
    for k in range(n):
        more = slice(None) if size.min() > k else size > k
        h[more] = _mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + w[at[more] + k])
    return h, owner


def ordered_sets(texts, n: int, ranks):
    """The texts' sets: sorted arrays of keys, rank in the top byte, then 56 bits of hash."""
    import numpy as np

    h, owner = shingle_hashes(texts, n)
    keys = (ranks[(h & np.uint64(RANKS - 1)).astype(np.int64)] << 56) | (h >> np.uint64(8)).astype(np.int64)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    sets = np.split(keys, ends[:-1]) if len(ends) else []
    for s in sets:
        s.sort()
    # all texts at once: a key that repeats the one before it in its text goes
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return [s[k] for s, k in zip(sets, np.split(new, ends[:-1]))]


def shingle_ranks(docs: DataFrame, n: int) -> list[int]:
    """Rank (0 rare to 127 frequent) of every hash bucket, from all shingles of all texts."""
    import math

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(RANKS, np.int64)
        for batch in batches:
            h, _ = shingle_hashes(batch.column(0), n)
            total += np.bincount((h & np.uint64(RANKS - 1)).astype(np.int64), minlength=RANKS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["b", "n"])

    small_batches(docs.sparkSession, BATCH_BYTES)
    text = columns(docs, "text").select(F.col("text").cast("string").alias("text"))
    ranks = [0] * RANKS
    for r in text.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        ranks[r["b"]] = min(127, int(4 * math.log2(r["n"])))
    return ranks


def _spare(n: int) -> int:
    """Pairs in the prefix beyond those that the differences of similar sets can break."""
    return 4 + n // 50


def _keys(batch):
    """Pair, row, n, position of every pair of an Arrow batch ``row, n, pairs``."""
    import numpy as np
    import pyarrow as pa

    row, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
    b = batch.column(2).cast(pa.binary())
    ends = np.frombuffer(b.buffers()[1], np.int32)[b.offset:b.offset + len(b) + 1].astype(np.int64)
    g = np.zeros(((ends[-1] - ends[0]) * 8 // BITS, 8), np.uint8)
    if len(g):
        g[:, :BITS // 8] = np.frombuffer(b.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(g), BITS // 8)
    ends = (ends - ends[0]) * 8 // BITS
    own = np.repeat(np.arange(len(b)), np.diff(ends))
    return g.view(np.int64).ravel(), row[own], n[own], np.arange(len(g)) - ends[own]


def _least(bucket, buckets: int):
    """The least pair of a bucket."""
    return -((-bucket << BITS) // buckets)


def deal(buckets: int):
    """Rows ``row, n, pairs`` -> ``bucket, keys``: the pairs of many sets, sorted, packed for each range of values.

    Packed are the least row, the number of pairs and the bytes that each field needs, then the fields (step
    from the pair before, row, n, position) byte by byte: first all lowest bytes, then the next."""

    def pack(held):
        import struct

        import numpy as np
        import pyarrow as pa

        g, row, n, p = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(g)
        g, first = g[order], int(row.min())
        bucket = (g * buckets) >> BITS
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        step = np.diff(g, prepend=0)
        step[starts] = g[starts] - _least(bucket[starts], buckets)
        fields = [step, row[order] - first, n[order], p[order]]
        wide = [(int(f.max()).bit_length() + 7) // 8 for f in fields]
        planes = np.concatenate([f.view(np.uint8).reshape(-1, 8)[:, :w].T for f, w in zip(fields, wide)])
        ends = [*starts[1:].tolist(), len(g)]
        keys = [struct.pack("<qI4B", first, j - i, *wide) + planes[:, i:j].tobytes() for i, j in zip(starts.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array(keys, pa.binary())], ["bucket", "keys"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append(_keys(batch))
            count += len(held[-1][0])
            if count >= HELD:
                yield pack(held)
                held, count = [], 0
        if count:
            yield pack(held)

    return run


def _unpack(bucket: int, keys, buckets: int):
    import struct

    import numpy as np

    first, count, *wide = struct.unpack_from("<qI4B", keys)
    planes, at, fields = np.frombuffer(keys, np.uint8, offset=16).reshape(-1, count), 0, []
    for w in wide:
        f = np.zeros((count, 8), np.uint8)
        f[:, :w] = planes[at:at + w].T
        fields.append(f.view(np.int64).ravel())
        at += w
    step, row, n, p = fields
    return np.cumsum(step) + _least(bucket, buckets), row + first, n, p


def meet(buckets: int, percent: int):
    """Rows ``bucket, keys`` sorted by bucket -> ``MET``: shared pairs of every two classes that are not parted by a
    filter; and, with b = -1 - g, a class and its crowded pair g."""
    lose = 100 - percent

    def chunks(starts, k):
        import numpy as np

        at = max(1, 1_000_000 // (k * k))
        for i in range(0, len(starts), at):
            yield starts[i:i + at, None] + np.arange(k)

    def met(held):
        import numpy as np

        g, row, n, p = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(g)
        same = np.diff(g[order]) == 0
        at = order[np.append(same, False) | np.insert(same, 0, False)]
        at = at[np.lexsort((row[at], n[at], g[at]))]
        g, row, n, p = g[at], row[at], n[at], p[at]
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        m = np.diff(starts, append=len(g))
        rows, own = np.unique(row, return_inverse=True)
        size = np.zeros(len(rows), np.int64)
        size[own] = n
        crowded = np.repeat(m > FEW, m)
        none = np.zeros(crowded.sum(), np.int64)
        found = [(row[crowded], n[crowded], -1 - g[crowded], none, none + 1)]
        for k in np.unique(m[m <= FEW]).tolist():
            i, j = np.triu_indices(k, 1)
            for each in chunks(starts[m == k], k):
                x, y = each[:, i].ravel(), each[:, j].ravel()
                # length; then the words before and after the shared pair, which bound the difference
                near = 100 * n[x] >= percent * n[y]
                near &= (abs(p[x] - p[y]) + abs((n[x] - p[x]) - (n[y] - p[y]))) * (100 + percent) <= lose * (n[x] + n[y])
                code, shared = np.unique((own[x] * len(rows) + own[y])[near & (own[x] != own[y])], return_counts=True)
                x, y = np.divmod(code, len(rows))
                found.append((rows[x], size[x], rows[y], size[y], shared))
        return [np.concatenate(x) for x in zip(*found)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["a", "n", "b", "bn", "shared"])

        now, held = None, []
        for batch in batches:
            found = []
            for bucket, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    found.append(met(held))
                    held = []
                now = bucket
                held.append(_unpack(bucket, keys.as_buffer(), buckets))
            if found:
                yield batch_of(found)
        if held:
            yield batch_of([met(held)])

    return run


def ties(base: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``a, b``: pairs of classes (their rows) whose components bring all similar ones together; and ``row, score``: the
    crowded pairs of each class that has any."""
    spark = base.sparkSession
    again = base.join(small(classes.where("copies > 1").select("h1", "h2", F.col("row").alias("kept"))), ["h1", "h2"])
    again = small(stored(again.where("row <> kept").select("row"), "repeats"))
    sets = base.where("n > 1").select("row", "n", "pairs").join(again, "row", "left_anti")
    total = base.agg(F.sum(F.length("pairs"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * 8 // BITS // BUCKET)
    dealt = sets.mapInArrow(deal(buckets), "bucket long, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    met = stored(dealt.mapInArrow(meet(buckets, percent), MET), "met")

    def must(n):
        broken = F.floor(F.lit(2 * (100 - percent)) * n / 100)
        return F.greatest(F.lit(1), F.least(n - 1 - broken, 4 + F.floor(n / 50)))

    crowded = met.where("b < 0").select(F.col("a").alias("row"), "n", F.col("b").alias("g")).distinct()
    # sets similar to one of n shingles have no less than its least: heavy classes have as many crowded pairs as those share
    score = crowded.groupBy("row", "n").agg(F.count("*").alias("score"))
    score = stored(score.withColumn("heavy", F.col("score") >= must(F.ceil(percent * F.col("n") / 100))), "scores")
    by_size = Window.partitionBy("g").orderBy("n", "row")
    many = crowded.join(small(score.where("heavy").select("row")), "row")
    many = many.withColumn("cut", (100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int"))
    many = many.withColumn("run", F.sum(F.coalesce("cut", F.lit(0))).over(by_size))
    many = many.select(F.col("row").alias("a"), F.min("row").over(Window.partitionBy("g", "run")).alias("b"))

    counted = met.where("b >= 0").groupBy("a", "n", "b", "bn").agg(F.sum("shared").alias("shared"))
    for c in ("a", "b"):
        counted = counted.join(small(score.select(F.col("row").alias(c), F.col("score").alias(f"{c}_score"), F.col("heavy").alias(f"{c}_heavy"))), c, "left")
    spare = F.least(F.coalesce("a_score", F.lit(0)), F.coalesce("b_score", F.lit(0)))
    spare = F.when(F.col("a_heavy") & F.col("b_heavy"), 0).otherwise(spare)
    counted = counted.where(F.col("shared") >= F.greatest(F.lit(1), F.least(must(F.col("n")), must(F.col("bn"))) - spare))
    return counted.select("a", "b").unionByName(many.where("a <> b").distinct()), score.select("row", "score")


def _set_functions(spark, ranks, n: int, percent: int):
    """An Arrow function text -> SET (digest and pairs of the prefix), and one for ``mapInArrow``: text -> ``h1, h2, s`` (the set)
    of the texts that have one."""
    small_batches(spark, BATCH_BYTES)
    sent = spark.sparkContext.broadcast(ranks)

    def halves(s):
        import xxhash

        x = xxhash.xxh3_128_intdigest(s.tobytes())
        return (x & ((1 << 64) - 1)) - (1 << 63), (x >> 64) - (1 << 63)

    @F.arrow_udf(SET)
    def digest(texts):
        import numpy as np
        import pyarrow as pa

        table = np.array(sent.value, np.int64)
        sizes, h1, h2, pairs = [], [], [], []
        for s in ordered_sets(texts, n, table):
            take = 2 * (100 - percent) * len(s) // 100 + _spare(len(s))
            u = s[:take + 1].view(np.uint64)
            x, y = halves(s)
            sizes.append(len(s))
            h1.append(x)
            h2.append(y)
            pairs.append(_mix(u[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(u[1:])) >> np.uint64(64 - BITS))
        offsets = (np.concatenate([[0], np.cumsum([len(p) for p in pairs])]) * (BITS // 8)).astype(np.int32)
        flat = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        flat = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :BITS // 8])
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
             pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])],
            ["n", "h1", "h2", "pairs"])

    def whole(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(sent.value, np.int64)
        for batch in batches:
            sets = [s for s in ordered_sets(batch.column(0), n, table) if len(s)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            both = [pa.array(x, pa.int64()) for x in (zip(*map(halves, sets)) if sets else ([], []))]
            yield pa.RecordBatch.from_arrays([*both, lists], ["h1", "h2", "s"])

    return digest, whole


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (columns a, b): its component's least node.

    Alternating large and small stars; every turn is written to the shared folder.
    """
    def sign(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = sign(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = sign(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def join_chunks(percent: int):
    """Rows sorted by (block, c1, c2, side) -> links, one trie join for each (block, c1, c2)."""

    def links(part):
        import numpy as np

        from .trie import Components, similar_between, similar_within

        rows = [x for side in part for x in side]
        if len(rows) < 2:
            return []
        sizes = [len(s) for _, s in rows]
        _, local = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True)
        sets = [x.tolist() for x in np.split(local, np.cumsum(sizes)[:-1])]
        k = len(part[0])
        found = similar_between(sets[:k], sets[k:], percent) if part[1] else similar_within(sets, percent)
        parts = Components(len(rows))
        for i, j in found:
            parts.join(i, j)
        return [(rows[i][0], rows[parts.find(i)][0]) for i in {i for both in found for i in both} if parts.find(i) != i]

    def run(batches):
        import pyarrow as pa

        key, part = None, ([], [])
        for batch in batches:
            found = []
            c = {n: batch.column(i) for i, n in enumerate(("block", "c1", "c2", "side", "node", "s"))}
            keys = list(zip(c["block"].to_pylist(), c["c1"].to_pylist(), c["c2"].to_pylist()))
            sides, nodes, sets = c["side"].to_pylist(), c["node"].to_pylist(), c["s"]
            for i, k in enumerate(keys):
                if k != key:
                    found += links(part)
                    key, part = k, ([], [])
                side = part[sides[i]]
                if not side or side[-1][0] != nodes[i]:  # a repeated row gives its class again
                    side.append((nodes[i], sets[i].values.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
        found = links(part)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def label(docs: DataFrame, n: int = N, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (columns by position, named ``_0, _1, ...``) plus ``n_shingles``, ``component_id``
    and ``group``: a key of the component, null for documents that are alone in theirs."""
    d, doc_id, text = _plain(docs)
    digest, whole = _functions(docs, n, percent)
    named = _named(_base(d, doc_id, text, digest), d.select(doc_id.alias("rep"), text.alias("text")), whole, percent, chunk)
    out = d.withColumn("_d", digest(text))
    return _labelled(out.select(*d.columns, "_d.n", "_d.h1", "_d.h2"), d.columns, doc_id, named)


def _plain(docs: DataFrame):
    """``docs`` with its columns named by position, and the columns of id and text."""
    have = docs.columns
    at = {c: position(have, c) for c in ("doc_id", "text")}
    d = docs.toDF(*[f"_{i}" for i in range(len(have))])
    doc_id = F.lit(None).cast("long") if at["doc_id"] is None else F.col(f"_{at['doc_id']}")
    text = F.lit(None).cast("string") if at["text"] is None else F.col(f"_{at['text']}").cast("string")
    return d, doc_id, text


def _functions(docs: DataFrame, n: int, percent: int):
    if not 75 <= percent <= 100:
        raise ValueError("percent is 75 to 100")
    return _set_functions(docs.sparkSession, shingle_ranks(docs, n), n, percent)


def _base(d: DataFrame, doc_id, text, digest) -> DataFrame:
    """``doc_id, row, n, h1, h2, pairs`` of all documents, stored. ``row`` numbers them."""
    d = d.select(doc_id.alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(text).alias("d"))
    return stored(d.select("doc_id", "row", "d.*"), "digests")


def _labelled(rows: DataFrame, keep: list[str], doc_id, named: DataFrame) -> DataFrame:
    """Columns ``keep`` of ``rows`` (with ``n, h1, h2`` of their sets) and what ``label`` adds."""
    out = rows.join(small(named), ["h1", "h2"], "left")
    return out.select(
        *keep, F.col("n").cast("long").alias("n_shingles"),
        "group",
        F.when(F.col("group").isNull(), doc_id).otherwise(F.col("component")).alias("component_id"))


def _spread(inside: DataFrame, again: DataFrame, whole) -> DataFrame:
    """Columns of ``inside`` and the full sets ``s`` of its classes, from one document of each."""
    # a null rep (no id in the class) is found by its digest like any other
    reps = small(inside.select("rep"))
    found = again.join(reps, again["rep"].eqNullSafe(reps["rep"]), "left_semi").select("text")
    return found.mapInArrow(whole, "h1 long, h2 long, s array<long>").join(small(inside.drop("rep")), ["h1", "h2"])


def _own(chunks: str, *salt):
    return F.pmod(F.xxhash64("row", *map(F.lit, salt)), F.col(chunks)).cast("int")


def _joined(dealt: DataFrame, percent: int) -> DataFrame:
    dealt = dealt.select("block", "c1", "c2", "side", F.col("row").alias("node"), "s")
    spread = dealt.repartition("block", "c1", "c2").sortWithinPartitions("block", "c1", "c2", "side", "node")
    return spread.mapInArrow(join_chunks(percent), "a long, b long")


def _linked(blocks: DataFrame, classes: DataFrame, score: DataFrame, again: DataFrame, whole, percent: int, chunk: int) -> DataFrame:
    """``node, root`` of the classes that have links."""
    inside = blocks.withColumnsRenamed({"node": "row", "root": "block"}).join(classes.drop("copies"), "row")
    chunks = inside.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(chunk)).cast("int").alias("chunks"))
    inside = stored(inside.join(chunks, "block").select("row", "block", "h1", "h2", "rep", "n", "chunks"), "inside")
    several = not inside.where("chunks > 1").isEmpty()
    led = inside.withColumn("lead", F.lit(False))
    if several:
        best = Window.partitionBy("block").orderBy(F.desc("score"), "row")
        lead = inside.where("chunks > 1").join(score, "row", "left").na.fill(0, ["score"])
        lead = lead.select("row", F.row_number().over(best).alias("k"), F.sum("n").over(best).alias("upto"))
        lead = stored(lead.where((F.col("k") == 1) | (F.col("upto") * LEAD <= chunk)).select("row", F.lit(True).alias("lead")), "leaders")
        led = inside.join(small(lead), "row", "left")
    to = F.when(F.col("lead"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(_own("chunks")))
    sets = _spread(led, again, whole).withColumn("c1", F.explode(to))
    roots = components(_joined(sets.withColumns({"c2": F.col("c1"), "side": F.lit(0)}), percent))
    if not several:
        return roots

    # strays: not in the largest component of their block
    large = inside.where("chunks > 1").join(roots, F.col("row") == F.col("node"), "left").withColumn("part", F.coalesce("root", "row"))
    large = stored(large.drop("node", "root"), "large")
    main = large.groupBy("block", "part").agg(F.sum("n").alias("m")).groupBy("block").agg(F.max(F.struct("m", "part")).alias("main"))
    large = large.join(main, "block").withColumn("stray", F.col("part") != F.col("main.part"))
    pieces = large.where("stray").groupBy("block").agg(F.ceil(F.sum("n") / F.lit(chunk)).cast("int").alias("pieces"))
    large = stored(large.join(pieces, "block").select("row", "block", "h1", "h2", "rep", "chunks", "stray", "pieces"), "strays")
    if large.isEmpty():
        return roots
    sets = _spread(large, again, whole)
    every, piece, side = F.struct(F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("side")), _own("pieces", 1), {}
    side[0] = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: every.withField("c1", _own("chunks")).withField("c2", i))
    side[1] = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: every.withField("c1", i).withField("c2", piece).withField("side", F.lit(1)))
    sets = sets.withColumn("to", F.explode(F.when(F.col("stray"), F.concat(side[0], side[1])).otherwise(side[0])))
    links = _joined(sets.select("block", "row", "s", "to.*"), percent)
    return components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _named(base: DataFrame, again: DataFrame, whole, percent: int, chunk: int) -> DataFrame:
    """``h1, h2, group, component`` of the sets that more than one document has or that have links.
    ``base`` is that of ``_base``, ``again`` has the documents' ``rep`` (id) and ``text``."""
    classes = base.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.min("row").alias("row"))
    classes = stored(classes, "classes")
    tied, score = ties(base, classes, percent)
    roots = _linked(components(tied), classes, score, again, whole, percent, chunk)

    # component of every class that has company: others are components of their own
    named = classes.select("h1", "h2", "rep", "copies", "row").join(roots, F.col("row") == F.col("node"), "left")
    named = named.select("h1", "h2", "rep", "copies", F.coalesce("root", "row").alias("group"), F.col("root").isNotNull().alias("linked"))
    named = named.where("linked OR copies > 1")
    ids = named.groupBy("group").agg(F.min("rep").alias("component"))
    return stored(named.join(ids, "group").select("h1", "h2", "group", "component"), "components")


def report(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document. The digests of all sets are stored,
    so that no second pass over the texts makes them."""
    d, doc_id, text = _plain(columns(docs, "doc_id", "text"))
    digest, whole = _functions(docs, n, percent)
    base = _base(d, doc_id, text, digest)
    named = _named(base, d.select(doc_id.alias("rep"), text.alias("text")), whole, percent, CHUNK)
    out = _labelled(base.select("doc_id", "n", "h1", "h2"), ["doc_id"], F.col("doc_id"), named)
    return out.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component (the least id) and all empty ones. Of several
    rows with that id the one whose text, then whose other columns, have the least digest stays,
    however the rows are partitioned."""
    have = docs.columns
    d = label(docs, n, percent)
    pos = position(have, "doc_id")
    doc_id = F.lit(None).cast("long") if pos is None else F.col(f"_{pos}")
    d = d.where(F.col("group").isNull() | doc_id.eqNullSafe(F.col("component_id")))
    # repeated rows of that id: one of them; documents alone in their component are not moved
    alone, rest = d.where(F.col("group").isNull()), d.where(F.col("group").isNotNull())
    at = position(have, "text")
    text = F.lit(None).cast("string") if at is None else F.col(f"_{at}").cast("string")
    plain = [f"_{i}" for i in range(len(have)) if "map<" not in d.schema[f"_{i}"].dataType.simpleString()]   # maps have no hash
    order = (doc_id, F.xxhash64(text), text, F.xxhash64(*plain))
    rest = rest.withColumn("_rn", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where("_rn = 1").drop("_rn")
    return alone.unionByName(rest).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(have)])
