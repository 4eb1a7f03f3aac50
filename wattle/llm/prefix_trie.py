"""Conversation prefix trie by whole-sequence collapse.

Identical rebuilt conversations collapse into one sequence with a weight and the list of those
that end there; sequences that are proper prefixes of another drop out by an anti-join, which
leaves the leaves; the prefixes of the distinct sequences are then added up with their weights.
A node is a prefix, known by its depth and a 128-bit digest of its turns.

Texts never move: a turn is its digest and its number of words. Digests of prefixes are running
exclusive ors of the turns' position-salted hashes, so they, like positions and running word counts, are
sums over segments of ``SEGMENT`` turns plus a running sum within one segment. A conversation of any
length is spread over tasks, and a long one costs its length, never its square: what a subtree
saves is added up from suffix sums of its sequences. A node counts once in a subtree: it is owned by
the sequence of its smallest member, whose owned nodes are a suffix of its path.

Defined cases: rows without conv_id are left out; null turns come first; turns of equal number
are ordered by their digest; null role or text is empty; conversations without turns end at the
root; an empty table has no node, not even a root. Columns are found by name, exact spelling first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, n_words, stored

#: conversations that share their first turns: those of one block of ids
BLOCK = 20
#: shared first turns: checksum of the id modulo this
HEADS = 4
#: turns that are ordered in one task
SEGMENT = 1024
#: conversation ids (a range of so many) that are joined into one piece of an end list
PIECE = 4096
#: children from which on a node's children find it by broadcast; at most ``HOT_NODES`` such nodes
HOT, HOT_NODES = 1000, 1_000_000


def turn_digest(role, text):
    """16 bytes for role and text, null as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: ``conv_id`` of each, and their turns ``conv_id, pos, t, w``
    (position from 1, digest, words)."""
    d = columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    d = d.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                 turn_digest(F.col("role"), F.col("text")).alias("t"), n_words(F.col("text").cast("string")).alias("w"))
    # null turns are a segment before all others
    d = d.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))))
    d = stored(d, "trie-turns")
    segments = d.groupBy("conv_id", "seg").agg(F.count("*").alias("n"))
    convs = segments.groupBy("conv_id").agg(F.sum("n").alias("n_turns")).withColumns({
        "base": F.expr(f"conv_id - conv_id % {BLOCK}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "k"), "trie-conversations")

    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("seg")) - F.col("n")
    segments = segments.withColumn("before", before).drop("n").join(convs.select("conv_id", "h", "k"), "conv_id")
    order = Window.partitionBy("conv_id", "seg").orderBy("turn", "t")
    d = d.withColumn("at", F.row_number().over(order)).join(segments, ["conv_id", "seg"])
    d = stored(d.select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "h", "k", "t", "w"), "trie-positions")
    own = d.where("pos > h").select("conv_id", F.expr("pos - h + k").alias("pos"), "t", "w")
    heads = d.where(f"conv_id % {BLOCK} = 0 AND pos < {HEADS}").select(F.col("conv_id").alias("base"), "pos", "t", "w")
    heads = convs.where("k > 0").join(heads, "base").where("pos <= k").select("conv_id", "pos", "t", "w")
    return convs.select("conv_id"), stored(own.union(heads), "trie-rebuilt")


def _joined(rows):
    """SHA-256 of the pieces of each list, which come in order, fed piece by piece."""
    import pyarrow as pa

    now, digest = None, None

    def out(keys):
        return pa.RecordBatch.from_pylist(keys, pa.schema([("first", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in rows:
        done = []
        for first, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if first != now:
                if now is not None:
                    done.append({"first": now, "ends_sha256": digest.hexdigest()})
                now, digest = first, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield out(done)
    if now is not None:
        yield out([{"first": now, "ends_sha256": digest.hexdigest()}])


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct sequences: ``first`` (their smallest conversation), ``x, y`` (digest),
    ``depth, n`` (conversations) and ``ends_sha256`` of their sorted ids."""
    whole = turns.groupBy("conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("depth"))
    whole = stored(convs.join(whole, "conv_id", "left").na.fill(0), "trie-whole")
    key = ["x", "y", "depth"]
    found = whole.groupBy(*key).agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    pieces = whole.groupBy(*key, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    pieces = pieces.join(found, key).select("first", "piece", "ids").repartition("first").sortWithinPartitions("first", "piece")
    ends = pieces.select("first", "ids").mapInArrow(_joined, "first long, ends_sha256 string")
    return stored(found.join(ends, "first"), "trie-sequences")


def prefixes(found: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence: ``conv_id, seg, depth, x, y, px, py`` (digests of
    the prefix and of the one before), ``w`` and ``before`` (words of its last turn, and of those before)."""
    span = turns.groupBy("conv_id", "seg").agg(F.bit_xor("x").alias("ox"), F.bit_xor("y").alias("oy"), F.sum("w").alias("ow"))
    span = span.join(found.select(F.col("first").alias("conv_id")), "conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    span = span.select("conv_id", "seg", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "ox"), (F.bit_xor, "oy"), (F.sum, "ow"))])
    running = Window.partitionBy("conv_id", "seg").orderBy("depth")
    d = turns.join(span, ["conv_id", "seg"]).withColumns({
        "rx": F.bit_xor("x").over(running), "ry": F.bit_xor("y").over(running), "rw": F.sum("w").over(running)})
    x, y = [F.col(o).bitwiseXOR(F.col(r)) for o, r in (("ox", "rx"), ("oy", "ry"))]
    d = d.select("conv_id", "seg", "depth", x.alias("_x"), y.alias("_y"), x.bitwiseXOR(F.col("x")).alias("px"), y.bitwiseXOR(F.col("y")).alias("py"),
                 "w", (F.col("ow") + F.col("rw") - F.col("w")).alias("before"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("seg", "depth", "x", "y", "px", "py", "w", "before")]
    root = found.select(F.col("first").alias("conv_id"), *zero)
    return stored(d.withColumnsRenamed({"_x": "x", "_y": "y"}).unionByName(root), "trie-prefixes")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of
    every node, for conversations given as in ``rebuild``."""
    salted = [F.col("pos"), F.col("t")]
    turns = turns.select("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg"), F.col("pos").alias("depth"), "w",
                         F.xxhash64(*salted).alias("x"), F.xxhash64(*reversed(salted), F.lit(1)).alias("y"))
    found = sequences(convs, turns)
    paths = prefixes(found, turns)
    key = ["x", "y", "depth"]

    # each node's owner, and from which depth on a sequence owns its path
    owners = paths.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.min("before").alias("before"))
    owned = owners.groupBy("owner").agg(F.min(F.struct("depth", "before")).alias("o"))
    # a sequence that ends where another goes on is no leaf
    ends = paths.groupBy("conv_id", "seg").agg(F.max("depth").alias("last"), F.max(F.col("before") + F.col("w")).alias("words"))
    total = ends.groupBy("conv_id").agg(F.max("words").alias("words"))
    proper = paths.where("depth > 0").select(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).distinct()
    leaves = found.join(proper, key, "left_anti").select("first", F.lit(1).alias("leaf"))
    weight = found.select("first", "n").join(leaves, "first", "left").na.fill(0).withColumnRenamed("first", "conv_id")
    # (a sequence may own none: one that ends on another's path)
    weight = weight.join(total, "conv_id").join(owned.withColumnRenamed("owner", "conv_id"), "conv_id", "left")
    weight = ends.select("conv_id", "seg").join(weight, "conv_id").select(
        "conv_id", "seg", "n", "leaf", "words", F.col("o.depth").alias("own"), F.coalesce("o.before", "words").alias("own_before"))

    # what the members' turns from the node on hold, less every distinct node's once
    d = paths.join(weight, ["conv_id", "seg"])
    owned_words = F.col("words") - F.when(F.col("depth") >= F.col("own"), F.col("before")).otherwise(F.col("own_before"))
    nodes = d.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"),
        F.sum(F.col("n") * (F.col("words") - F.col("before")) - owned_words).alias("saved_tokens"),
        F.min("px").alias("px"), F.min("py").alias("py"))
    nodes = stored(nodes.join(found.select(*key, "ends_sha256"), key, "left"), "trie-nodes")

    children = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, key, "left").na.fill({"n_children": 0}), "trie-children")
    hot = max(HOT, nodes.count() // HOT_NODES)
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"), "n_children")
    up = ["px", "py", "depth"]
    busy = F.broadcast(above.where(F.col("n_children") >= hot).drop("n_children"))
    rest = above.where((F.col("n_children") > 0) & (F.col("n_children") < hot)).drop("n_children")
    root = nodes.where("depth = 0").withColumn("above", F.lit(None).cast("long"))
    nodes = nodes.where("depth > 0")
    found = root.unionByName(nodes.join(busy, up)).unionByName(nodes.join(busy, up, "left_anti").join(rest, up))
    return found.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def with_turns(nodes: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` of ``trie(*rebuild(conversations))`` with ``role`` and ``text`` of their last turn; the
    root has none. ``turns`` are those of ``rebuild``."""
    d = columns(conversations, "role", "text")
    d = d.select(turn_digest(F.col("role"), F.col("text")).alias("t"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    at = turns.select("conv_id", F.col("pos").alias("depth"), "t")
    return nodes.join(at, ["conv_id", "depth"], "left").join(d.dropDuplicates(["t"]), "t", "left").drop("t")


def report(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie(*rebuild(conversations))
