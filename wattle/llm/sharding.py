"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source and ranked there; the rank divided
by the source's rows, from a phase of the source's own, is a fractional rank in (0, 1). Sorted
by it, every stretch of rows holds the sources in their proportions, so cutting the order into
equal stretches gives shards that match the mixture: row counts differ by one at most (the law
``rows``) and each source's count by a few.

Only narrow rows move (id, source, size, digest). Ranks and positions are sums over bins plus a
rank inside one bin: 4,096 bins of digests for each source and 4,096 bins of fractional ranks, so
a source with a third of all rows is spread over thousands of tasks, and nothing is ordered in
a single one. The phases spread sources of few rows evenly too.

Defined cases: a null text has size 1 and checksum 0, like an empty one; null sources form a
source of their own; equal rows (id, text and source) each have a place and are
interchangeable; rows of one id with different texts are ordered by their digest; an empty table
gives none. Columns are found by name, exact spelling first; ``shard`` and ``slot`` take over
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, position, stored

SHARDS = 8
#: bins of digests for each source (three hex digits) and of fractional ranks
BINS = 4096
#: phases of sources: five hex digits
PHASES = 16 ** 5


def _digest(seed: int, doc_id: Column, source: Column, size: Column, crc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), size, crc,
                             F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))))


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, text_crc32, key`` of every row."""
    d = columns(docs, "doc_id", "text", "source")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = d.select("doc_id", F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
                 F.crc32(text.cast("binary")).alias("text_crc32"))
    return d.withColumn("key", _digest(seed, *map(F.col, ("doc_id", "source", "size", "text_crc32"))))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of ``keyed`` with ``fraction``, the fractional rank in their source."""
    d = rows.withColumn("_bin", F.substring("key", 1, 3)).withColumn("_s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    counts = d.groupBy("_s", "_bin").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_s")
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_bin")) - F.col("_n")).withColumn("_rows", F.sum("_n").over(whole))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy("_s", "_bin").orderBy("key")))
    d = d.join(counts.drop("_n"), ["_s", "_bin"])
    phase = (F.conv(F.substring(F.md5("_s"), 1, 5), 16, 10).cast("double") + 0.5) / PHASES
    return d.withColumn("fraction", (F.col("_before") + F.col("_in") - 1 + phase) / F.col("_rows")).drop("_bin", "_in", "_before", "_rows")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, text_crc32, key, shard, slot`` of every row of ``docs``."""
    rows = stored(ranked(stored(keyed(docs, seed), "shard-keys")), "shard-ranks")
    rows = rows.withColumn("_bin", F.floor(F.col("fraction") * BINS).cast("int"))
    # at most BINS rows, so one small window and a broadcast
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    starts = counts.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_start"),
                           F.sum("_n").over(Window.partitionBy()).alias("_total"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_bin").orderBy("fraction", "_s", "key")))
    rows = rows.join(F.broadcast(starts), "_bin").withColumn("_at", F.col("_start") + F.col("_in") - 1)
    shard = F.expr(f"_at * {shards} div _total")
    rows = rows.withColumn("shard", shard.cast("int"))
    return rows.select("doc_id", "source", "size", "text_crc32", "key", "shard",
                       F.expr(f"_at - (shard * _total + {shards - 1}) div {shards}").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    have = docs.columns
    plan = assign(docs, shards, seed).select("key", "shard", "slot")
    copy = Window.partitionBy("_key")
    plan = plan.select(F.col("key").alias("_key"), "shard", "slot").withColumn("_copy", F.row_number().over(copy.orderBy("shard", "slot")))
    d = docs.toDF(*[f"_{i}" for i in range(len(have))])
    at = [F.lit(None).cast("string") if (i := position(have, n)) is None else F.col(f"_{i}") for n in ("doc_id", "source", "text")]
    text = F.coalesce(at[2].cast("string"), F.lit(""))
    d = d.withColumn("_key", _digest(seed, at[0], at[1], (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))))
    d = d.withColumn("_copy", F.row_number().over(copy.orderBy("_key")))
    out = [F.col(f"_{i}").alias(c) for i, c in enumerate(have) if c.lower() not in ("shard", "slot")]
    return d.join(plan, ["_key", "_copy"]).select(*out, "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """Parquet files under ``path/shard=N``, rows in the order of their slots."""
    d = shard(docs, shards, seed)
    d.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    return assign(docs, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
