"""Global row numbers: the order of a table or of a set of text files as a column.

A position is the number of rows before a row. It is found without a window over all rows:
the rows of a partition (or of a block of a file) are counted, running sums of the counts give each
its offset, and a row's place inside comes from the scan or the sort itself. The running sum
sees one row for each partition or block, never the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable

#: low bits of ``monotonically_increasing_id``: the row inside its partition
ROW_BITS = 33


def _placed(df: DataFrame, part: list[str], order: list, name: str) -> DataFrame:
    """``df`` with ``_i`` (increasing inside each ``part``, without gaps) turned into the global
    position ``name``; ``order`` sorts the parts."""
    parts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows"), F.min("_i").alias("_first"))
    # a row for each partition or block of the input
    before = F.coalesce(F.sum("_rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*part, (before - F.col("_first")).alias("_shift"))
    return df.join(parts, part).withColumn(name, F.col("_i") + F.col("_shift")).drop(*part, "_i", "_shift")


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with its position (from 0) in the order of the given columns; ties are broken by
    all other columns that can be ordered, so only rows equal in all of them are interchangeable.

    A range-partitioned sort, kept as a checkpoint: the bounds of the ranges come from a sample, so
    counting one run and numbering another would not agree.
    """
    rest = [c for c, kind in df.dtypes if c not in order and "map<" not in kind]
    keys = [*order, *rest]
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    d = reliable(d.withColumns({"_part": F.shiftright("_id", ROW_BITS), "_i": F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("_id"))
    return _placed(d, ["_part"], ["_part"], name)


def numbered_lines(spark, path: str, name: str = "pos") -> DataFrame:
    """``pos, value``: the lines of a set of text files with their position, files in the order of
    their part numbers (then of their names) and lines in the order of their file.

    A line's place is the block of the file that it starts in and its row there; the lines are kept as
    a checkpoint, so that both are of one scan.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_i"))
    part = F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1)
    order = [F.when(part != "", part.cast("long")), F.col("_file"), F.col("_start")]
    return _placed(reliable(lines), ["_file", "_start"], order, name).select(name, "value")
