"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: words of most contracts: runs of anything but space and \x09-\x0D
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text handed to Python at once; one worker holds a few batches of this size.
ARROW_BATCH_BYTES = 4 << 20


def columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` reduced to the named columns (null where it has none of that name).

    Columns are taken by position, an exact name before one that differs only in case, so
    extra columns whose names clash, or repeat, cannot make the choice ambiguous.
    """
    have = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(have))])

    def one(name):
        i = position(have, name)
        return (F.lit(None) if i is None else F.col(f"_{i}")).alias(name)

    return plain.select(*map(one, names))


def position(have: list[str], name: str) -> int | None:
    """Index of the column called ``name``: exact spelling first, then any case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(have):
            if same(c):
                return i
    return None


def with_value(df: DataFrame, needs: list[str], make, keep) -> DataFrame:
    """Filter or rewrite rows while keeping every column of ``df`` and its name.

    ``make(*columns)`` builds one value from the columns named in ``needs``; ``keep(value)``
    returns ``(condition, {name: new column})``. Names are resolved as in ``columns``.
    """
    have = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(have))])
    args = [F.col(f"_{i}") if (i := position(have, n)) is not None else F.lit(None) for n in needs]
    condition, new = keep(F.col("_value"))
    at = {position(have, n): c for n, c in new.items() if position(have, n) is not None}
    out = plain.withColumn("_value", make(*args)).where(condition)
    return out.select(*[at.get(i, F.col(f"_{i}")).alias(c) for i, c in enumerate(have)])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Bound the Arrow batches by bytes, unless the session already asks for less: ten
    thousand long texts in one batch would not fit beside the executor's heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and int(now) <= most):
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ids or small arrays that are broadcast at most; beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    Cuts the lineage like a checkpoint, compressed and by column: what is read later
    survives lost executors, and only the columns needed are read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, so cheap to count) marked for broadcast if it has at most ``rows``
    rows; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
