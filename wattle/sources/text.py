"""Readers and writers for the pipe/comma text formats of meter analytics.

Parquet is the primary storage; these exist to import and export the text formats:

  points     ``<meter><yyMMdd>|v1,v2,…``              (id = meter id followed by yyMMdd)
  centroids  ``cid|v1,…,v24``
  shares     ``cid|share%|v1,…,v24``
  tagged     ``cid|original v1,…|shifted v1,…``
  entropy    ``meter|entropy``
  elbow      ``K|Coverage|CH``
  profiles   ``meter|24 means|24 stddevs``
  temps      ``t|t|t…``  (first line only, cycled by the generator)
  weather    CSV ``meter,yyyy-MM-dd,hour,reading,temperature``

Writers fail if the target exists (``mode='errorifexists'``) unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nums(c) -> F.Column:
    return F.transform(F.split(c, ","), lambda v: v.cast("double"))


def _join_nums(c) -> F.Column:
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda v: v.cast("string")), ",")


def _fields(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    df = spark.read.text(path)
    if min_partitions:
        df = df.repartition(min_partitions)
    return df.select(F.split("value", r"\|").alias("f"))


# --------------------------------------------------------------------------- readers

def read_points(spark, path: str, min_partitions: int | None = None) -> DataFrame:
    """``meter_id BIGINT, day DATE, x ARRAY<DOUBLE>`` from ``<meter><yyMMdd>|v,…``."""
    return parse_points(_fields(spark, path, min_partitions))


def fields(lines: DataFrame) -> DataFrame:
    """``lines`` with ``value`` split at the bars into ``f``; other columns stay."""
    return lines.withColumn("f", F.split("value", r"\|")).drop("value")


def parse_points(f: DataFrame, *keep: str) -> DataFrame:
    """Points from split lines (``fields``), with the columns ``keep``."""
    pid = F.col("f")[0]
    n = F.length(pid)
    return f.select(
        *keep,
        F.substring(pid, 1, n - 6).cast("long").alias("meter_id"),
        F.to_date(F.substring(pid, n - 5, 6), "yyMMdd").alias("day"),
        _nums(F.col("f")[1]).alias("x"),
    )


def read_centroids(spark, path: str) -> DataFrame:
    """``cid INT, n BIGINT (=1), c ARRAY<DOUBLE>``."""
    f = _fields(spark, path)
    return f.select(F.col("f")[0].cast("int").alias("cid"), F.lit(1).cast("long").alias("n"),
                    _nums(F.col("f")[1]).alias("c"))


def read_shares(spark, path: str) -> DataFrame:
    return parse_shares(_fields(spark, path))


def parse_shares(f: DataFrame, *keep: str) -> DataFrame:
    return f.select(*keep, F.col("f")[0].cast("int").alias("cid"), F.col("f")[1].cast("double").alias("share"),
                    _nums(F.col("f")[2]).alias("c"))


def read_tagged(spark, path: str) -> DataFrame:
    return parse_tagged(_fields(spark, path))


def parse_tagged(f: DataFrame, *keep: str) -> DataFrame:
    return f.select(*keep, F.col("f")[0].cast("int").alias("cid"), _nums(F.col("f")[1]).alias("original"),
                    _nums(F.col("f")[2]).alias("shifted"))


def read_entropy(spark, path: str) -> DataFrame:
    return (spark.read.schema("meter_id BIGINT, entropy DOUBLE").option("sep", "|").csv(path))


def read_elbow(spark, path: str) -> DataFrame:
    return (spark.read.schema("k INT, coverage DOUBLE, ch DOUBLE").option("sep", "|").csv(path))


def read_profiles(spark, path: str) -> DataFrame:
    """``meter_id BIGINT, mean ARRAY<DOUBLE>, sd ARRAY<DOUBLE>``."""
    f = _fields(spark, path)
    return f.select(F.col("f")[0].cast("long").alias("meter_id"), _nums(F.col("f")[1]).alias("mean"),
                    _nums(F.col("f")[2]).alias("sd"))


def profiles_long(profiles: DataFrame) -> DataFrame:
    """``meter_id, hour, mean, sd`` from the array form."""
    z = F.arrays_zip("mean", "sd")
    return profiles.select("meter_id", F.posexplode(z).alias("hour", "_p")).select(
        "meter_id", F.col("hour").cast("int"), F.col("_p.mean").alias("mean"), F.col("_p.sd").alias("sd"))


def read_temperature_seed(spark, path: str) -> DataFrame:
    """``pos BIGINT, temperature DOUBLE`` from the first line of the first seed file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"))
    first = lines.orderBy("_f", "_b", "_i").limit(1)   # a top-1, not a sort
    return first.select(F.posexplode(F.split("value", r"\|")).alias("pos", "_t")).select(
        F.col("pos").cast("long"), F.col("_t").cast("double").alias("temperature"))


WEATHER_SCHEMA = T.StructType([
    T.StructField("meter_id", T.LongType()),
    T.StructField("read_date", T.DateType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("reading", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
])


def read_weather(spark, path: str) -> DataFrame:
    """Weather-joined readings CSV; malformed rows are dropped."""
    return (spark.read.schema(WEATHER_SCHEMA).option("mode", "DROPMALFORMED").option("dateFormat", "yyyy-MM-dd")
            .csv(path))


def read_raw_lines(spark, path: str) -> DataFrame:
    """Raw reading lines (``line``) for ``prepare.ingest_lines``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


# --------------------------------------------------------------------------- writers

def _write(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).text(path)


def points_lines(points: DataFrame) -> DataFrame:
    pid = F.concat(F.col("meter_id").cast("string"), F.date_format("day", "yyMMdd"))
    return points.select(F.concat_ws("|", pid, _join_nums("x")).alias("value"))


def write_points(points: DataFrame, path: str, mode: str = "errorifexists", sort: bool = False) -> None:
    """``sort=True`` writes the points globally ordered by (meter, day) (range-partitioned sort)."""
    df = points.orderBy("meter_id", "day") if sort else points
    _write(points_lines(df), path, mode)


def write_centroids(centroids: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(centroids.orderBy("cid").select(
        F.concat_ws("|", F.col("cid").cast("string"), _join_nums("c")).alias("value")).coalesce(1), path, mode)


def write_shares(shares: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(shares.orderBy("cid").select(F.concat_ws(
        "|", F.col("cid").cast("string"), F.col("share").cast("string"), _join_nums("c")).alias("value")).coalesce(1),
        path, mode)


def write_tagged(tagged: DataFrame, path: str, mode: str = "errorifexists", sort: bool = False) -> None:
    df = tagged.orderBy("cid", "meter_id", "day") if sort else tagged
    _write(df.select(F.concat_ws("|", F.col("cid").cast("string"), _join_nums("original"),
                                 _join_nums("shifted")).alias("value")), path, mode)


def write_entropy(entropy: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(entropy.select(F.concat_ws("|", F.col("meter_id").cast("string"),
                                      F.col("entropy").cast("string")).alias("value")), path, mode)


def write_elbow(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(table.orderBy("k").select(F.concat_ws("|", F.col("k").cast("string"), F.col("coverage").cast("string"),
                                                 F.col("ch").cast("string")).alias("value")).coalesce(1), path, mode)


def write_profiles(profiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(profiles.select(F.concat_ws("|", F.col("meter_id").cast("string"), _join_nums("mean"),
                                       _join_nums("sd")).alias("value")), path, mode)


def write_weather(weather: DataFrame, path: str, mode: str = "errorifexists") -> None:
    weather.select("meter_id", F.date_format("read_date", "yyyy-MM-dd").alias("read_date"), "hour", "reading",
                   "temperature").write.mode(mode).csv(path)
