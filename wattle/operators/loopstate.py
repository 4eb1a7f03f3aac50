"""Durable state of an iterative fit: one small table for each finished turn.

A turn of K-SC leaves K centroids for each K in work, so its state is a table of a few hundred
rows. It is written in the folder that the caller names, on the shared file system; the turn
counts once Spark has put its ``_SUCCESS`` mark there, and a turn cut short is passed over and
written again. A later run with the same settings goes on behind the last finished turn; other
settings are refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("k INT, role STRING, cid INT, n BIGINT, c ARRAY<DOUBLE>, iterations INT, converged BOOLEAN, squares DOUBLE, "
          "history ARRAY<STRUCT<turn: INT, moved: INT, total: DOUBLE>>")
MODEL, ASSIGNING, TURN = "model", "assigning", "turn"


def finished(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching ``pattern`` that hold a complete table or file set, in order."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = mark.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(mark) or []
    return sorted(f.getPath().getParent().toString() for f in found)


class LoopState:
    """The turns stored under ``path``; ``settings`` must equal those of earlier runs there."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path
        text = json.dumps(settings, sort_keys=True)
        if finished(spark, f"{path}/settings"):
            before = spark.read.text(f"{path}/settings").first()[0]
            if before != text:
                raise ValueError(f"{path} holds a fit with other settings: {before}")
        else:
            spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    def save(self, group: int, turn: int, fits: dict) -> None:
        """``fits`` (K -> FitResult) after ``turn`` passes of a group of Ks."""
        rows = []
        for k, f in fits.items():
            rows.append((k, TURN, None, None, None, f.iterations, f.converged, f.squares, f.history))
            for role, model in ((MODEL, f.model), (ASSIGNING, f.assigning_model)):
                rows += [(k, role, cid, n, c, None, None, None, None) for cid, (n, c) in model.items()]
        frame = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/group={group:06d}/turn={turn:06d}")

    def load(self, group: int, fits: dict) -> int:
        """Put the last finished turn of a group into ``fits``; the passes it took (0: none yet)."""
        turns = finished(self.spark, f"{self.path}/group={group:06d}/turn=*")
        if not turns:
            return 0
        rows = self.spark.read.schema(SCHEMA).parquet(turns[-1]).collect()   # two rows for each centroid
        models: dict = {}
        for r in rows:
            if r["role"] == TURN:
                f = fits[r["k"]]
                f.iterations, f.converged, f.squares = r["iterations"], r["converged"], r["squares"]
                f.history = [tuple(h) for h in r["history"]]
            else:
                models.setdefault((r["k"], r["role"]), {})[r["cid"]] = (r["n"], list(r["c"]))
        for k, f in fits.items():
            f.model, f.assigning_model = models.get((k, MODEL), {}), models.get((k, ASSIGNING), {})
        return int(turns[-1].rsplit("=", 1)[1])

    def once(self, path: str, write) -> None:
        """``write(path)`` unless an earlier run finished that output."""
        if not finished(self.spark, path):
            write(path)


def points_print(points: DataFrame) -> dict:
    """What a resumed fit must find again: number of points, and an order-free digest of them."""
    row = points.selectExpr("count(*) AS n", "sum(cast(xxhash64(meter_id, day, x) AS decimal(20, 0))) AS digest").first()
    return {"points": int(row["n"]), "digest": str(row["digest"])}
