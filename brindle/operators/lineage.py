"""Cutting lineage in loops: a round's table is written to the shared folder and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/brindle-checkpoints"
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/brindle-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that Python functions get at a time, where the session names no bound.
BATCH_BYTES = 16 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches of packed rows by bytes, as some thousands of them would be large. The session's own bound stays as it is."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Pairs (a, b) reachable over edges (a, b) from ``start``: each round joins only the pairs that are new."""
    step = edges.select(edges["a"].alias("b"), edges["b"].alias("c"))
    seen = fresh = cut(start.select("a", "b").distinct())
    while True:
        ahead = fresh.join(step, "b").selectExpr("a", "c as b").distinct()
        fresh = cut(ahead.join(seen, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
