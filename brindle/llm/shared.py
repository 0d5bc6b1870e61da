"""What several operators share: lineage cuts in the shared folder, joins that survive hot keys, bounded collects."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows a side may hold to be broadcast; beyond it the joins below salt the hot side instead.
BROADCAST_ROWS = 20_000


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Where that is unset, a temporary one if all runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/brindle-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of a batch that Python functions get at a time, where the session names no bound.
BATCH_BYTES = 16 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python functions get by bytes, as long texts would make batches of a number of rows very large.

    The session's own bound stays as it is; results do not depend on it.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


class Stash:
    """Tables written to the shared folder to cut lineage. A lost executor then costs only the tasks that read them.

    ``keep`` writes and rereads; ``drop`` removes a table that nothing will read any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/brindle-{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """``batch``: the rows that Python functions get at a time, where their number is to be smaller than the session's."""
        path = f"{self.base}/{name}"
        own = {_CLEANUP: "true"}  # the shuffles behind a written table are not needed again
        own |= {_BATCH: str(batch)} if batch else {}
        before = {k: self.spark.conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, key: str, by: str | None = None, how: str = "left", salts: int = 64, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` (one row a ``key``) to ``big`` (column ``by``, the same name by default) without moving hot keys to one task.

    ``small`` is broadcast if a check of its size allows it. Else big's rows of a key are spread over ``salts`` tasks and
    small's row is copied to each. Null keys match null keys. ``key`` is dropped.
    """
    other = small.withColumnRenamed(key, "_key")
    own = F.col(by or key)
    if fits(small, rows):
        return big.join(F.broadcast(other), own.eqNullSafe(F.col("_key")), how).drop("_key")
    spread = other.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return salted.join(spread, own.eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt_r")), how).drop("_key", "_salt", "_salt_r")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, so that no name can clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the smallest hashes of ``key``: the same on every run and layout.

    A first cut at twice the share wanted keeps what is sorted near the bound, however large the table.
    """
    total = df.count()
    code = F.xxhash64(F.lit(seed), F.col(key))
    cut = df if total <= 2 * rows else df.where(F.pmod(code, F.lit(1 << 30)) < int((1 << 30) * 2 * rows / total))
    return cut.orderBy(F.pmod(code, F.lit(1 << 30)), code, F.col(key)).limit(rows)


def unit(*cols: Column) -> Column:
    """A number in [0, 1) from the md5 of the columns, 52 bits of it, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
