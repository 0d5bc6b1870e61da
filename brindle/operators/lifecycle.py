"""Where hypotheses stand: moves between states in an append-only log, judged as sets and committed by one writer at a time.

A log is a folder: batches of moves under ``data``, each written whole before anyone can see it, and ``commits``, numbered files
that name a batch. A batch counts once its commit is there. A writer judges its moves against the commits it has read and then
creates the next number; the file system lets one writer create a file, so of two writers that read the same state one wins and
the other is told to read again. Nothing is ever changed or removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRANSITIONS = "seq long, pos int, ts timestamp, hypothesis_id string, from_state string, to_state string, run_id string, detail string"
# The states in the order of a life, and what a finished one may be said to be.
STATES = ("pending", "running", "done")
#: A move leads to any other state; going back is a move like others and stays in the log.
MOVES = tuple((a, b) for a in STATES for b in STATES if a != b)


def latest(log: DataFrame) -> DataFrame:
    """(hypothesis_id, state, seq, pos, moves): where each hypothesis of the log stands, by its last move."""
    last = F.struct("seq", "pos", "to_state")
    return log.groupBy("hypothesis_id").agg(F.max(last).alias("l"), F.count("*").alias("moves")).select("hypothesis_id", F.col("l.to_state").alias("state"), F.col("l.seq").alias("seq"), F.col("l.pos").alias("pos"), "moves")


def latest_at(log: DataFrame, as_of: DataFrame) -> DataFrame:
    """(hypothesis_id, as_of, state): where each hypothesis stood at each of ``as_of`` (as_of), a report's few dates; no row before its first move."""
    asked = log.select("hypothesis_id").distinct().crossJoin(F.broadcast(as_of.select("as_of").distinct()))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = log.select("hypothesis_id", F.col("ts").alias("_at"), F.lit(0).alias("_k"), "seq", "pos", "to_state", none("as_of", "timestamp"))
    both = both.unionByName(asked.select("hypothesis_id", F.col("as_of").cast("timestamp").alias("_at"), F.lit(1).alias("_k"), none("seq", "long"), none("pos", "int"), none("to_state", "string"), F.col("as_of").cast("timestamp").alias("as_of")))
    w = Window.partitionBy("hypothesis_id").orderBy("_at", "_k", "seq", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("state", F.last("to_state", True).over(w)).where("as_of is not null and state is not null").select("hypothesis_id", "as_of", "state")


def judged(batch: DataFrame, log: DataFrame, moves: tuple[tuple[str, str], ...] = MOVES, start: str = STATES[0]) -> DataFrame:
    """``batch`` (pos, hypothesis_id, from_state, to_state, ...) with ``stood``, where the hypothesis stands before the move, and ``fault``, null for a legal one.

    Moves of a hypothesis follow one another by ``pos``; a hypothesis without any stands at ``start``. A fault: an unknown state, a
    move out of a state in which it does not stand, a move to where it stands, one that ``moves`` does not have, or two of one pos.
    """
    spark = batch.sparkSession
    order = Window.partitionBy("hypothesis_id").orderBy("pos")
    states = {s for m in moves for s in m} | {start}
    legal = spark.createDataFrame(list(moves), "from_state string, to_state string").withColumn("legal", F.lit(True))
    now = latest(log).select("hypothesis_id", F.col("state").alias("_state"))
    rows = batch.withColumn("_before", F.lag("to_state").over(order)).withColumn("_same", F.count("*").over(Window.partitionBy("hypothesis_id", "pos")))
    rows = rows.join(now, "hypothesis_id", "left").join(F.broadcast(legal), ["from_state", "to_state"], "left")  # a handful of moves
    stood = F.coalesce("_before", "_state", F.lit(start))
    known = F.col("from_state").isin(*states) & F.col("to_state").isin(*states)
    fault = (
        F.when(F.col("hypothesis_id").isNull() | F.col("pos").isNull(), "no hypothesis or position")
        .when(F.col("_same") > 1, "two moves at one position")
        .when(~F.coalesce(known, F.lit(False)), "unknown state")
        .when(F.col("from_state") == F.col("to_state"), "no move")
        .when(F.col("from_state") != stood, "does not stand there")
        .when(F.col("legal").isNull(), "move not allowed")
    )
    return rows.select(*[F.col(c) for c in batch.columns], stood.alias("stood"), fault.alias("fault"))


class Refused(ValueError):
    """A batch with a fault; nothing of it was written."""


class Overtaken(RuntimeError):
    """Another writer committed first; read again and judge anew."""


class TransitionLog:
    """A log of moves in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, moves: tuple[tuple[str, str], ...] = MOVES, start: str = STATES[0]):
        self.spark, self.folder, self.moves, self.start = spark, folder.rstrip("/"), moves, start
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The number of the last commit; 0 for an empty log."""
        at = self._path("commits")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def rows(self, version: int | None = None) -> DataFrame:
        """All moves committed up to ``version`` (the last by default), with their commit as ``seq``."""
        upto = self.version() if version is None else version
        if not upto:
            return self.spark.createDataFrame([], TRANSITIONS)
        commits = self.spark.read.text([f"{self.folder}/commits/{i}" for i in range(1, upto + 1)])
        names = [r[0] for r in commits.collect()]  # one line a commit
        data = self.spark.read.schema(TRANSITIONS).parquet(*[f"{self.folder}/data/{n}" for n in names])
        return data.where(F.col("seq") <= upto)

    def record(self, batch: DataFrame, read_at: int | None = None) -> int:
        """Commit ``batch`` (pos, ts, hypothesis_id, from_state, to_state, run_id, detail) whole and return its number.

        ``read_at``: the version that the caller decided on, by default the last one. A batch with a fault is Refused whole; one
        judged on a version that is no longer the last is Overtaken. An empty batch commits nothing.
        """
        base = self.version() if read_at is None else read_at
        columns = [c.split()[0] for c in TRANSITIONS.split(", ")[1:]]
        name = uuid.uuid4().hex
        rows = batch.select(*columns)
        bad = judged(rows, self.rows(base), self.moves, self.start).where("fault is not null").orderBy("hypothesis_id", "pos").first()
        if bad is not None:
            raise Refused(f"{bad['hypothesis_id']}: {bad['from_state']} to {bad['to_state']}: {bad['fault']}, it stands at {bad['stood']}")
        if rows.isEmpty():
            return base
        rows.select(F.lit(base + 1).cast("long").alias("seq"), F.col("pos").cast("int").alias("pos"), *columns[1:]).write.parquet(f"{self.folder}/data/{name}")
        self._claim(base + 1, name)
        return base + 1

    def _claim(self, number: int, name: str) -> None:
        """Create the commit, which fails if it is there: the name is written aside first and moved into place, so no reader sees half of it."""
        if self.version() >= number:
            raise Overtaken(f"commit {number} is another writer's")
        aside, at = self._path(f"aside/{name}"), self._path(f"commits/{number}")
        out = self._fs.create(aside, False)
        out.write(bytearray(name + "\n", "ascii"))
        out.close()
        self._fs.mkdirs(at.getParent())
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(aside, at, none)  # without the option to overwrite
        except Exception as e:  # noqa: BLE001 - py4j wraps all; only one cause means that another writer won
            if "FileAlreadyExists" in str(e):
                raise Overtaken(f"commit {number} is another writer's") from e
            raise


def verdict_detail(detail: str, verdict: str, power: float | None = None) -> str:
    """The detail of a move to the last state that carries a verdict; power that is not known is null, not a guess."""
    said = "null" if power is None else f"{power:.3f}"
    return f"{detail} verdict: {verdict}; power_at_nearest_ic: {said}".strip()


def counts(log: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """(state, hypotheses) of where the log's hypotheses stand, zero for a state that none is in."""
    spark = log.sparkSession
    all_ = spark.createDataFrame([(s,) for s in states], "state string")
    n = latest(log).groupBy("state").agg(F.count("*").alias("n"))
    return all_.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("hypotheses"))
