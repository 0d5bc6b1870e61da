"""An append-only experiment store on plain Parquet: runs, metrics (name, value), verdicts and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id string, ts timestamp, hypothesis_id string, family string, aggregation string, params_version string, params_hash string, data_snapshot_hash string, seed int, status string, killed_by string, cost_tokens long, cost_usd double"
METRICS = "run_id string, name string, value double"
VERDICTS = "run_id string, veto string, passed boolean, detail string"


class Store:
    """Tables under one folder; rows are only ever added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(name)) if self._there(name) else self.spark.createDataFrame([], schema)

    def record_runs(self, runs: DataFrame) -> None:
        """Add runs; an id that is there already, or twice in ``runs``, is refused and nothing is written."""
        known = self.table("runs", RUNS).select("run_id")
        twice = runs.groupBy("run_id").count().where("count > 1").select("run_id")
        again = runs.select("run_id").join(known, "run_id", "left_semi").unionByName(twice)
        if not again.isEmpty():
            raise ValueError(f"run recorded before: {again.first()[0]}")
        runs.write.mode("append").parquet(self._path("runs"))

    def _of_runs(self, rows: DataFrame, name: str) -> None:
        orphans = rows.select("run_id").distinct().join(self.table("runs", RUNS), "run_id", "left_anti")
        if not orphans.isEmpty():
            raise ValueError(f"no such run: {orphans.first()[0]}")
        rows.write.mode("append").parquet(self._path(name))

    def record_metrics(self, metrics: DataFrame) -> None:
        self._of_runs(metrics, "metrics")

    def record_verdicts(self, verdicts: DataFrame) -> None:
        self._of_runs(verdicts, "verdicts")

    def write_artifact(self, name: str, rows: DataFrame) -> None:
        """Rows with a run_id, kept by run so that reading one run's reads no other's."""
        rows.write.mode("append").partitionBy("run_id").parquet(self._path(f"artifacts/{name}"))

    def artifact(self, name: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._path(f"artifacts/{name}")).where(F.col("run_id") == run_id)

    def overview(self, names: list[str]) -> DataFrame:
        return overview(self.table("runs", RUNS), self.table("metrics", METRICS), self.table("verdicts", VERDICTS), names)


def freeze(tables: dict[str, DataFrame], folder: str) -> dict[str, tuple[int, int]]:
    """Write tables as a snapshot that must not exist yet; (rows, content hash) of each, the same for any order of rows."""
    out = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        out[name] = content_hash(df.sparkSession.read.parquet(f"{folder}/{name}"))
    return out


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum of row hashes: independent of order and layout, counts repeats."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def verify(spark: SparkSession, folder: str, manifest: dict[str, tuple[int, int]]) -> list[str]:
    """Names of the tables whose content is not what the manifest says."""
    return [name for name, known in manifest.items() if content_hash(spark.read.parquet(f"{folder}/{name}")) != tuple(known)]


def overview(runs: DataFrame, metrics: DataFrame, verdicts: DataFrame, names: list[str]) -> DataFrame:
    """Runs with one column for each named metric, a map of verdicts, and whether there are verdicts and all passed."""
    wide = metrics.groupBy("run_id").pivot("name", names).agg(F.max("value"))
    judged = verdicts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("veto", "passed")))).alias("verdicts"), F.bool_and("passed").alias("passed"))
    return runs.join(wide, "run_id", "left").join(judged, "run_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def leaderboard(overview: DataFrame, by: str) -> DataFrame:
    """Passed runs first, then the metric from the top, missing last, ties by time and id."""
    return overview.orderBy(F.desc("passed"), F.desc_nulls_last(by), "ts", "run_id")


def excess_over_baseline(live: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` less that of the baseline with the same keys (null keys match); the first baseline of a key counts; none gives null."""
    w = Window.partitionBy(*keys).orderBy("ts", "run_id")
    one = baseline.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_base"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return live.join(one, on, "left").withColumn("excess", F.col(value) - F.col("_base")).drop("_base", *[f"_{k}" for k in keys])


def first_failures(verdicts: DataFrame) -> DataFrame:
    """Per run the first veto, in configured order, that did not pass."""
    return verdicts.where("not passed").groupBy("run_id").agg(F.min_by("veto", "ord").alias("veto"))


def differences(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys in both, added and removed, how many values differ (null equals null) and by how much at most."""
    a, b = old.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_old")), new.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_new"))
    j = a.join(b, keys, "full")
    both = F.col("_old") & F.col("_new")
    return j.agg(F.count_if(both).alias("both"), F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new").isNull()).alias("removed"), F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.max(F.when(both, F.abs(F.col("_a") - F.col("_b")))).alias("widest"))
