"""Files to long tables: wide grids, side-by-side blocks, vendor pulls. Unknown or doubled columns are refused, not repaired."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_missing
from . import hosted, synthetic

MANIFEST = "file string, sheet string, layout string, field string, currency string, role string, header_rows int, first_data_row int"
QDF = ("real_date", "cid", "xcat", "value", "grading", "eop_lag")


@dataclass(frozen=True)
class Source:
    """What every source offers: readers of levels, of analytics by field and of vintages; None where it has none."""

    levels: Callable[..., DataFrame]
    analytics: Callable[..., DataFrame] | None = None
    vintages: Callable[..., DataFrame] | None = None


def loader(name: str) -> Source:
    """A named source; an unknown name is refused."""
    known = {"synthetic": Source(synthetic.levels, synthetic.analytics, synthetic.vintages), "hosted": Source(hosted.levels, None, hosted.vintages), "wide": Source(wide_csv), "local": Source(local_csv), "blocks": Source(blocks_csv), "vendor": Source(wide_csv, None, vintage_frame)}
    if name not in known:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def source(name: str) -> Callable[..., DataFrame]:
    """The levels reader of a named source."""
    return loader(name).levels


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").csv(path, header=True)


def wide_csv(spark: SparkSession, path: str, currencies: tuple[str, ...] | None = None) -> DataFrame:
    """A grid of dates by series, header in the first line, as (series_id, date, level), markers to null.

    With ``currencies`` each column must be ``<id>_local_<CCY>`` with a known currency, and its id is what stands before.
    """
    raw = spark.read.csv(path, header=True)
    names = spark.read.text(path).first()[0].split(",")[1:]
    if len(set(names)) < len(names):
        raise ValueError(f"doubled columns: {sorted({n for n in names if names.count(n) > 1})}")
    ids = {}
    for n in names:
        m = re.fullmatch(r"(.+)_local_([A-Z]{3})", n) if currencies else None
        if currencies and (m is None or m[2] not in currencies):
            raise ValueError(f"column {n!r} is not <id>_local_<CCY> with a currency of {currencies}")
        ids[n] = m[1] if m else n
    long = raw.select(F.to_date(F.col(f"`{raw.columns[0]}`")).alias("date"), *[F.col(f"`{n}`").alias(ids[n]) for n in names]).unpivot("date", list(ids.values()), "series_id", "raw")
    return long.select("series_id", "date", to_missing(F.col("raw")).alias("level"))


def local_csv(spark: SparkSession, path: str, currency: dict[str, str]) -> DataFrame:
    """(series_id, date, level, currency) of the tickers of ``currency`` (ticker to its own currency), one column of the file each.

    A ticker's column is ``<ticker>_local_<CCY>`` or, without one, ``<ticker>_USD_unhedged``, which is in dollars. A local column
    of another currency, a ticker without a column and a doubled column are refused; other columns are left out.
    """
    raw = spark.read.csv(path, header=True)
    names = spark.read.text(path).first()[0].split(",")[1:]
    if len(set(names)) < len(names):
        raise ValueError(f"doubled columns: {sorted({n for n in names if names.count(n) > 1})}")
    chosen = []
    for ticker, own in currency.items():
        local = [n for n in names if re.fullmatch(re.escape(ticker) + r"_local_[A-Z]{3}", n)]
        if wrong := [n for n in local if n[-3:] != own]:
            raise ValueError(f"{wrong[0]} is not in {own}")
        column = local[0] if local else f"{ticker}_USD_unhedged"
        if column not in names:
            raise ValueError(f"no column of {ticker}")
        chosen.append((ticker, column, own if local else "USD"))
    long = raw.select(F.to_date(F.col(f"`{raw.columns[0]}`")).alias("date"), *[F.col(f"`{c}`").alias(t) for t, c, _ in chosen]).unpivot("date", [t for t, _, _ in chosen], "series_id", "raw")
    of = F.create_map(*[F.lit(x) for t, _, c in chosen for x in (t, c)])
    return long.select("series_id", "date", to_missing(F.col("raw")).alias("level"), of[F.col("series_id")].alias("currency"))


def blocks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Side-by-side blocks of (id, date, value) columns as (series_id, date, value); text for a value or a doubled key is refused."""
    raw = spark.read.csv(path, header=True)
    if len(raw.columns) % 3:
        raise ValueError("columns do not come in threes")
    c = [F.col(f"`{x}`") for x in raw.columns]
    each = F.array(*[F.struct(c[i].alias("series_id"), c[i + 1].alias("date"), c[i + 2].alias("raw")) for i in range(0, len(c), 3)])
    long = raw.select(F.explode(each).alias("x")).select("x.*").where("series_id is not null and series_id <> ''").select("series_id", F.to_date("date").alias("date"), "raw", to_missing(F.col("raw")).alias("value"))
    bad = long.where("value is null and raw is not null and trim(raw) not in ('', '#N/A', '#N/A N/A', 'NA', 'nan')")
    if not bad.isEmpty():
        raise ValueError(f"not a number: {bad.first()['raw']!r}")
    return refuse_doubles(long.select("series_id", "date", "value"), ["series_id", "date"])


def refuse_doubles(df: DataFrame, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"rows with the same {', '.join(keys)}: {tuple(twice.first())[:-1]}")
    return df


def request_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) for each line that is not blank or a comment; a doubled name is refused."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("name")).where("name <> ''")
    return refuse_doubles(lines, ["name"])


def newest_folder(spark: SparkSession, root: str, prefix: str) -> str:
    """The last folder by name under ``root`` that starts with ``prefix``, on any file system Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = sorted(str(s.getPath()) for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(prefix))
    if not found:
        raise FileNotFoundError(f"no folder {prefix}* in {root}")
    return found[-1]


def vintage_frame(pull: DataFrame, wanted: DataFrame | None = None, worst_grade: float = 3.0, earliest: int = -92) -> tuple[DataFrame, dict[str, int]]:
    """A vendor pull (QDF columns) as vintages (series_id, period_end, knowledge_date, value, grading, eop_lag) and counts.

    Null values are dropped and counted, poor grades dropped; a missing grade, a non-finite lag or one before ``earliest`` is
    refused, and so is a wanted series that the pull lacks.
    """
    if missing := set(QDF) - set(pull.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    df = pull.withColumn("series_id", F.concat_ws("_", "cid", "xcat"))
    if wanted is not None:
        absent = wanted.join(df.select("series_id").distinct(), "series_id", "left_anti")
        if not absent.isEmpty():
            raise ValueError(f"not in the pull: {absent.first()[0]}")
        kept = df.join(wanted, "series_id", "left_semi")
    else:
        kept = df
    lag = F.col("eop_lag")
    bad = F.col("grading").isNull() | F.isnan("grading") | lag.isNull() | F.isnan(lag) | (F.abs(lag) == float("inf")) | (lag < earliest)
    seen = kept.agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("nulls"), F.count_if(bad).alias("bad"), F.count_if(F.col("grading") >= worst_grade).alias("graded_out")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} rows with a bad lag or no grade")
    out = kept.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("grading") < worst_grade))
    return out.select("series_id", F.date_sub("real_date", lag.cast("int")).alias("period_end"), F.col("real_date").alias("knowledge_date"), "value", "grading", "eop_lag"), {k: seen[k] for k in ("rows", "nulls", "graded_out")}


def profile(df: DataFrame, date: str | None = None) -> DataFrame:
    """Structure only: rows, non-null count of each column, first and last date."""
    own = [F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"with_{c}") for c in df.columns]]
    return df.agg(*own, *([F.min(date).alias("first"), F.max(date).alias("last")] if date else []))
