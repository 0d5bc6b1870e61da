"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import hosted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Doubles in single precision, about seven significant digits: registered queries are held against SQL, where the order of a sum shows.

    Operators themselves return what they compute.
    """
    return df.select(*[F.col(f"`{c}`").cast("float").cast("double").alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, exact: bool = False) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may use the hosted tables by name and ``r(x)`` for the same precision. ``exact``: doubles stay as they are."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f if exact else lambda spark, sf_dir: comparable(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = hosted.with_tables(sql)
        return f

    return keep
