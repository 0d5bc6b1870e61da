"""A registry of signals: a name stands for what turns weekly returns into scores (series_id, date, score)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Signal = Callable[[DataFrame], DataFrame]


class Missing(LookupError):
    """No module of that name."""


class Registry:
    """Names to signals, and to estimators, which a measurement asks for; a name is given once."""

    def __init__(self) -> None:
        self._known: dict[str, Signal] = {}

    def register(self, name: str) -> Callable[[Signal], Signal]:
        def keep(f: Signal) -> Signal:
            if name in self._known:
                raise ValueError(f"{name!r} is registered")
            self._known[name] = f
            return f

        return keep

    def resolve(self, name: str, family: str = "", measurement: bool = False) -> Signal:
        """The signal of that name; Missing, saying what was looked for, where there is none."""
        if name not in self._known:
            raise Missing(f"no {'estimator' if measurement else 'signal module'} implements {name!r} (family {family})")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)

    def apply(self, names: list[str], weekly: DataFrame) -> DataFrame:
        """(signal, series_id, date, score) of several signals, one below the other."""
        out = None
        for name in names:
            one = self.resolve(name)(weekly).select(F.lit(name).alias("signal"), "series_id", "date", "score")
            out = one if out is None else out.unionByName(one)
        return out


SIGNALS = Registry()


def _before(n: int, skip: int) -> Window:
    return Window.partitionBy("series_id").orderBy("date").rowsBetween(-(n - 1 + skip), -skip)


@SIGNALS.register("momentum")
def momentum(weekly: DataFrame) -> DataFrame:
    """The sum of 26 weeks' returns, the last four left out; null where a week is missing."""
    w = _before(26, 4)
    return weekly.select("series_id", "date", F.when(F.count("ret").over(w) == 26, F.sum("ret").over(w)).alias("score"))


@SIGNALS.register("reversal")
def reversal(weekly: DataFrame) -> DataFrame:
    """The sum of the last four weeks' returns with its sign turned."""
    w = _before(4, 0)
    return weekly.select("series_id", "date", F.when(F.count("ret").over(w) == 4, -F.sum("ret").over(w)).alias("score"))
