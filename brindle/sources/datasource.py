"""Panel files as a data source of Spark: ``spark.read.format("panel")``, after ``register``.

Two layouts. ``wide``: a line a date, a column ``<ticker>_local_<CCY>`` a series; its currencies are those allowed and its tickers
exactly those asked for. ``long``: a line a date and ticker, whose header is exactly the one asked for and whose tickers are
among those asked for. Headers are checked when a read is planned, so a wrong file fails before any task runs. A file is read in
ranges of bytes that begin and end at lines, a task each, from any file system that pyarrow knows.

Fields may be quoted; a quoted field does not hold a line end.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import refuse_doubles

#: Bytes of a file that one task reads, unless the read says otherwise.
SPLIT = 64 << 20
#: What stands for a missing number.
MARKERS = ("", "#N/A", "#N/A N/A", "NA", "nan")
WIDE = "series_id string, date date, level double, currency string"


class BadFile(ValueError):
    """A file that is not of the layout that was asked for."""


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a comma-separated list of paths; hidden ones and marks of a commit are none."""
    out = []
    for each in path.split(","):
        system, at = _open(each)
        info = system.get_file_info(at)
        prefix = each[: len(each) - len(at)] if "://" in each else ""
        if info.type == fs.FileType.Directory:
            out += [(prefix + f.path, f.size) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        elif info.type == fs.FileType.File:
            out.append((each, info.size))
        else:
            raise FileNotFoundError(each)
    return sorted(out)


def _fields(line: str) -> list[str]:
    return [x.strip() for x in next(csv.reader([line]), [])]


def header(path: str) -> list[str]:
    system, at = _open(path)
    with system.open_input_file(at) as f:
        head = b""
        while b"\n" not in head and (more := f.read(1 << 16)):
            head += more
    return _fields(head.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r"))


def wide_columns(names: list[str], tickers: set[str], currencies: set[str]) -> list[tuple[str, str] | None]:
    """(ticker, currency) of each column after the date; None for one without a name. Refuses what is not exactly the tickers asked for."""
    if not names or names[0] != "date":
        raise BadFile(f"the header is {names[:5]}, a date is expected first")
    out: list[tuple[str, str] | None] = []
    for name in names[1:]:
        m = re.fullmatch(r"(.+)_local_(.*)", name)
        if not name:
            out.append(None)
            continue
        if m is None:
            raise BadFile(f"column {name!r} is not <ticker>_local_<CCY>")
        if m[2] not in currencies:
            raise BadFile(f"column {name!r} is quoted in {m[2]}, not in one of {sorted(currencies)}")
        if any(c and c[0] == m[1] for c in out):
            raise BadFile(f"ticker {m[1]!r} appears twice")
        out.append((m[1], m[2]))
    if (found := {c[0] for c in out if c}) != tickers:
        raise BadFile(f"missing tickers {sorted(tickers - found)}, unknown ones {sorted(found - tickers)}")
    return out


def _number(raw: str, markers: set[str]) -> float | None:
    return None if raw in markers else float(raw)


def _day(raw: str) -> dt.date | None:
    """A business day, or None for a weekend."""
    day = dt.date.fromisoformat(raw[:10])
    return day if day.weekday() < 5 else None


class Reader(DataSourceReader):
    """Plans the ranges and checks each file's header first."""

    def __init__(self, options: dict[str, str]):
        self.layout, self.path = options.get("layout", "wide"), options.get("path", "")
        self.split = int(options.get("splitbytes", SPLIT))
        listed = lambda k: [x for x in options.get(k, "").split(",") if x]
        self.tickers, self.currencies, self.header = set(listed("tickers")), set(listed("currencies")), listed("header")
        self.markers, self.texts = set(MARKERS) | set(listed("markers")), set(listed("texts"))
        self.columns: dict[str, list] = {}
        self.files = _files(self.path)
        for path, _ in self.files:
            names = header(path)
            if self.layout == "wide":
                self.columns[path] = wide_columns(names, self.tickers, self.currencies)
            elif names != self.header:
                raise BadFile(f"the header is {names}, not {self.header}")

    def partitions(self) -> list[Range]:
        return [Range(path, at, min(at + self.split, size)) for path, size in self.files for at in range(0, size, self.split)]

    def _lines(self, part: Range) -> Iterator[str]:
        """The lines that begin in the range, without the header."""
        system, at = _open(part.path)
        with system.open_input_file(at) as f:
            # The line that a range begins in the midst of is the one before's.
            f.seek(max(part.start - 1, 0))
            rest, place, first = b"", max(part.start - 1, 0), part.start > 0
            while place <= part.end or first:
                more = f.read(1 << 20)
                rest += more
                *whole, rest = rest.split(b"\n")
                if not more and rest:
                    whole, rest = [*whole, rest], b""
                for line in whole:
                    begins, place = place, place + len(line) + 1
                    if first:
                        first = False
                    elif begins >= part.end:
                        return
                    elif begins > 0 and line.strip():
                        yield line.decode().rstrip("\r")
                if not more:
                    return

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        wide = self.layout == "wide"
        schema = pa.schema([("series_id", pa.string()), ("date", pa.date32()), ("level", pa.float64()), ("currency", pa.string())]) if wide else pa.schema([("date", pa.date32()), ("ticker", pa.string()), *[(c, pa.string() if c in self.texts else pa.float64()) for c in self.header[2:]]])
        for line in self._lines(part):
            x = _fields(line)
            if not x or not x[0] or (day := _day(x[0])) is None:
                continue
            if wide:
                made += [(c[0], day, _number(x[i], self.markers) if i < len(x) else None, c[1]) for i, c in enumerate(self.columns[part.path], 1) if c]
            elif x[1] not in self.tickers:
                raise BadFile(f"ticker {x[1]!r} is not one of {sorted(self.tickers)[:20]}")
            else:
                values = (x[2:] + [""] * len(self.header))[: len(self.header) - 2]
                made.append((day, x[1], *[(v if v not in self.markers else None) if c in self.texts else _number(v, self.markers) for c, v in zip(self.header[2:], values)]))
            if len(made) >= 8192:
                yield _batch(made, schema)
                made = []
        if made:
            yield _batch(made, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Panel(DataSource):
    """Options: layout (wide, long), path, tickers, currencies (wide), header and texts (long: columns that are no numbers), markers, splitBytes; lists are comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "panel"

    def schema(self) -> str:
        if self.options.get("layout", "wide") == "wide":
            return WIDE
        names = [x for x in self.options.get("header", "").split(",") if x]
        if names[:2] != ["date", "ticker"]:
            raise BadFile(f"a long layout's header begins with date, ticker, not {names[:2]}")
        texts = self.options.get("texts", "").split(",")
        return "date date, ticker string, " + ", ".join(f"`{c}` {'string' if c in texts else 'double'}" for c in names[2:])

    def reader(self, schema) -> DataSourceReader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Panel)


def wide_panel(spark: SparkSession, path: str, tickers: list[str], currencies: tuple[str, ...]) -> DataFrame:
    """(series_id, date, level, currency) of a wide file of exactly ``tickers``; a repeated date is refused."""
    register(spark)
    df = spark.read.format("panel").option("tickers", ",".join(tickers)).option("currencies", ",".join(currencies)).load(path)
    return refuse_doubles(df, ["series_id", "date"])


def long_panel(spark: SparkSession, path: str, columns: list[str], tickers: list[str], texts: tuple[str, ...] = ()) -> DataFrame:
    """(date, ticker, columns) of a long file with exactly this header; an unknown ticker, or a date and ticker that come twice, are refused."""
    register(spark)
    df = spark.read.format("panel").option("layout", "long").option("header", ",".join(["date", "ticker", *columns])).option("tickers", ",".join(tickers)).option("texts", ",".join(texts)).load(path)
    return refuse_doubles(df, ["date", "ticker"])
