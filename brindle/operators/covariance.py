"""Covariances: pairwise in SQL for long panels, shrinkage and spectra of one universe at a time in numpy.

A universe (one group of the dense operators) is a fixed list of instruments over one window: bounded by the model, not by
the data; universes run in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .factored import Factored, variances
from .lineage import bounded_batches, cut
from .panel import overlapping_returns


#: Series of a block; a task holds two blocks and the sums of their pairs.
SERIES_BLOCK = 256
#: Partitions of a side of ``met``, at most: a task has the pairs of two of them.
MET = 24


def met(one: DataFrame, other: DataFrame, rows: int, on: Column) -> DataFrame:
    """Pairs of few packed rows. A task pairs two partitions and reads each where it was written, so no row is sent once a pair: what is shuffled grows with the rows."""
    parts = max(1, min(rows, MET, int(np.ceil(2 * np.sqrt(rows)))))
    return one.repartition(parts).hint("shuffle_replicate_nl").join(other.repartition(parts), on)


def _renamed(df: DataFrame, end: str, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in but else c + end) for c in df.columns])


def _packed_blocks(df: DataFrame) -> DataFrame:
    """(set, block, ids, labels, day, col, x): series dealt to blocks by hash, a row a block; the last three as bytes of int32, int32 and float64, a cell a number. df: set, series_id, date, x, label."""
    rows = df.where("x is not null").select("set", "series_id", "date", F.col("x").cast("double").alias("x"), "label")
    sizes = rows.groupBy("set").agg(F.ceil(F.count_distinct("series_id") / SERIES_BLOCK).alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "set").withColumn("block", F.pmod(F.xxhash64("series_id"), F.col("blocks")).cast("int"))  # one row a set
    code = F.xxhash64("series_id").alias("code")
    packed = dealt.groupBy("set", "block").agg(F.collect_set(F.struct(code, "series_id", "label")).alias("ids"), F.collect_list(F.struct(code, F.unix_date("date").alias("day"), "x")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, cells = batch.column("ids")[i].values, batch.column("cells")[i].values
                own = ids.field("code").to_numpy()
                order = np.argsort(own)
                col = np.searchsorted(own[order], cells.field("code").to_numpy()).astype(np.int32)
                told = [ids.field(c).take(pa.array(order)) for c in ("series_id", "label")]
                raw = [cells.field("day").to_numpy().astype(np.int32), col, cells.field("x").to_numpy().astype(np.float64)]
                yield pa.RecordBatch.from_arrays([batch.column("set").slice(i, 1), batch.column("block").slice(i, 1), *(pa.array([v.to_pylist()], pa.list_(pa.string())) for v in told), *(pa.array([v.tobytes()], pa.binary()) for v in raw)], ["set", "block", "ids", "labels", "day", "col", "x"])

    kind = dict(df.dtypes)["set"]
    return packed.mapInArrow(run, f"set {kind}, block int, ids array<string>, labels array<string>, day binary, col binary, x binary")


def pair_sums(df: DataFrame, apart: bool = False) -> DataFrame:
    """(set, a, b, n, sx, sy, sxy), a <= b: for each pair of series of a set the sums over the dates that both have; with ``apart`` only pairs of unlike ``label``.

    df: set, series_id, date, x and, with ``apart``, label, one a series; nulls are no rows. Series are dealt to blocks, which are written
    once; the dates of two blocks are a pair of dense matrices whose products give the sums of all their pairs. So a pair is
    made once, in one place, no pair is sent or added up afterwards, and neither is a date.
    """
    bounded_batches(df.sparkSession)
    packed = cut(_packed_blocks(df if apart else df.withColumn("label", F.lit(""))))
    pairs = met(packed, _renamed(packed, "_b"), packed.count(), (F.col("set") == F.col("set_b")) & (F.col("block_b") >= F.col("block"))).drop("set_b")

    def dense(day: np.ndarray, col: np.ndarray, x: np.ndarray, first: int, days: int, series: int) -> tuple[np.ndarray, np.ndarray]:
        values, there = np.zeros((days, series)), np.zeros((days, series), np.float32)
        values[day - first, col], there[day - first, col] = x, 1.0
        return values, there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]
                cells = [[np.frombuffer(at(c + end).as_buffer(), k) for c, k in (("day", np.int32), ("col", np.int32), ("x", np.float64))] for end in ("", "_b")]
                first, last = max(c[0].min() for c in cells), min(c[0].max() for c in cells)
                ids, other = at("ids").values, at("ids_b").values
                na, nb = len(ids), len(other)
                if last < first:
                    continue
                inside = [[v[(c[0] >= first) & (c[0] <= last)] for v in c] for c in cells]
                (xa, ma), (xb, mb) = (dense(*c, first, last - first + 1, m) for c, m in zip(inside, (na, nb)))
                both = ma.any(axis=1) & mb.any(axis=1)
                xa, ma, xb, mb = xa[both], ma[both], xb[both], mb[both]
                n, sxy = (ma.T @ mb).ravel(), (xa.T @ xb).ravel()
                sx, sy = (xa.T @ mb.astype(float)).ravel(), (ma.T.astype(float) @ xb).ravel()
                place = np.unique(np.concatenate([ids.to_pylist(), other.to_pylist()]), return_inverse=True)[1]
                swap = (place[:na, None] > place[None, na:]).ravel()
                ok = n > 0
                if at("block").as_py() == at("block_b").as_py():
                    ok &= ~swap
                if apart:
                    kind = np.unique(np.concatenate([at("labels").values.to_pylist(), at("labels_b").values.to_pylist()]), return_inverse=True)[1]
                    ok &= (kind[:na, None] != kind[None, na:]).ravel()
                kept = np.flatnonzero(ok)
                turned, names = swap[kept], pa.concat_arrays([ids, other])
                a, b = kept // nb, na + kept % nb
                columns = [names.take(pa.array(np.where(turned, b, a))), names.take(pa.array(np.where(turned, a, b))), n[kept].astype(np.int64), np.where(turned, sy[kept], sx[kept]), np.where(turned, sx[kept], sy[kept]), sxy[kept]]
                yield pa.RecordBatch.from_arrays([pa.repeat(at("set"), len(kept)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], ["set", "a", "b", "n", "sx", "sy", "sxy"])

    kind = dict(df.dtypes)["set"]
    return pairs.mapInArrow(run, f"set {kind}, a string, b string, n long, sx double, sy double, sxy double")


def pairwise(df: DataFrame, apart: bool = False) -> DataFrame:
    """(set, a, b, cov, n), a <= b: sample covariances of the pairs of each set over the dates that both have; null for a single date. df: set, series_id, date, x; with ``apart`` as in ``pair_sums``.

    Series are centred first, so that sums of products lose nothing to large means.
    """
    told = ["label"] if apart else []
    df = cut(df.where("x is not null").select("set", "series_id", "date", "x", *told))  # read for means, sizes and sums
    mean = df.groupBy("set", "series_id").agg(F.avg("x").alias("_m"))
    sums = pair_sums(df.join(mean, ["set", "series_id"]).select("set", "series_id", "date", (F.col("x") - F.col("_m")).alias("x"), *told), apart)
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)
    return sums.select("set", "a", "b", F.when(F.col("n") > 1, cov).alias("cov"), "n")


def cross_region(returns: DataFrame, meta: DataFrame, days: int = 2, least: int = 60) -> DataFrame:
    """(a, b, cov, n), a <= b, pairwise deletion: daily within a region, from overlapping ``days``-day returns over days across regions."""
    regions = meta.select("series_id", "region")
    same = pairwise(returns.join(regions, "series_id").select(F.col("region").alias("set"), "series_id", "date", F.col("ret").alias("x"))).select("a", "b", "cov", "n")
    far = pairwise(overlapping_returns(returns, days).join(regions, "series_id").select(F.lit("").alias("set"), "series_id", "date", F.col("ret").alias("x"), F.col("region").alias("label")), apart=True)
    return same.unionByName(far.select("a", "b", (F.col("cov") / days).alias("cov"), "n")).where(F.col("n") >= least)


def cross_region_pairs(meta: DataFrame) -> DataFrame:
    """Unordered pairs of series of different regions. Series are dealt to blocks by hash, a row each, so no task holds a region and none is sent once a pair of blocks."""
    held = cut(meta.select("series_id", "region"))
    blocks = max(1, -(-held.count() // SERIES_BLOCK))
    packed = held.groupBy(F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int").alias("i")).agg(F.collect_list(F.struct("series_id", "region")).alias("s"))
    pairs = met(packed, packed.select(F.col("i").alias("j"), F.col("s").alias("t")), blocks, F.col("i") <= F.col("j"))
    one = pairs.select("i", "j", F.explode("s").alias("x"), "t").select("i", "j", "x", F.explode("t").alias("y")).where("x.region <> y.region and (i < j or x.series_id < y.series_id)")
    return one.select(F.least("x.series_id", "y.series_id").alias("a"), F.greatest("x.series_id", "y.series_id").alias("b"))


def trailing_pairs(factors: DataFrame, n: int) -> DataFrame:
    """Population covariance of each pair of factors over their last n common rows. factors: factor, date, ret."""
    k = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("date")))
    last = factors.withColumn("k", k).where(F.col("k") <= n).select("factor", "date", "ret")
    other = last.select(F.col("factor").alias("b"), "date", F.col("ret").alias("y"))
    return last.join(other, "date").groupBy(F.col("factor").alias("a"), "b").agg(F.covar_pop("ret", "y").alias("cov"))


def shrink(x: np.ndarray, target: str) -> tuple[np.ndarray, float]:
    """The shrunk covariance of rows by columns and its intensity, towards a constant correlation or a scaled identity."""
    t, n = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / t
    var = np.diag(s)
    sd = np.sqrt(var)
    pi = ((x**2).T @ (x**2)) / t - s**2
    if target == "identity" or n == 1:
        f = np.eye(n) * var.mean()
        rho = 0.0
    else:
        outer = np.outer(sd, sd)
        corr = np.where(outer > 0, s / np.where(outer > 0, outer, 1), 0)  # a flat series correlates with nothing
        r = (corr.sum() - np.trace(corr)) / (n * (n - 1))
        f = r * outer
        np.fill_diagonal(f, var)
        theta = ((x**3).T @ x) / t - var[:, None] * s
        ratio = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
        off = ~np.eye(n, dtype=bool)
        rho = np.diag(pi).sum() + (r / 2 * (np.outer(ratio, sd) * theta + (np.outer(ratio, sd) * theta).T))[off].sum()
    gamma = ((s - f) ** 2).sum()
    k = 0.0 if gamma <= 0 else float(np.clip((pi.sum() - rho) / gamma / t, 0, 1))
    return k * f + (1 - k) * s, k


#: Series of a packed block of ``shrunk``; a task holds the matrix of two.
SHRUNK_BLOCK = 256


def _packed(weekly: DataFrame, window: int, present: float) -> DataFrame:
    """(universe, block, blocks, t, s): series with ``present`` of the last ``window`` weeks of their universe, in blocks of bounded size; ``s`` an array of (series_id, k, ret), k from 1, the last week."""
    bounded_batches(weekly.sparkSession)
    days = weekly.select("universe", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("universe").orderBy(F.desc("date")))).where(F.col("k") <= window)
    days = days.withColumn("t", F.count("*").over(Window.partitionBy("universe"))).where("t > 1")
    rows = weekly.where("ret is not null").join(days, ["universe", "date"])
    cells = F.array_sort(F.collect_list(F.struct("k", "ret")))  # at most ``window``
    live = cut(rows.groupBy("universe", "series_id", "t").agg(cells.alias("c")).where(F.size("c") / F.col("t") >= present))
    sizes = live.groupBy("universe").agg(F.ceil(F.count("*") / SHRUNK_BLOCK).cast("int").alias("blocks"))
    dealt = live.join(sizes, "universe").withColumn("block", F.pmod(F.xxhash64("series_id"), F.col("blocks")).cast("int"))
    return cut(dealt.groupBy("universe", "block", "blocks", "t").agg(F.collect_list(F.struct("series_id", F.col("c.k").alias("k"), F.col("c.ret").alias("ret"))).alias("s")))


def _centred(s: pa.StructArray, t: int) -> tuple[list[str], np.ndarray]:
    """Ids and centred columns of a block, gaps as zero."""
    k, ret = s.field("k"), s.field("ret")
    x = np.zeros((t, len(s)))
    x[t - k.flatten().to_numpy(), np.repeat(np.arange(len(s)), k.value_lengths().to_numpy())] = ret.flatten().to_numpy()
    return s.field("series_id").to_pylist(), x - x.mean(axis=0)


def shrink_sums(x: np.ndarray) -> dict[str, np.ndarray]:
    """What ``intensity`` needs of centred columns: sums over columns, so those of blocks add up. None is larger than weeks by weeks."""
    var = (x**2).mean(axis=0)
    sd = np.sqrt(var)
    inv = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
    z, q = x * inv, (x**4).mean(axis=0) - var**2
    return {
        "n": np.array(float(len(var))), "flat": np.array(float((sd <= 0).sum())), "var": var.sum(), "var2": (var**2).sum(), "pi": q.sum(), "theta": q[sd > 0].sum(),
        "x2": (x**2).sum(axis=1), "x3": (x**3 * inv).sum(axis=1), "z": z.sum(axis=1), "sx": (x * sd).sum(axis=1), "xx": x @ x.T, "zz": z @ z.T,
    }


def intensity(a: dict[str, np.ndarray], target: str) -> tuple[float, float, float]:
    """(k, r, mu): the intensity of ``shrink``, the mean correlation and the mean variance, from ``shrink_sums``.

    Sums over all pairs of columns are squares and products of sums over columns, so no pair is formed.
    """
    t, n = len(a["x2"]), float(a["n"])
    mu, s2 = float(a["var"]) / n, float((a["xx"] ** 2).sum()) / t**2
    pi = float(a["x2"] @ a["x2"]) / t - s2
    r = rho = 0.0
    if target == "identity" or n == 1:
        gamma = s2 - 2 * mu * float(a["var"]) + n * mu**2
    else:
        r = (float(a["z"] @ a["z"]) / t - (n - float(a["flat"]))) / (n * (n - 1))
        both = float(a["sx"] @ a["sx"]) / t
        rho = float(a["pi"]) + r * (float(a["x3"] @ a["sx"]) / t - both - float(a["theta"]))
        gamma = s2 - 2 * r * both + r**2 * float(a["var"]) ** 2 - (1 - 2 * r + r**2) * float(a["var2"])
    return (0.0 if gamma <= 1e-14 * s2 else float(np.clip((pi - rho) / gamma / t, 0, 1))), r, mu


_SUMS = ("n", "flat", "var", "var2", "pi", "theta", "x2", "x3", "z", "sx", "xx", "zz")


def _totals(packed: DataFrame, told: Callable[[dict[str, np.ndarray]], list[float]], names: list[str]) -> DataFrame:
    """(universe, t, names...): ``told`` of the sums over all blocks of a universe. A task hands on one row a universe."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("universe")[i].as_py(), batch.column("t")[i].as_py()
                new = shrink_sums(_centred(batch.column("s")[i].values, key[1])[1])
                held[key] = {c: held[key][c] + new[c] for c in _SUMS} if key in held else new
        for (u, t), a in held.items():
            yield pa.RecordBatch.from_pylist([{"universe": u, "t": t, "sums": np.concatenate([np.ravel(a[c]) for c in _SUMS]).tolist()}], pa.schema([("universe", pa.string()), ("t", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, flat = int(key[1]), np.sum([np.asarray(x) for x in rows["sums"]], axis=0)
        sizes = [1] * 6 + [t] * 4 + [t * t] * 2
        parts = dict(zip(_SUMS, np.split(flat, np.cumsum(sizes)[:-1])))
        a = {c: x[0] if len(x) == 1 and c in _SUMS[:6] else x.reshape(t, t) if c in ("xx", "zz") else x for c, x in parts.items()}
        return pd.DataFrame([[key[0], t, *told(a)]], columns=["universe", "t", *names])

    some_rows = packed.select("universe", "t", "s").mapInArrow(some, "universe string, t long, sums array<double>")
    return some_rows.groupBy("universe", "t").applyInPandas(total, "universe string, t long, " + ", ".join(f"{c} double" for c in names))


def shrunk(weekly: DataFrame, target: str, window: int = 156, present: float = 0.9) -> DataFrame:
    """(universe, a, b, cov, shrinkage): over the last ``window`` weeks of each universe, series with ``present`` of them, gaps as zero.

    The intensity comes from sums over series, the matrix block by block: a task holds the columns of two blocks and their products.
    """
    packed = _packed(weekly, window, present)
    with_k = packed.join(F.broadcast(_totals(packed, lambda a: list(intensity(a, target)), ["shrinkage", "r", "mu"])), ["universe", "t"])  # one row a universe
    pairs = met(with_k.drop("blocks"), _renamed(packed.select("universe", "block", "s"), "_b"), packed.count(), (F.col("universe") == F.col("universe_b")) & (F.col("block_b") >= F.col("block")))
    pairs = pairs.select("universe", "t", "block", "block_b", "s", "s_b", "shrinkage", "r", "mu")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]
                t, k, r, mu = (at(c).as_py() for c in ("t", "shrinkage", "r", "mu"))
                (na, x), (nb, y) = _centred(at("s").values, t), _centred(at("s_b").values, t)
                cov, same = x.T @ y / t, at("block").as_py() == at("block_b").as_py()
                own = np.equal.outer(np.array(na, object), np.array(nb, object)) if same else np.zeros(cov.shape, bool)
                if target == "identity":
                    f = np.where(own, mu, 0.0)
                else:
                    f = np.where(own, cov, r * np.outer(np.sqrt((x**2).mean(axis=0)), np.sqrt((y**2).mean(axis=0))))
                made, a, b = (k * f + (1 - k) * cov).ravel(), np.repeat(np.arange(len(na)), len(nb)), np.tile(np.arange(len(nb)), len(na))
                one, other = pa.array(na, pa.string()).take(pa.array(a)), pa.array(nb, pa.string()).take(pa.array(b))
                for ids in ((one, other),) if same else ((one, other), (other, one)):  # two blocks are products once, rows both ways
                    yield pa.RecordBatch.from_arrays([pa.repeat(at("universe"), len(made)), *ids, pa.array(made), pa.array(np.full(len(made), k))], ["universe", "a", "b", "cov", "shrinkage"])

    return pairs.mapInArrow(run, "universe string, a string, b string, cov double, shrinkage double")


def shrunk_bets(weekly: DataFrame, window: int = 156, present: float = 0.9) -> DataFrame:
    """(universe, bets, n): ``effective_bets`` of ``shrunk`` towards a constant correlation, without forming its matrix.

    Its correlations are a multiple of the identity and as many directions as weeks and one more, so all eigenvalues but those
    are alike, and those are the eigenvalues of a matrix of that size.
    """

    def told(a: dict[str, np.ndarray]) -> list[float]:
        k, r, _ = intensity(a, "constant_correlation")
        t, flat = len(a["x2"]), int(a["flat"])
        m = int(a["n"]) - flat
        r = r if a["n"] > 1 else 1.0  # a single series is its own target
        gram = np.block([[(1 - k) / t * a["zz"], (np.sqrt((1 - k) / t * k * abs(r)) * a["z"])[:, None]], [(np.sqrt((1 - k) / t * k * abs(r)) * a["z"])[None, :], np.array([[k * abs(r) * m]])]])
        v, u = np.linalg.eigh(gram)
        root = u * np.sqrt(np.maximum(v, 0)) @ u.T
        sign = np.ones(t + 1)
        sign[-1] = 1.0 if r >= 0 else -1.0
        low = np.linalg.eigvalsh(root * sign @ root)
        low = low[np.argsort(-np.abs(low))[: min(m, t + 1)]]
        p = np.maximum(np.concatenate([k * (1 - r) + low, np.full(max(m - t - 1, 0), k * (1 - r)), np.ones(flat)]), 0)
        p = p[p > 0] / p.sum() if p.sum() > 0 else p[:0]
        return [float(np.exp(-(p * np.log(p)).sum())) if len(p) else float("nan"), a["n"]]

    return _totals(_packed(weekly, window, present), told, ["bets", "n"]).select("universe", "bets", F.col("n").cast("int").alias("n"))


def _long(key: tuple, ids, c: np.ndarray, k: float) -> pd.DataFrame:
    ids = np.array([str(x) for x in ids], object)
    return pd.DataFrame({"universe": key[0], "a": np.repeat(ids, len(ids)), "b": np.tile(ids, len(ids)), "cov": c.ravel(), "shrinkage": k})


def ewma(n: int, half_life: float) -> np.ndarray:
    """Weights of n observations, the newest last, that halve every ``half_life`` and sum to one."""
    w = 0.5 ** (np.arange(n)[::-1] / half_life)
    return w / w.sum()


def _spread(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted variances of columns."""
    return w @ (x - w @ x) ** 2


def rescaled(c: np.ndarray, x: np.ndarray, half_life: float) -> np.ndarray:
    """The covariance with its correlations kept and each volatility exchanged for the weighted one of ``x``; flat series become zero."""
    slow = np.sqrt(np.maximum(np.diag(c), 0))
    scale = np.where(slow > 0, np.sqrt(_spread(x, ewma(len(x), half_life))) / np.where(slow > 0, slow, 1), 0)
    return c * np.outer(scale, scale)


def rescaled_pairs(weekly: DataFrame, half_life: float) -> DataFrame:
    """(universe, a, b, cov), both ways: pairwise sample covariances with correlations kept and volatilities from weights that halve every ``half_life`` weeks.

    weekly: universe, series_id, date, ret; weeks are those of the universe, gaps count as zero. Flat series become zero. Series are
    rescaled before they are paired, so no pair meets its two scales in a join.
    """
    weekly = cut(weekly.select("universe", "series_id", "date", "ret"))  # read for weeks, scales and pairs
    days = weekly.select("universe", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("universe").orderBy(F.desc("date"))) - 1)
    w = F.pow(F.lit(0.5), F.col("k") / half_life)
    weighed = days.withColumn("w", w / F.sum(w).over(Window.partitionBy("universe"))).drop("k")
    x = F.coalesce("ret", F.lit(0.0))
    fast = F.sum(F.col("w") * x * x) - F.pow(F.sum(F.col("w") * x), 2)
    slow = F.var_samp("ret")
    scale = weekly.join(F.broadcast(weighed), ["universe", "date"]).groupBy("universe", "series_id").agg(fast.alias("fast"), slow.alias("slow"))  # one row a week
    scale = scale.where("slow is not null").select("universe", "series_id", F.when(F.col("slow") > 0, F.sqrt(F.greatest("fast", F.lit(0.0)) / F.col("slow"))).otherwise(0.0).alias("s"))
    scaled = weekly.join(scale, ["universe", "series_id"]).select(F.col("universe").alias("set"), "series_id", "date", (F.col("ret") * F.col("s")).alias("x"))
    half = pairwise(scaled).where("cov is not null").select(F.col("set").alias("universe"), "a", "b", "cov")
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select("universe", F.explode(ways).alias("p"), "cov").select("universe", "p.a", "p.b", "cov")


def turbulence(c: np.ndarray, x: np.ndarray, half_life: float) -> float:
    """The root of mean weighted variance over mean variance: one number for the whole panel."""
    slow = np.maximum(np.diag(c), 0).mean()
    return float(np.sqrt(_spread(x, ewma(len(x), half_life)).mean() / slow)) if slow > 0 else 1.0


def tracked(x: np.ndarray, legs: np.ndarray, half_life: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Books of the holdings (columns of ``x``) that track each leg, a row a leg, the variances they miss and the R squared."""
    from .optimise import nnls

    w = np.full(len(x), 1 / len(x)) if half_life is None else ewma(len(x), half_life)
    books, missed, fit = [], [], []
    for y in legs.T:
        heavy = 1e3 * max(float(np.abs(y).mean()), 1e-8) * np.sqrt(len(x))  # asks for a sum of one
        book = nnls(np.vstack([x, np.full((1, x.shape[1]), heavy)]), np.append(y, heavy))
        left, total = float(_spread(y - x @ book, w)), float(_spread(y, w))
        books.append(book)
        missed.append(left)
        fit.append(1 - left / total if total > 0 else np.nan)
    return np.array(books).reshape(legs.shape[1], x.shape[1]), np.array(missed), np.array(fit)


def with_legs(c: np.ndarray, x: np.ndarray, legs: np.ndarray, half_life: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The covariance with benchmark legs (columns of ``legs``) added after the holdings, through books of the holdings that track them.

    A leg's covariances are those of its tracking book, its variance the book's plus that of what the book misses. Returns the
    matrix, the books (a row a leg), the missed variances and the R squared.
    """
    b, missed, fit = tracked(x, legs, half_life)
    cross = b @ c
    return np.block([[c, cross.T], [cross, cross @ b.T + np.diag(missed)]]), b, missed, fit


def shrunk_factors(x: np.ndarray) -> tuple[Factored, float]:
    """``shrink`` towards a constant correlation, and its intensity, without forming the matrix."""
    t, n = x.shape
    x = x - x.mean(axis=0)
    k, r, _ = intensity(shrink_sums(x), "constant_correlation")
    var = (x**2).mean(axis=0)
    r = r if n > 1 else 0.0
    core = np.diag(np.append(np.full(t, (1 - k) / t), k * r))
    return Factored(k * (1 - r) * var, np.hstack([x.T, np.sqrt(var)[:, None]]), core), k


def factors(x: np.ndarray, legs: np.ndarray, half_life: float | None = None, overlay: str = "per_series") -> tuple[Factored, float, np.ndarray]:
    """What ``estimate`` makes of weeks by holdings and weeks by legs: the factored covariance of both, its intensity, the legs' R squared."""
    c, k = shrunk_factors(x)
    if half_life is not None:
        slow = np.sqrt((x - x.mean(axis=0)).var(axis=0)) if overlay == "per_series" else x.var(axis=0)
        fast = _spread(x, ewma(len(x), half_life))
        if overlay == "per_series":
            c = c.scaled(np.where(slow > 0, np.sqrt(fast) / np.where(slow > 0, slow, 1), 0))
        else:
            c = Factored(c.d * (m := fast.mean() / slow.mean() if slow.mean() > 0 else 1.0), c.load, c.core * m)
    if not legs.shape[1]:
        return c, k, np.zeros(0)
    books, missed, r2 = tracked(x, legs, half_life)
    return c.with_legs(books, missed), k, r2


#: As-of dates of a universe that one task computes; its weeks are shipped once for a block and the window before it.
AS_OF_BLOCK = 26


def estimate(wide: pd.DataFrame, legs: list[str], present: float = 0.9, half_life: float | None = None, overlay: str = "per_series") -> tuple[list[str], int, np.ndarray, float, np.ndarray] | None:
    """(ids, holdings among them, matrix, shrinkage, R squared by id) of one window of weeks by series; None where nothing can be held or a leg lacks its window."""
    ok = wide.columns[wide.iloc[0].notna() & (wide.notna().mean() >= present)]
    hold, own = [c for c in ok if c not in legs], [c for c in legs if c in ok]
    if not hold or len(own) < len(legs):
        return None
    x = wide[hold].fillna(0.0).to_numpy()
    c, k = shrink(x, "constant_correlation")
    if half_life is not None:
        c = rescaled(c, x, half_life) if overlay == "per_series" else c * turbulence(c, x, half_life) ** 2
    r2 = np.full(len(hold) + len(own), np.nan)
    if own:
        c, _, _, r2[len(hold) :] = with_legs(c, x, wide[own].fillna(0.0).to_numpy(), half_life)
    return [*hold, *own], len(hold), c, k, r2


def matrices(weekly: DataFrame, as_of: DataFrame, legs: list[str], window: int = 156, present: float = 0.9, half_life: float | None = None, overlay: str = "per_series") -> DataFrame:
    """(universe, as_of, ids, n_hold, matrix, shrinkage, leg_r2): the covariance that could have been estimated at each as-of date.

    weekly: universe, series_id, date, ret. Series live at the window's start with ``present`` of its periods take part, gaps
    as zero; shrunk to a constant correlation; with ``half_life``, volatilities follow the weighted ones (``per_series``) or
    one multiplier (``scalar``); ``legs`` come in through tracking books, after that. ``ids`` are the holdings, then the legs;
    ``matrix`` is row by row. A universe and date without a whole window, or whose legs lack one, has no row.

    Weeks of a universe are numbered; an as-of date belongs to its last week's block. A task gets a block's weeks and the window
    before them, so a week is shipped a few times however many as-of dates there are.
    """
    if overlay not in ("per_series", "scalar"):
        raise ValueError(f"unknown overlay {overlay!r}")

    def run(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(ends):
            wide = rows.pivot(index="k", columns="series_id", values="ret").sort_index()
            for as_of, end in zip(ends["as_of"], ends["end"]):
                part = wide.loc[end - window + 1 : end]
                if len(part) == window and (made := estimate(part, legs, present, half_life, overlay)) is not None:
                    ids, n, c, k, r2 = made
                    out.append((key[0], as_of, [str(i) for i in ids], n, c.ravel(), k, r2))
        return pd.DataFrame(out, columns=["universe", "as_of", "ids", "n_hold", "matrix", "shrinkage", "leg_r2"])

    days = weekly.select("universe", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("universe").orderBy("date")))
    block = lambda k: F.floor((F.col(k) if isinstance(k, str) else k) / AS_OF_BLOCK).cast("int")
    reach = as_of.select("universe", "as_of").distinct().join(days, "universe").where("date <= as_of").groupBy("universe", "as_of").agg(F.max("k").alias("end"))
    ends = reach.where(F.col("end") >= window).withColumn("block", block("end"))
    wanted = ends.select("universe", "block").distinct()
    spread = days.withColumn("block", F.explode(F.sequence(block("k"), block(F.col("k") + window - 1)))).join(wanted, ["universe", "block"], "left_semi")
    held = weekly.select("universe", "date", "series_id", "ret").join(spread, ["universe", "date"])
    return held.groupBy("universe", "block").cogroup(ends.groupBy("universe", "block")).applyInPandas(run, "universe string, as_of date, ids array<string>, n_hold int, matrix array<double>, shrinkage double, leg_r2 array<double>")


@dataclass(frozen=True)
class Trailing:
    """How a covariance as of a date is estimated: what ``matrices`` takes, its weeks and dates aside."""

    legs: tuple[str, ...] = ()
    window: int = 156
    present: float = 0.9
    half_life: float | None = None
    overlay: str = "per_series"

    def __post_init__(self) -> None:
        if self.overlay not in ("per_series", "scalar"):
            raise ValueError(f"unknown overlay {self.overlay!r}")


class Weeks:
    """The last ``window`` weeks of a universe as they come by, and the covariance that they make."""

    def __init__(self, how: Trailing):
        self.how, self.place, self.past = how, {}, deque(maxlen=how.window)

    def add(self, ids: list[str], ret: np.ndarray) -> None:
        self.past.append((np.array([self.place.setdefault(s, len(self.place)) for s in ids], int), np.asarray(ret, float)))

    def estimate(self) -> tuple[list[str], int, Factored, float, np.ndarray] | None:
        """(ids, holdings among them, covariance, shrinkage, R squared by id); None where nothing can be held, a leg lacks its window or the window is not whole."""
        window, legs = self.how.window, self.how.legs
        if len(self.past) < window:
            return None
        names = list(self.place)
        first = self.past[0][0]
        column = np.full(len(names), -1)
        column[first] = np.arange(len(first))
        x, seen = np.zeros((window, len(first))), np.zeros(len(first))
        for k, (c, ret) in enumerate(self.past):
            c, ok = column[c], column[c] >= 0
            x[k, c[ok]] = ret[ok]
            seen[c[ok]] += 1
        live = {names[first[j]]: j for j in np.flatnonzero(seen / window >= self.how.present)}
        hold, own = sorted(s for s in live if s not in legs), [s for s in legs if s in live]
        if not hold or len(own) < len(legs):
            return None
        c, k, fit = factors(x[:, [live[s] for s in hold]], x[:, [live[s] for s in own]], self.how.half_life, self.how.overlay)
        return [*hold, *own], len(hold), c, k, np.append(np.full(len(hold), np.nan), fit)


def factored(weekly: DataFrame, as_of: DataFrame, legs: list[str], window: int = 156, present: float = 0.9, half_life: float | None = None, overlay: str = "per_series") -> DataFrame:
    """(universe, as_of, ids, n_hold, d, load, core, shrinkage, leg_r2): ``matrices`` as ``Factored``, its arrays row by row.

    A row is a week's number of columns by series, not series by series.
    """
    how = Trailing(tuple(legs), window, present, half_life, overlay)
    schema = pa.schema([("universe", pa.string()), ("as_of", pa.date32()), ("ids", pa.list_(pa.string())), ("n_hold", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("d", "load", "core")], ("shrinkage", pa.float64()), ("leg_r2", pa.list_(pa.float64()))])

    def told(universe: str, asked: dict, made: tuple) -> Iterator[pa.RecordBatch]:
        ids, n, c, k, r2 = made
        row = [universe, asked["as_of"], ids, n, c.d, c.load.ravel(), c.core.ravel(), k, r2]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return _as_of(weekly, as_of, how, told, "universe string, as_of date, ids array<string>, n_hold int, d array<double>, load array<double>, core array<double>, shrinkage double, leg_r2 array<double>")


def _as_of(weekly: DataFrame, as_of: DataFrame, how: Trailing, told: Callable[[str, dict, tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``told`` makes of each universe, row of ``as_of`` (as_of, and what else it holds) and covariance.

    A task streams a block's weeks in order, one row each, and holds the last ``window`` of them; a covariance stays where it is made.
    """
    window = how.window
    bounded_batches(weekly.sparkSession)
    days = weekly.select("universe", "date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("universe").orderBy("date")))
    block = lambda k: F.floor((F.col(k) if isinstance(k, str) else k) / AS_OF_BLOCK).cast("int")
    reach = as_of.select("universe", "as_of").distinct().join(days, "universe").where("date <= as_of").groupBy("universe", "as_of").agg(F.max("k").alias("end"))
    told_of = [c for c in as_of.columns if c not in ("universe", "as_of")]
    asked = as_of.join(reach, ["universe", "as_of"]) if told_of else reach
    ends = asked.where(F.col("end") >= window).groupBy("universe", F.col("end").alias("k")).agg(F.sort_array(F.collect_list(F.struct("as_of", *told_of))).alias("as_ofs")).withColumn("block", block("k"))
    wanted = ends.select("universe", "block").distinct()
    spread = days.withColumn("block", F.explode(F.sequence(block("k"), block(F.col("k") + window - 1)))).join(wanted, ["universe", "block"], "left_semi")
    packed = weekly.where("ret is not null").groupBy("universe", "date").agg(F.collect_list(F.struct("series_id", F.col("ret").cast("double").alias("ret"))).alias("s"))
    weeks = spread.join(ends, ["universe", "block", "k"], "left").join(packed, ["universe", "date"], "left").select("universe", "block", "k", "as_ofs", F.col("s.series_id").alias("ids"), F.col("s.ret").alias("ret"))
    tasks = int(weekly.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows with much work each: not to be merged by their bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, past = None, Weeks(how)
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i]
                if (now := (at("universe").as_py(), at("block").as_py())) != key:
                    key, past = now, Weeks(how)
                ids = at("ids").as_py() or []
                past.add(ids, at("ret").values.to_numpy() if ids else np.zeros(0))
                if at("as_ofs").is_valid and (made := past.estimate()) is not None:
                    for asked in at("as_ofs").as_py():
                        yield from told(key[0], asked, made)

    return weeks.repartition(tasks, "universe", "block").sortWithinPartitions("universe", "block", "k").mapInArrow(run, schema)


def unpacked(row: dict) -> Factored:
    """The covariance of a row of ``factored``: d, load, core."""
    d, core = np.asarray(row["d"], float), np.asarray(row["core"], float)
    m = int(np.sqrt(len(core)))
    return Factored(d, np.asarray(row["load"], float).reshape(len(d), m), core.reshape(m, m))


def trailing(weekly: DataFrame, as_of: DataFrame, legs: list[str], window: int = 156, present: float = 0.9, half_life: float | None = None, overlay: str = "per_series") -> DataFrame:
    """(universe, as_of, a, b, cov, shrinkage, leg_r2): ``matrices`` as a long table. ``leg_r2`` is null but on a leg's own diagonal.

    Rows are as many as pairs of series and dates; a task forms them a few of a matrix' rows at a time.
    """

    def told(universe: str, asked: dict, made: tuple) -> Iterator[pa.RecordBatch]:
        ids, _, c, k, r2 = made
        names, n = pa.array(ids, pa.string()), len(c)
        for first, part in c.rows():
            a = np.repeat(np.arange(first, first + len(part)), n)
            b = np.tile(np.arange(n), len(part))
            fit = np.where(a == b, r2[a], np.nan)
            const = lambda v, t: pa.repeat(pa.scalar(v, t), len(a))
            yield pa.RecordBatch.from_arrays([const(universe, pa.string()), const(asked["as_of"], pa.date32()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(part.ravel()), const(k, pa.float64()), pa.array(fit, mask=np.isnan(fit))], ["universe", "as_of", "a", "b", "cov", "shrinkage", "leg_r2"])

    how = Trailing(tuple(legs), window, present, half_life, overlay)
    return _as_of(weekly, as_of, how, told, "universe string, as_of date, a string, b string, cov double, shrinkage double, leg_r2 double")


def bets(m: np.ndarray) -> float:
    """The exponential of the entropy of a matrix's eigenvalue shares; nan if they sum to nothing."""
    v = np.maximum(np.linalg.eigvalsh(m), 0)
    p = v[v > 0] / v.sum() if v.sum() > 0 else v[:0]
    return float(np.exp(-(p * np.log(p)).sum())) if len(p) else float("nan")


def correlation(c: np.ndarray) -> np.ndarray:
    """The correlations of a covariance; flat series correlate with nothing."""
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    outer = np.outer(sd, sd)
    r = np.where(outer > 0, c / np.where(outer > 0, outer, 1), 0)
    np.fill_diagonal(r, 1.0)
    return r


def effective_bets(cov: DataFrame) -> DataFrame:
    """Per universe the exponential of the entropy of its correlations' eigenvalue shares."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="a", columns="b", values="cov").to_numpy()
        return pd.DataFrame({"universe": [key[0]], "bets": [bets(correlation(m))], "n": [len(m)]})

    return cov.groupBy("universe").applyInPandas(run, "universe string, bets double, n int")


def breadth(weekly: DataFrame, bench: DataFrame, horizons: list[int], least: int = 104, per_year: float = 52.0, target: float = 0.5) -> DataFrame:
    """(universe, horizon, n_series, bets_total, bets_active, decisions, breadth, implied_ic) over the whole window.

    weekly: universe, series_id, date, ret; bench: date, bench. Series with ``least`` observations take part, dates on which
    all of them have one. Active returns are those over the benchmark. ``implied_ic`` is the correlation that ``target``
    (return over risk) asks for: target over the root of breadth, breadth being active bets times ``per_year`` / horizon.
    """

    held = Window.partitionBy("universe", "series_id")
    known = weekly.where("ret is not null and not isnan(ret)").withColumn("_n", F.count("*").over(held)).where(F.col("_n") >= least)
    seen = cut(known.join(F.broadcast(bench.select("date", "bench")), "date").select("universe", "series_id", "date", "ret", "bench"))  # one row a week
    sizes = seen.select("universe", "series_id").distinct().groupBy("universe").agg(F.count("*").alias("m"))
    days = seen.groupBy("universe", "date").agg(F.count("*").alias("n")).join(sizes, "universe").where("n = m and m > 1")
    days = days.select("universe", "date", F.row_number().over(Window.partitionBy("universe").orderBy("date")).alias("k"), F.count("*").over(Window.partitionBy("universe")).alias("t")).where("t > 1")
    cells = F.array_sort(F.collect_list(F.struct("k", "ret", (F.col("ret") - F.col("bench")).alias("active"))))  # a calendar at most
    bounded_batches(weekly.sparkSession)
    packed = seen.join(F.broadcast(days), ["universe", "date"]).groupBy("universe", "series_id", "t").agg(cells.alias("c")).select("universe", "t", F.col("c.ret").alias("ret"), F.col("c.active").alias("active"))
    schema = pa.schema([("universe", pa.string()), ("n", pa.int32()), ("total", pa.list_(pa.float64())), ("active", pa.list_(pa.float64()))])

    def gram(x: np.ndarray) -> np.ndarray:
        """Weeks by weeks: its eigenvalues are those of the series' correlations, the zeros aside. Weeks without a benchmark are none."""
        ok = np.isfinite(x).all(axis=0)
        out, y = np.zeros((x.shape[1],) * 2), x[:, ok] - x[:, ok].mean(axis=1, keepdims=True)
        with np.errstate(all="ignore"):
            y = y / np.sqrt((y**2).sum(axis=1, keepdims=True))  # a flat series has no correlation: nan
        out[np.ix_(ok, ok)] = y.T @ y
        return out

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for u in batch.column("universe").unique():
                own = batch.filter(pc.equal(batch.column("universe"), u))
                t = own.column("t")[0].as_py()
                new = [own.num_rows, *(gram(own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, t)) for c in ("ret", "active"))]
                sums[u.as_py()] = [x + y for x, y in zip(sums[u.as_py()], new)] if u.as_py() in sums else new
        for u, (n, *both) in sums.items():
            yield pa.RecordBatch.from_pylist([{"universe": u, "n": n, "total": both[0].ravel(), "active": both[1].ravel()}], schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                u, new = batch.column("universe")[i].as_py(), [batch.column("n")[i].as_py(), *(batch.column(c)[i].values.to_numpy() for c in ("total", "active"))]
                sums[u] = [x + y for x, y in zip(sums[u], new)] if u in sums else new
        for u, (n, *both) in sums.items():
            side = int(np.sqrt(len(both[0])))
            made = [bets(g.reshape(side, side)) if np.isfinite(g).all() else float("nan") for g in both]
            total, active = (None if np.isnan(x) else x for x in made)
            yield pa.RecordBatch.from_pylist([{"universe": u, "n_series": n, "bets_total": total, "bets_active": active}], pa.schema([("universe", pa.string()), ("n_series", pa.int32()), ("bets_total", pa.float64()), ("bets_active", pa.float64())]))

    # A task hands on two squares of weeks a universe; they are summed as they come, so no task holds a universe.
    counted = packed.mapInArrow(some, "universe string, n int, total array<double>, active array<double>").repartition("universe").mapInArrow(whole, "universe string, n_series int, bets_total double, bets_active double")
    decisions = F.lit(per_year) / F.col("horizon")
    out = counted.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("decisions", decisions).withColumn("breadth", F.col("bets_active") * F.col("decisions"))
    return out.select("universe", "horizon", "n_series", "bets_total", "bets_active", "decisions", "breadth", F.when(F.col("breadth") > 0, F.lit(target) / F.sqrt("breadth")).alias("implied_ic"))


def neutral(c: Factored, a: np.ndarray) -> tuple[Factored, np.ndarray]:
    """(omega, way): the covariance over the book of all alike, and its pseudo-inverse times ``a`` as ``lstsq`` with rcond 1e-8 has it.

    That book has no risk over itself; all else has at least the least of the diagonal. With some weight on that direction and
    none of ``a`` in it, omega is solved as it is. Only where so small a part could be cut by rcond the matrix is formed.
    """
    n, m = len(c), len(c.core)
    omega = c.active(np.full(n, 1 / n))
    mean = float(omega.diagonal().mean())
    if n > 1 and (np.diag(c.core) >= 0).all() and float(c.d.min()) > 1e-8 * n * mean:
        core = omega.core.copy()
        core[m, m] += mean / n
        return omega, Factored(omega.d, omega.load, core).solve(a - a.mean())
    return omega, np.linalg.lstsq(omega.formed, a, rcond=1e-8)[0]


def transfer(a: np.ndarray, w: np.ndarray, omega: np.ndarray | Factored, way: np.ndarray | None = None) -> dict[str, float]:
    """How much of views ``a`` active weights ``w`` carry under the active covariance: three coefficients and the condition number (none where ``way``, omega^-1 a, is given).

    full: a'w over the roots of a' omega^-1 a and w' omega w. diagonal: correlation of a over volatility with w times it.
    alignment: correlation of a with omega w. What cannot be formed is nan.
    """
    out = dict.fromkeys(("full", "diagonal", "alignment"), float("nan")) | ({"condition": float(np.linalg.cond(omega))} if way is None else {})
    together = lambda x, y: float(np.corrcoef(x, y)[0, 1]) if min(x.std(), y.std()) >= 1e-15 else float("nan")
    risk, load = np.sqrt(np.maximum(variances(omega), 0)), omega @ w
    if (risk > 0).all():
        out["diagonal"] = together(a / risk, w * risk)
    out["alignment"] = together(a, load)
    best, var = float(a @ (np.linalg.lstsq(omega, a, rcond=1e-8)[0] if way is None else way)), float(w @ load)
    if best > 0 and var > 0:
        out["full"] = float(a @ w) / np.sqrt(best * var)
    return out


def active_covariance(c: np.ndarray, bench: np.ndarray) -> np.ndarray:
    """The covariance of each series' return over the benchmark book's."""
    load = c @ bench
    return c - load[:, None] - load[None, :] + float(bench @ load)


def path_transfer(books: DataFrame, cov: DataFrame | tuple[DataFrame, Trailing]) -> DataFrame:
    """(universe, full, diagonal, alignment, condition_median, condition_max, n_dates): the mean coefficients of a path of books.

    books: universe, date, series_id, w, alpha, bench (benchmark weight); cov: weekly returns and how to estimate, so that books meet
    covariances where those are made, or ``factored`` or ``matrices``. One date of a universe is one row; a matrix is formed of
    the series that the book has, not of all.
    """
    bounded_batches(books.sparkSession)
    rows = F.array_sort(F.collect_list(F.struct("series_id", "w", "alpha", "bench")))
    held = books.groupBy("universe", "date").agg(rows.alias("rows"))

    def row(u: str, d, rows: list[dict], ids: list[str], part: Callable[[list[int]], np.ndarray]) -> list[dict]:
        place = {k: i for i, k in enumerate(ids)}
        rows = [x for x in rows if x["series_id"] in place]
        if len(rows) < 2:
            return []
        w, a, b = (np.array([x[k] or 0.0 for x in rows], float) for k in ("w", "alpha", "bench"))
        return [{"universe": u, "date": d, **transfer(a, w - b, active_covariance(part([place[x["series_id"]] for x in rows]), b))}]

    schema = "universe string, date date, full double, diagonal double, alignment double, condition double"
    columns = [c.split()[0] for c in schema.split(", ")]
    if isinstance(cov, tuple):

        def told(universe: str, asked: dict, made: tuple) -> Iterator[pa.RecordBatch]:
            out = row(universe, asked["as_of"], asked["rows"], made[0], lambda at: made[2].take(at).formed)
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("universe", pa.string()), ("date", pa.date32()), *[(c, pa.float64()) for c in columns[2:]]]))

        per = _as_of(cov[0], held.withColumnRenamed("date", "as_of"), cov[1], told, schema)
    else:
        parts = ["matrix"] if "matrix" in cov.columns else ["d", "load", "core"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                out = []
                for u, d, rows, ids, *flat in zip(p["universe"], p["date"], p["rows"], p["ids"], *[p[c] for c in parts]):
                    whole = lambda at: np.asarray(flat[0], float).reshape(len(ids), len(ids))[np.ix_(at, at)] if len(parts) == 1 else unpacked(dict(zip(parts, flat))).take(at).formed  # noqa: E731, B023
                    out += row(u, d, rows, ids, whole)
                yield pd.DataFrame(out, columns=columns)

        per = held.join(cov.select("universe", F.col("as_of").alias("date"), "ids", *parts), ["universe", "date"]).mapInPandas(run, schema)
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    means = [F.avg(real(c)).alias(c) for c in ("full", "diagonal", "alignment")]
    return per.groupBy("universe").agg(*means, F.median("condition").alias("condition_median"), F.max("condition").alias("condition_max"), F.count(real("full")).alias("n_dates"))
