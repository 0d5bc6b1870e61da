"""Scalar expressions: cleaning, clipping, horizons, conviction, costs, labels. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that vendors write for a missing number.
MISSING = ("#N/A", "#N/A N/A", "", "NA", "nan")


def to_missing(raw: Column) -> Column:
    """A number, or null for a missing marker or anything that is not one."""
    value = raw.try_cast("double")
    return F.when(F.trim(raw).isin(*MISSING), None).otherwise(F.when(F.isnan(value), None).otherwise(value))


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def full_window(value: Column, count: Column, n: int) -> Column:
    """``value`` where ``count`` rows fill the window."""
    return F.when(count >= n, value)


def guarded_ratio(x: Column, y: Column, least: float = 1e-12) -> Column:
    return F.when(F.abs(y) >= least, x / y)


def horizon(low: Column, high: Column) -> Column:
    """The rounded geometric mean of a horizon's ends."""
    return F.floor(F.sqrt(low * high) + 0.5).cast("int")


def parse_horizon(text: Column) -> Column:
    """'4-13' or '4' as (low, high); null if malformed."""
    ok = text.rlike(r"^\d+(-\d+)?$")
    parts = F.split(text, "-")
    return F.when(ok, F.struct(parts[0].cast("int").alias("low"), F.element_at(parts, -1).cast("int").alias("high")))


def split_first(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first ``mark``; all of it and null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring_index(text, mark, 1)).otherwise(text), F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def huber(u: Column, c: float = 1.345) -> Column:
    a = F.abs(u)
    return F.when(a <= c, 0.5 * u * u).otherwise(c * a - 0.5 * c * c)


def within(x: Column, cap: Column) -> Column:
    """x <= cap up to a relative 1e-9."""
    return x <= cap * (1 + 1e-9)


def normalised(p: Column) -> Column:
    """Probabilities scaled to one; null if one is negative or all are zero."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.forall(p, lambda x: x >= 0) & (total > 0), F.transform(p, lambda x: x / total))


def entropy_conviction(p: Column) -> Column:
    """1 - H(p) / ln K in [0, 1]."""
    h = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, clip(1 - h / F.log(F.size(p).cast("double")), 0.0, 1.0))


def max_probability_conviction(p: Column) -> Column:
    k = F.size(p).cast("double")
    return F.when(F.size(p) > 1, (F.array_max(p) - 1 / k) / (1 - 1 / k))


def combined_conviction(a: Column, b: Column, form: str, weight: float = 0.5) -> Column:
    """product, geometric, min, weighted, first or second."""
    return {"product": a * b, "geometric": F.sqrt(a * b), "min": F.least(a, b), "weighted": weight * a + (1 - weight) * b, "first": a, "second": b}[form]


def turnover_penalty(t: Column, start: float = 0.75, reference: float = 1.50, bp: float = 40.0, per_year: int = 52) -> Column:
    return bp / 1e4 * F.greatest(F.lit(0.0), t - start) / (reference - start) / per_year


def created_quadratic(base: Column, x: Column, a: float) -> Column:
    """The quadratic cost that x adds to what ``base`` already costs: a (pos(base + x)^2 - pos(base)^2)."""
    pos = lambda v: F.greatest(F.lit(0.0), v)
    return a * (pos(base + x) * pos(base + x) - pos(base) * pos(base))


def te_coefficient(conviction: Column, low: float, high: float) -> Column:
    """Linear from ``high`` at no conviction to ``low`` at full."""
    return high + (low - high) * clip(conviction, 0.0, 1.0)


def tier(start: Column) -> Column:
    """A series' tier by the date its daily history starts."""
    return F.when(start <= F.lit("2001-12-31").cast("date"), "backbone").when(start <= F.lit("2009-12-31").cast("date"), "second").otherwise("tradable_only")


def run_label(passed: Column, ir: Column, bar: float = 0.30) -> Column:
    return F.when(passed.isNull(), "").when(passed & (ir >= bar), "candidate").otherwise("not detected")


def group_key(first: Column, second: Column) -> Column:
    """'first/second'; a blank or 'all' label forms no group, a blank refinement leaves the first."""
    ok = F.coalesce(first, F.lit("")).isin("", "all")
    return F.when(ok, None).otherwise(F.concat_ws("/", first, F.when(second.isin("", "all"), None).otherwise(second)))


def view_scale(ic: float, sigma: Column, z: Column, h: Column) -> Column:
    return ic * sigma * z / F.sqrt(h)


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by a bar, 52 bits of it: the same in any engine."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number from the same parts."""
    return F.sqrt(-2 * F.log(1 - unit(*parts, 1))) * F.cos(F.lit(2 * 3.141592653589793) * unit(*parts, 2))
