"""Column expressions over peak lists (arrays of m/z and intensity), and m/z bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def l2_normalise(x: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(x), F.lit(floor))
    return F.transform(x, lambda v: v / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def process(mz: Column, intensity: Column, precursor: Column, low: float = 50.0, high: float = 2500.0, tolerance: float = 2.0, relative: float = 0.01, top: int = 200) -> Column:
    """Peaks (mz, intensity) in range, away from the precursor, above a share of the largest, the `top` largest by m/z, square-rooted and L2-normalised."""
    peaks = F.filter(F.zip_with(mz, intensity, lambda m, i: F.struct(i.alias("intensity"), m.alias("mz"))), lambda p: p["mz"].between(low, high) & (F.abs(p["mz"] - precursor) > tolerance))
    most = F.coalesce(F.array_max(F.transform(peaks, lambda p: p["intensity"])), F.lit(0.0))
    best = F.slice(F.reverse(F.array_sort(F.filter(peaks, lambda p: p["intensity"] >= relative * most))), 1, top)
    length = F.greatest(F.sqrt(F.aggregate(best, F.lit(0.0), lambda a, p: a + p["intensity"])), F.lit(1e-12))
    return F.array_sort(F.transform(best, lambda p: F.struct(p["mz"].alias("mz"), (F.sqrt(p["intensity"]) / length).alias("intensity"))))


def pad(x: Column, size: int, value: float = 0.0) -> Column:
    """First `size` values, filled up."""
    return F.concat(F.slice(x, 1, size), F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(x), F.lit(0))))


def max_normalise(x: Column) -> Column:
    """Shares of the largest; unchanged where that is not positive, empty for null."""
    most = F.array_max(x)
    return F.when(x.isNull(), F.array().cast("array<double>")).when(most > 0, F.transform(x, lambda v: v / most)).otherwise(x)


def fixed_bin(mz: Column, width: float, low: float = 0.0) -> Column:
    return F.floor((mz - low) / width).cast("long")


def ppm_bin(mz: Column, ppm: float, low: float = 50.0) -> Column:
    """Bins of constant relative width."""
    return F.floor(F.log(mz / low) / F.log(F.lit(1 + ppm * 1e-6))).cast("long")


def mu_law(x: Column, k: float) -> Column:
    return F.signum(x) * F.log1p(k * F.abs(x)) / F.log1p(F.lit(k))


def mu_law_inverse(y: Column, k: float) -> Column:
    return F.signum(y) * (F.pow(F.lit(1 + k), F.abs(y)) - 1) / k


def entropy_bits(counts: Column) -> Column:
    """Of an array of counts."""
    n = total(F.transform(counts, lambda c: c.cast("double")))
    return F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))
