"""Array and signal functions over array<double> columns (image values as arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    m = mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def min_max(a: Column) -> Column:
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of the min-max normalised arrays."""
    return F.aggregate(F.zip_with(min_max(a), min_max(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def psnr(error: Column) -> Column:
    """Of a mean squared error of values in 0..1; infinite at 0."""
    return F.when(error == 0, float("inf")).otherwise(-10 * F.log10(error))


def quantile(sorted_array: Column, p: float) -> Column:
    """Linear interpolation between the neighbours of a sorted array."""
    at = (F.size(sorted_array) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_array, low), F.get(sorted_array, F.least(low + 1, F.size(sorted_array) - 1))
    return a + (b - a) * (at - low)


def snr(a: Column) -> Column:
    """Mean of the values from the 75th percentile up over the deviation of those up to the 25th."""
    s = F.array_sort(a)
    low, high = quantile(s, 0.25), quantile(s, 0.75)
    noise = deviation(F.filter(a, lambda x: x <= low))
    return F.when(noise > 0, mean(F.filter(a, lambda x: x >= high)) / noise)


def entropy(rows: DataFrame, row_id: str, a: str, bins: int, low: float, high: float) -> DataFrame:
    """(row_id, entropy) in bits of the values' histogram."""
    bin_ = F.floor((F.col("x") - low) / (high - low) * bins)
    counted = rows.select(row_id, F.explode(a).alias("x")).groupBy(row_id, bin_.alias("bin")).agg(F.count("*").alias("n"))
    sums = counted.groupBy(row_id).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(row_id, F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def histogram_stats(rows: DataFrame, row_id: str, a: str) -> DataFrame:
    """(row_id, mean, sd, skewness, kurtosis, range, low, high): moments of a row's values within its own 1st and 99th percentiles, range and ends of all of them.

    Kurtosis is in excess of 3, moments are of the population; of values that are all equal skewness and kurtosis are null.
    """
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)))
    cut = rows.select(row_id, s.alias("_s")).select(row_id, quantile(F.col("_s"), 0.01).alias("_p1"), quantile(F.col("_s"), 0.99).alias("_p99"), F.explode("_s").alias("x"))
    x = F.when(F.col("x").between(F.col("_p1"), F.col("_p99")), F.col("x"))
    moments = (F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    return cut.groupBy(row_id).agg(*moments, (F.max("x") - F.min("x")).alias("range"), F.min("x").alias("low"), F.max("x").alias("high"))


def auto_window(a: Column) -> Column:
    """struct(center, width) from the 0.5 and 99.5 percentiles of the values that aren't zero."""
    s = F.array_sort(F.filter(a, lambda x: x != 0))
    low, high = quantile(s, 0.005), quantile(s, 0.995)
    return F.struct(((low + high) / 2).alias("center"), (high - low).alias("width"))


def apply_window(a: Column, window: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    low, high = window["center"] - window["width"] / 2, window["center"] + window["width"] / 2
    return F.transform(a, lambda x: F.least(F.greatest(x * slope + intercept, low), high))


def roi_noise(a: Column, regions: list[tuple[int, int]]) -> Column:
    """Mean of the deviations of slices (first from 1, length)."""
    return sum((deviation(F.slice(a, i, n)) for i, n in regions), F.lit(0.0)) / len(regions)


def quality_grade(psnr_: Column, ssim: Column, snr_: Column, contrast: Column) -> Column:
    one = F.lit(1.0)
    score = 0.3 * F.least(psnr_ / 50, one) + 0.4 * ssim + 0.2 * F.least(snr_ / 30, one) + 0.1 * F.least(contrast / 100, one)
    return F.when(score >= 0.8, "A").when(score >= 0.6, "B").when(score >= 0.4, "C").otherwise("D")


def one_way_f(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(f, groups, n): the F statistic of value between groups, from sums by group."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    return s.select(F.round(between / (F.col("w") / (F.col("n") - F.col("k"))), 6).alias("f"), F.col("k").alias("groups"), "n")


def preserved(a: Column, b: Column) -> Column:
    """Whether the range ratio is within 0.95..1.05 and no value differs by 1 or more beyond the common offset."""
    ratio = (F.array_max(b) - F.array_min(b)) / (F.array_max(a) - F.array_min(a))
    offset = F.array_min(b) - F.array_min(a)
    worst = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(y - x - offset)))
    return ratio.between(0.95, 1.05) & (worst < 1)


def stable_sample(rows: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """n rows by order of a hash of id and seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(seed))), row_id).limit(n)
