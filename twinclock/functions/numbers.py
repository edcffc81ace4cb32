"""Number columns: missing values, percentiles, robust and circular statistics, text forms of numbers.

Null stands for a missing number; NaN is turned to null at every source, since Spark orders NaN above all numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mean_finite(x: Column) -> Column:
    return F.avg(finite(x))


def max_finite(x: Column) -> Column:
    return F.max(finite(x))


def min_finite(x: Column) -> Column:
    return F.min(finite(x))


def percentile_n1(x: Column, q: float) -> Column:
    """Linear between the sorted values, the first at 0 and the last at 1."""
    return F.percentile(x, F.lit(q))


def percentile_mid(values: Column, q: float) -> Column:
    """Of an array: linear between the sorted values, the k-th of n at (k - 0.5) / n."""
    v, n = F.sort_array(F.filter(values, lambda x: x.isNotNull())), F.size(F.filter(values, lambda x: x.isNotNull()))
    at = F.least(F.greatest(F.lit(q) * n + 0.5, F.lit(1.0)), n.cast("double"))
    low = F.floor(at).cast("int")
    a, b = F.get(v, low - 1), F.get(v, F.least(low, n - 1))
    return F.when(n > 0, a + (b - a) * (at - low))


def upper_median(values: Column) -> Column:
    """Of an array: the value at n // 2 + 1 of the sorted ones."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def fisher_z(c: Column) -> Column:
    """atanh of the square root of a coherence, which is kept below one."""
    return F.atanh(F.sqrt(F.least(F.greatest(c, F.lit(0.0)), F.lit(1 - 1e-9))))


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def variation(x: Column, eps: float = 2.220446049250313e-16) -> Column:
    """Standard deviation over the mean, which is not taken below eps."""
    return F.stddev_samp(x) / F.greatest(F.avg(x), F.lit(eps))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def empirical_p(null: Column, observed: Column) -> Column:
    """(1 + values at or above the observed one) / (n + 1); the observed one must be the same for all rows."""
    return (1 + F.count_if(null >= observed)) / (F.count(null) + 1)


def printed(x: Column, digits: int) -> Column:
    """The number with so many digits as C prints it: its exact value is rounded, ties to even. Java rounds its shortest text, ties up."""
    return F.udf(lambda v: None if v is None else f"{v:.{digits}f}", "string", useArrow=True)(x)


def fixed(x: Column, digits: int, missing: str = "NaN") -> Column:
    """The number with so many digits, or the text for a missing one."""
    return F.when(finite(x).isNull(), missing).otherwise(printed(x, digits))


def whole(x: Column) -> Column:
    """The nearest whole number, halves away from zero; what is below zero keeps its sign, as in -0."""
    return F.signum(x) * F.round(F.abs(x))


def number_range(low: Column, high: Column, digits: int) -> Column:
    """`low-high`, or empty if one is missing."""
    return F.when(finite(low).isNull() | finite(high).isNull(), "").otherwise(F.concat_ws("-", printed(low, digits), printed(high, digits)))


def number(text: Column) -> Column:
    """The number that a text holds, or null."""
    return finite(F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double"))


def flag(x: Column) -> Column:
    return F.when(x, "1").otherwise("0")


def duration_class(seconds: Column) -> Column:
    return F.when(seconds < 0.75, "short").when(seconds <= 1.25, "mid").when(seconds.isNotNull(), "long")


def third(i: Column, n: Column) -> Column:
    """Which third (1, 2, 3) the i-th of n samples is in; the remainder goes to the last ones."""
    return F.when(i <= F.floor(n / 3), 1).when(i <= F.floor(n * 2 / 3), 2).otherwise(3)
