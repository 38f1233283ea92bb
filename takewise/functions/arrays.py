"""Array expressions: statistics, resampling and similarity, all inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def spread(a: Column) -> Column:
    """Population standard deviation, around the mean."""
    return let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def rounded(a: Column, digits: int = 4) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def half_up(x: Column, digits: int) -> Column:
    """Numbers of 0 or more rounded in floating point, as DuckDB does it; F.round makes a decimal of each, which takes longer."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + 0.5) / scale


def znorm(a: Column) -> Column:
    """(x - mean) / population deviation; zeros if the deviation is 1e-8 at most."""
    stats = F.struct(mean(a).alias("m"), spread(a).alias("s"))
    return let(stats, lambda t: F.transform(a, lambda x: F.when(t["s"] > 1e-8, (x - t["m"]) / t["s"]).otherwise(0.0)))


def deltas(a: Column) -> Column:
    """The differences of neighbours; empty for fewer than two values."""
    return F.when(F.size(a) > 1, F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda y, x: y - x)).otherwise(F.array().cast("array<double>"))


def quantised(a: Column, small: float = 0.25, big: float = 1.0) -> Column:
    """Steps of a curve in five sizes from -2 to 2, by thresholds in deviations of the steps; exactly big is a small step."""

    def sized(d: Column) -> Column:
        return let(spread(d), lambda w: F.transform(d, lambda x: F.when(x > big * w, 2).when(x > small * w, 1).when(x < -big * w, -2).when(x < -small * w, -1).otherwise(0)))

    return let(deltas(a), sized)


def resampled(a: Column, n: int) -> Column:
    """n values by linear interpolation on a grid from 0 to the number of values, so the end holds the last value."""
    m = F.size(a)

    def at(k: Column) -> Column:
        x = k * m / F.lit(n - 1)
        i = F.least(F.floor(x).cast("int"), m - 1)
        low, high = F.element_at(a, i + 1), F.element_at(a, F.least(i + 2, m))
        return F.when(i >= m - 1, F.element_at(a, -1)).otherwise(low + (high - low) * (x - i))

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).otherwise(F.array().cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, the shorter one filled with zeros, no less than 0; 0 if one is empty or next to zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    one, two = (F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) for v in (a, b))
    return F.when((F.size(a) < 1) | (F.size(b) < 1) | (one < 1e-10) | (two < 1e-10), 0.0).otherwise(F.greatest(F.lit(0.0), dot / (one * two)))


def smoothness(a: Column, lags: int = 20, least: int = 20) -> Column:
    """How far a curve moves in one direction: the mean autocorrelation of its steps at lags 1 to lags - 1, no less than 0.

    0 for fewer than 10 values or a flat curve, 1 for fewer than least steps.
    """

    def product(d: Column, lag: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(d, F.lit(1), F.size(d) - lag), F.slice(d, lag + 1, F.size(d) - lag), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def quality(d: Column) -> Column:
        reach = F.least(F.lit(lags), F.size(d)) - 1
        sums = F.aggregate(F.sequence(F.lit(1), reach), F.lit(0.0), lambda s, k: s + product(d, k))
        return let(product(d, F.lit(0)), lambda zero: F.when(zero > 0, sums / zero / reach).otherwise(0.0))

    value = let(deltas(znorm(a)), quality)
    return F.when(F.size(a) < 10, 0.0).when(spread(a) < 1e-8, 0.0).when(F.size(a) - 1 < least, 1.0).otherwise(F.greatest(F.lit(0.0), value))


def warped(a: Column, b: Column) -> Column:
    """Similarity of a with the part of b that fits it best, by warping without a step along b alone: 1 is equal, 0 far off.

    Every value of a is used; where b begins and ends is open. Each row adds the squared difference to the lesser of the
    cost above and the cost above and before. For small data; matching.score_blocks does it for many pairs at a time.
    """
    m = F.size(b)
    zero = F.transform(F.sequence(F.lit(0), m), lambda j: F.lit(0.0))

    def step(row: Column, x: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(1), m), lambda j: F.pow(x - F.element_at(b, j), F.lit(2.0)) + F.least(F.element_at(row, j), F.element_at(row, j + 1)))
        return F.concat(F.array(F.lit(float("inf"))), cells)

    last = F.aggregate(a, zero, step)
    cost = F.array_min(F.slice(last, 2, m)) / F.least(F.size(a), m)
    return F.when((F.size(a) < 1) | (m < 1), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - cost / 2))
