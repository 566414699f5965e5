"""Column functions on numbers and arrays of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(cost: Column) -> Column:
    return F.exp(-cost)


def cost(confidence_: Column) -> Column:
    return -F.ln(confidence_)


def relative_cost(keyword: Column, before: Column, after: Column, length: Column, length_before: Column, length_after: Column) -> Column:
    """A keyword's cost with its neighbours', over their lengths; a neighbour that is null is not there."""
    side = lambda c, n: (F.coalesce(c, F.lit(0.0)), F.when(c.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), n)))
    (c1, n1), (c2, n2) = side(before, length_before), side(after, length_after)
    return (keyword + c1 + c2) / (length + n1 + n2)


def lm_score(post: Column, test: Column, train: Column, lam: float = 0.5) -> Column:
    """The language-model score of a reading from its costs."""
    return lam * post + (1 - lam) * (test - train)


def quantise(x: Column, low: float, high: float, bits: int) -> Column:
    """Linear map of [low, high] to signed integers of so many bits, clamped."""
    top = 2 ** (bits - 1)
    a = (2 * top - 1) / (high - low)
    return F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.floor(F.lit(a) * (x - low) - top))).cast("int")


def dequantise(q: Column, low: float, high: float, bits: int) -> Column:
    top = 2 ** (bits - 1)
    return (q + top + 0.5) * ((high - low) / (2 * top - 1)) + low


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is found once a row; within a lambda it would be found again for each element."""
    return F.transform(F.array(value), fn)[0]


def softmax(xs: Column) -> Column:
    """Of an array, by way of its maximum."""
    shares = lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return once(xs, lambda v: once(F.array_max(v), lambda most: once(F.transform(v, lambda x: F.exp(x - most)), shares)))


def log_sum_exp(xs: Column) -> Column:
    return once(xs, lambda v: once(F.array_max(v), lambda most: most + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - most)))))


def trimmed_mean(xs: Column, least: float | None = None) -> Column:
    """The mean of the sorted values from n/4 up to 3n/4; at least ``least``."""
    n = F.size(xs)
    low, high = F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int")
    own = F.slice(F.array_sort(xs), low + 1, F.greatest(F.lit(1), high - low))
    mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)
    return F.when(n > 0, mean if least is None else F.greatest(mean, F.lit(least)))


def deep(xs: Column, size: int) -> Column:
    """An array cut into arrays of ``size``; null where it doesn't divide."""
    n = F.size(xs)
    cut = F.transform(F.sequence(F.lit(0), (n / size).cast("int") - 1), lambda i: F.slice(xs, i * size + 1, F.lit(size)))
    return F.when((n % size == 0) & (n > 0), cut).when(n == 0, F.array().cast("array<array<double>>"))


def rmse(a: Column, b: Column) -> Column:
    """Aggregate: the root of the mean squared difference."""
    return F.sqrt(F.avg(F.pow(a - b, 2)))
