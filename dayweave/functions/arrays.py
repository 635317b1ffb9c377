"""Expressions on arrays: medians, dot products, soft maxima. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it: an expression inside a lambda is otherwise evaluated anew
    for every element, and nesting multiplies that."""
    return F.get(F.transform(F.array(value), body), 0)


def median(xs: Column) -> Column:
    """The exact median of an array without nulls, the mean of the middle two for an even size; null if empty."""
    return let(F.array_sort(xs), lambda s: F.when(F.size(s) > 0, (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2))


def mad(xs: Column, centre: Column) -> Column:
    """The median distance from centre."""
    return median(F.transform(xs, lambda x: F.abs(x - centre)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, least: float = 1e-12) -> Column:
    """Divided by the norm, or by `least` if the norm is smaller."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(least)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def normalised_or_same(a: Column, least: float = 1e-9) -> Column:
    """Divided by the norm; unchanged if that is below `least`."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n < least, x.cast("double")).otherwise(x.cast("double") / n))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; 2 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 2.0).otherwise(1 - dot(a, b) / n)


def logsumexp(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))))


def log_softmax(z: Column) -> Column:
    return let(z, lambda v: let(logsumexp(v), lambda low: F.transform(v, lambda x: x - low)))


def softmax(z: Column, temperature: float = 1.0) -> Column:
    """Max-shifted, at a temperature."""
    scaled = F.transform(z, lambda x: x.cast("double") / temperature)
    shifted = let(scaled, lambda t: let(F.array_max(t), lambda top: F.transform(t, lambda x: F.exp(x - top))))
    return let(shifted, lambda e: let(total(e), lambda n: F.transform(e, lambda x: x / n)))


def adjusted(z: Column, log_prior: Column, tau) -> Column:
    """Logits less tau times the log-prior."""
    return F.zip_with(z, log_prior, lambda x, p: x - tau * p)


def mean_of(streams: list[Column]) -> Column:
    """Element-wise mean."""
    n = len(streams)
    return F.transform(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), streams), lambda x: x / n)


def log_of_mean_probabilities(streams: list[Column], floor: float = 1e-12) -> Column:
    return F.transform(mean_of([softmax(s) for s in streams]), lambda p: F.log(F.greatest(p, F.lit(floor))))


def argmax(z: Column) -> Column:
    """First position of the greatest element."""
    return let(z, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def margin(p: Column) -> Column:
    """Difference of the two greatest log-probabilities."""
    return let(F.sort_array(p, asc=False), lambda s: F.log(F.greatest(F.get(s, 0), F.lit(1e-12))) - F.log(F.greatest(F.get(s, 1), F.lit(1e-12))))
