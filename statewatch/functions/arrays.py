"""Small dense-vector helpers built from Spark's array functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector(values: Sequence[float]) -> Column:
    """A literal ``array<double>``."""
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Array lambdas recompute whatever they capture for every element; a lambda variable is not
    recomputed, so this keeps nested array expressions linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column | str, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(col(a), lambda x: x * f))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def outer(a: Column | str, b: Column | str) -> Column:
    """Row-major outer product as one flat array."""
    return let(col(b), lambda right: F.flatten(F.transform(col(a), lambda x: F.transform(right, lambda y: x * y))))


def doubles(a: Column | str) -> Column:
    return col(a).cast("array<double>")


def finite(a: Column | str) -> Column:
    """True when no element is NULL, NaN or infinite."""
    return F.forall(doubles(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def log0(x: Column) -> Column:
    """Natural logarithm with ``log 0 = -inf`` (Spark's own gives NULL)."""
    return F.coalesce(F.log(x), F.lit(float("-inf")))


def log_sum_exp(*terms: Column) -> Column:
    """``log sum exp`` that evaluates every term once, so nesting stays linear in size."""
    none = F.lit(float("-inf"))

    def add(acc: Column, x: Column) -> Column:
        return F.when(x == none, acc).otherwise(F.greatest(acc, x) + F.log1p(F.exp(-F.abs(acc - x))))

    return F.aggregate(F.array(*terms), none, add)
