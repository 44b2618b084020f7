"""Bounded scores, betting factors and signed top-k extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from statewatch.functions.arrays import col, doubles, let
from statewatch.plans.guards import require


def bounded_score(score: Column | str, tolerance: float = 1e-12) -> Column:
    """Clip a score that is within ``tolerance`` of [-1, 1]; anything else fails the query."""
    s = col(score).cast("double")
    inside = ~F.isnan(s) & (F.abs(s) <= 1.0 + tolerance)
    return require(inside, F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)), "score must lie in [-1, 1]")


def bet_factors(score: Column | str, bets: Sequence[float], two_sided: bool = False) -> Column:
    """``1 + beta * score`` per bet; two-sided order is +b0, -b0, +b1, ..."""
    if any(not 0 < b <= 1 for b in bets):
        raise ValueError("bets must lie in (0, 1]")
    signed = [sign * b for b in bets for sign in ((1, -1) if two_sided else (1,))]
    return let(
        bounded_score(score),
        lambda s: F.array(*[F.greatest(1.0 + F.lit(float(b)) * s, F.lit(0.0)) for b in signed]),
    )


def top_k_signed(v: Column | str, k: int) -> Column:
    """The k entries of largest magnitude become ``+-1/k``; ties go to the lower index, 0 counts as +."""

    def chosen(a: Column) -> Column:
        ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
        return F.transform(F.slice(ranked, 1, k), lambda e: e["i"])

    def weights(a: Column) -> Column:
        def at(picked: Column) -> Column:
            sign = lambda x: F.when(x < 0, F.lit(-1.0 / k)).otherwise(F.lit(1.0 / k))
            return F.transform(a, lambda x, i: F.when(F.array_contains(picked, i), sign(x)).otherwise(F.lit(0.0)))

        return require(F.size(a) >= k, let(chosen(a), at), "k exceeds the dimension")

    return let(doubles(v), weights)


def capped_simplex_top_k(v: Column | str, k: int) -> Column:
    """The same extreme as a nonnegative vector of twice the length that sums to one."""
    return let(
        top_k_signed(v, k),
        lambda w: F.concat(
            F.transform(w, lambda x: F.greatest(x, F.lit(0.0))), F.transform(w, lambda x: F.greatest(-x, F.lit(0.0)))
        ),
    )


def effect_from_direction(v: Column | str, tolerance: float = 1e-12) -> Column:
    """``(v - min) / (max - min)``; zeros when the range is within ``tolerance``."""

    def mapped(a: Column) -> Column:
        edges = F.struct(F.array_min(a).alias("low"), (F.array_max(a) - F.array_min(a)).alias("span"))
        unit = lambda e, x: F.when(e["span"] <= tolerance, F.lit(0.0)).otherwise((x - e["low"]) / e["span"])
        return let(edges, lambda e: F.transform(a, lambda x: unit(e, x)))

    return let(doubles(v), mapped)
