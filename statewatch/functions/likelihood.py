"""Closed-form likelihood of a binary grid row under translated two-endpoint templates.

A row is either noise only or one chain of length 1 or 2 placed uniformly on a periodic grid,
seen through independent bit flips with probability ``eps``. Averaging over all templates needs
only how many templates have 0, 1 or 2 of their endpoints set, and these counts follow from
``grid_counts``. Scoring a row is therefore scalar arithmetic inside one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from statewatch.functions.arrays import let, log0, log_sum_exp
from statewatch.functions.bits import grid_counts, grid_pair_stats


def _log(p: float) -> float:
    return math.log(p) if p > 0 else float("-inf")


@dataclass(frozen=True)
class TemplateModel:
    size: int
    event: float
    eps: float

    def __post_init__(self) -> None:
        if self.size < 3 or self.size % 2 == 0:
            raise ValueError("size must be odd and at least 3")
        if not (0 <= self.event <= 1 and 0 <= self.eps <= 1):
            raise ValueError("event and eps are probabilities")

    @property
    def sites(self) -> int:
        return self.size * self.size

    def _flips(self, distance: Column) -> Column:
        """Log probability that exactly the ``distance`` differing sites were flipped."""
        if self.eps == 0:
            return F.when(distance == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))
        if self.eps == 1:
            return F.when(distance == self.sites, F.lit(0.0)).otherwise(F.lit(float("-inf")))
        return distance * F.lit(math.log(self.eps)) + (self.sites - distance) * F.lit(math.log1p(-self.eps))

    def conditional(self, counts: Column, length: int) -> Column:
        """Log likelihood given the chain length (1 or 2)."""
        s, both = counts["s"], counts["c1"] if length == 1 else counts["c2"]
        templates = 2.0 * self.sites
        one = 4.0 * s - 2.0 * both
        none = templates - one - both
        mixed = log_sum_exp(
            log0(none) + self._flips(s + 2), log0(one) + self._flips(s), log0(both) + self._flips(s - 2)
        ) - F.lit(math.log(templates))
        return log_sum_exp(F.lit(_log(1 - self.event)) + self._flips(s), F.lit(_log(self.event)) + mixed)

    def loglik(self, counts: Column, q: float) -> Column:
        """Log likelihood when length 2 has probability ``q``."""
        return log_sum_exp(
            F.lit(_log(1 - q)) + self.conditional(counts, 1), F.lit(_log(q)) + self.conditional(counts, 2)
        )

    def ratio(self, counts: Column, q: float, q0: float) -> Column:
        """Likelihood ratio with the log clipped to +-700."""
        gap = self.loglik(counts, q) - self.loglik(counts, q0)
        return F.exp(F.least(F.greatest(gap, F.lit(-700.0)), F.lit(700.0)))

    def ratios(self, counts: Column, qs: Sequence[float], q0: float) -> Column:
        """``(q, ratio)`` for every ``q``: as ``ratio``, with the likelihoods given the length and that of ``q0`` worked out once."""

        def mixed(c: Column, q: float) -> Column:
            return log_sum_exp(F.lit(_log(1 - q)) + c["one"], F.lit(_log(q)) + c["two"])

        def cells(c: Column) -> Column:
            def cell(q: float, base: Column) -> Column:
                gap = F.least(F.greatest(mixed(c, q) - base, F.lit(-700.0)), F.lit(700.0))
                return F.struct(F.lit(q).alias("q"), F.exp(gap).alias("ratio"))

            return let(mixed(c, q0), lambda base: F.array(*[cell(q, base) for q in qs]))

        return let(F.struct(self.conditional(counts, 1).alias("one"), self.conditional(counts, 2).alias("two")), cells)

    def transition(self, q: float, kappa: float) -> list[list[float]]:
        """Repeat the length with probability ``kappa``, otherwise draw it afresh."""
        fresh = [1 - q, q]
        return [[kappa * (i == j) + (1 - kappa) * fresh[j] for j in (0, 1)] for i in (0, 1)]

    def pair_loglik(self, first: Column, second: Column, q: float, kappa: float) -> Column:
        """Log likelihood of two consecutive rows under the two-state chain."""
        step, start = self.transition(q, kappa), [1 - q, q]
        return log_sum_exp(
            *[
                F.lit(_log(start[i]) + _log(step[i][j]))
                + self.conditional(first, i + 1)
                + self.conditional(second, j + 1)
                for i in (0, 1)
                for j in (0, 1)
            ]
        )

    def length_score(self, counts: Column, q: float) -> Column:
        """Standardised posterior of length 2: ``(P(2 | row) - q) / sqrt(q (1 - q))``."""
        if not 0 < q < 1:
            raise ValueError("q must lie strictly between 0 and 1")
        posterior = F.exp(F.lit(math.log(q)) + self.conditional(counts, 2) - self.loglik(counts, q))
        return (posterior - q) / math.sqrt(q * (1 - q))

    def statistic_ratio(self, bits: Column | str, q0: float, q1: float) -> Column:
        """Log ratio from the three translation statistics alone."""
        t = grid_pair_stats(bits, self.size)
        h = math.log((1 - self.eps) / self.eps)
        c, s = math.cosh(h), math.sinh(h)
        k1 = c * c - 2 * c * s * t["z"] + s * s * t["g1"]
        k2 = c * c - 2 * c * s * t["z"] + s * s * t["g2"]

        def weight(q: float) -> Column:
            return (1 - self.event) + self.event * ((1 - q) * k1 + q * k2)

        return F.log(weight(q1)) - F.log(weight(q0))

    def counts(self, bits: Column | str) -> Column:
        return grid_counts(bits, self.size)
