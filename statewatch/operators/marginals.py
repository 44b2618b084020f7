"""What can be told apart from counts, single columns, small subsets and parities."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import col, total
from statewatch.operators.shaping import stratified_sample
from statewatch.plans import bounded_model


def bernoulli_profile(
    pairs: DataFrame, role: Sequence[str], reference: str, monitor: str, epsilon: float = 1e-4
) -> DataFrame:
    """Smoothed event probability per role and check, both sides pooled: ``(count + 1/2) / (2 n + 1)``."""
    if not 0 < epsilon < 0.5:
        raise ValueError("epsilon must lie in (0, 0.5)")
    both = F.zip_with(reference, monitor, lambda a, b: (a + b).cast("double"))
    cells = pairs.select(*role, F.posexplode(both).alias("chk", "_b"))
    p = (F.sum("_b") + 0.5) / (2 * F.count(F.lit(1)) + 1)
    return cells.groupBy(*role, "chk").agg(F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon)).alias("p"))


# ---------------------------------------------------------------- packed Hamming kernel


@dataclass(frozen=True)
class HammingWitness:
    """Prototypes of both classes as packed words, and the kernel width."""

    null: list[list[int]]
    alternative: list[list[int]]
    bits: int
    gamma: float

    def score(self, words: Column | str) -> Column:
        """Mean kernel to the alternative prototypes minus mean kernel to the null ones."""
        return self._mean(words, self.alternative) - self._mean(words, self.null)

    def _mean(self, words: Column | str, prototypes: list[list[int]]) -> Column:
        table = F.array(*[F.array(*[F.lit(w).cast("bigint") for w in p]) for p in prototypes])

        def kernel(p: Column) -> Column:
            ones = F.zip_with(col(words), p, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
            distance = F.aggregate(ones, F.lit(0), lambda s, x: s + x)
            return F.exp(F.lit(-self.gamma / self.bits) * distance)

        return total(F.transform(table, kernel)) / len(prototypes)


def draw_prototypes(df: DataFrame, label: str, id: str, per_class: int, seed: int) -> DataFrame:
    """``per_class`` rows of class 0 and of class 1, drawn without replacement."""
    return stratified_sample(df.where(F.col(label).isin(0, 1)), label, id, 2 * per_class, 2, seed)


def fit_hamming(prototypes: DataFrame, label: str, words: str, bits: int) -> HammingWitness:
    """Kernel width from the prototypes: ``ln 2 / median positive distance`` (median 1 if all equal)."""
    rows = bounded_model(prototypes.select(label, words))
    sides = {c: [list(r[words]) for r in rows if r[label] == c] for c in (0, 1)}
    if not sides[0] or not sides[1]:
        raise ValueError("both classes need prototypes")
    packed = np.array(sides[0] + sides[1], dtype=np.int64).view(np.uint64).reshape(len(rows), -1)
    gaps = np.bitwise_count(packed[:, None, :] ^ packed[None]).sum(axis=2)[np.triu_indices(len(rows), 1)] / bits
    positive = gaps[gaps > 0]
    median = float(np.median(positive)) if len(positive) else 1.0
    return HammingWitness(sides[0], sides[1], bits, math.log(2) / median)


# ---------------------------------------------------------------- access audits


def marginal_gap(df: DataFrame, label: str, columns: Sequence[str], max_k: int, first, second) -> DataFrame:
    """Total variation distance of the two classes on every set of at most ``max_k`` columns.

    Equal rows are counted first, so the grouping sets expand distinct rows only.
    """
    subsets = [s for k in range(1, max_k + 1) for s in itertools.combinations(columns, k)]
    one = F.count_if(F.col(label) == F.lit(first)).alias("_a")
    two = F.count_if(F.col(label) == F.lit(second)).alias("_b")
    distinct = df.where(F.col(label).isin(first, second)).groupBy(*columns).agg(one, two)
    sizes = distinct.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    cells = distinct.groupingSets([[F.col(c) for c in s] for s in subsets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_g"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")
    )
    gap = F.abs(F.col("_a") / F.col("_na") - F.col("_b") / F.col("_nb"))
    by_set = cells.crossJoin(F.broadcast(sizes)).groupBy("_g").agg((0.5 * F.sum(gap)).alias("distance"))  # sizes: one row
    n = len(columns)
    name = F.lit(None).cast("string")
    for s in subsets:
        code = sum(1 << (n - 1 - i) for i, c in enumerate(columns) if c not in s)
        name = F.when(F.col("_g") == code, F.lit("+".join(s))).otherwise(name)
    named = by_set.withColumn("columns", name)
    return named.select("columns", F.size(F.split("columns", "\\+")).alias("k"), "distance")


#: Codes of so many bits have a table of at most 65,536 counts.
WALSH_WIDTH = 16


def _walsh_means(distinct: DataFrame, width: int, sets: Sequence[Sequence[int]]) -> DataFrame:
    masks = np.array([sum(1 << i for i in s) for s in sets], dtype=np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int32)
    vector = distinct.agg(*[F.collect_list(F.col(c)).alias(c) for c in ("_code", "_a", "_b")])  # at most 2 ** width entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for codes, *counts in zip(pdf["_code"], pdf["_a"], pdf["_b"], strict=True):
                means = []
                for c in counts:
                    table = np.zeros(1 << width)
                    np.add.at(table, np.asarray(codes, np.int64), np.asarray(c, float))
                    total = table.sum()
                    for bit in range(width):  # sums and differences over one bit at a time
                        pair = table.reshape(-1, 2, 1 << bit)
                        table = np.stack([pair[:, 0] + pair[:, 1], pair[:, 0] - pair[:, 1]], axis=1).reshape(-1)
                    means.append(table[masks] / total if total else np.full(len(masks), np.nan))
                yield pd.DataFrame({"n": np.arange(len(masks), dtype=np.int32), "k": sizes, "mask": masks, "mean_first": means[0], "mean_second": means[1]})

    return vector.mapInPandas(run, "n int, k int, mask bigint, mean_first double, mean_second double")


def parity_gaps(df: DataFrame, label: str, code: str, width: int, max_k: int, first=1, second=0) -> DataFrame:
    """Class means of the product of signs on every set of at most ``max_k`` bits.

    Up to ``WALSH_WIDTH`` bits the counts of all codes are one short vector whose Walsh-Hadamard transform holds every mean; beyond, each
    distinct code meets each mask.
    """
    sets = [s for k in range(1, max_k + 1) for s in itertools.combinations(range(width), k)]
    one = F.count_if(F.col(label) == F.lit(first)).alias("_a")
    two = F.count_if(F.col(label) == F.lit(second)).alias("_b")
    low = F.col(code).cast("bigint").bitwiseAND((1 << width) - 1)  # no mask reaches further
    distinct = df.groupBy(low.alias("_code")).agg(one, two)
    if width <= WALSH_WIDTH:
        return _walsh_means(distinct, width, sets).withColumn("gap", F.abs(F.col("mean_first") - F.col("mean_second")))
    masks = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(len(s)).alias("k"), F.lit(sum(1 << i for i in s)).cast("bigint").alias("m"))
            for n, s in enumerate(sets)
        ]
    )
    cells = distinct.select("*", F.explode(masks).alias("_s"))
    sign = 1 - 2 * F.pmod(F.bit_count(F.col("_code").bitwiseAND(F.col("_s.m"))), F.lit(2))
    means = cells.groupBy(F.col("_s.n").alias("n"), F.col("_s.k").alias("k"), F.col("_s.m").alias("mask")).agg(
        (F.sum(sign * F.col("_a")) / F.sum("_a")).alias("mean_first"),
        (F.sum(sign * F.col("_b")) / F.sum("_b")).alias("mean_second"),
    )
    return means.withColumn("gap", F.abs(F.col("mean_first") - F.col("mean_second")))


def parity_scan(df: DataFrame, label: str, code: str, width: int, max_k: int, first=1, second=0, tolerance: float = 1e-12) -> DataFrame:
    """Per subset size: subsets, nonzero gaps, the largest gap and its first subset in lexicographic order."""
    gaps = parity_gaps(df, label, code, width, max_k, first, second)
    level = F.floor(F.col("gap") / tolerance + 0.5)  # equal up to the tolerance counts as a tie
    best = F.max_by(F.struct("mask", "gap"), F.struct(level, -F.col("n")))
    out = gaps.groupBy("k").agg(
        F.count(F.lit(1)).alias("subsets"), F.count_if(F.col("gap") > tolerance).alias("nonzero"), best.alias("_b")
    )
    return out.select("k", "subsets", "nonzero", F.col("_b.gap").alias("max_gap"), F.col("_b.mask").alias("first_mask"))


def marginal_deviation(df: DataFrame, regime: str, bits: str, expected: DataFrame) -> DataFrame:
    """Mean event rate and largest gap between observed and expected event rates, per regime.

    ``expected`` has one row per (regime, chk) with probability ``p``.
    """
    cells = df.select(regime, F.posexplode(bits).alias("chk", "_b"))
    seen = cells.groupBy(regime, "chk").agg(F.avg("_b").alias("rate"))
    joined = seen.join(expected, [regime, "chk"], "left")
    gap = F.max(F.abs(F.col("rate") - F.col("p")))
    return joined.groupBy(regime).agg(F.avg("rate").alias("mean_rate"), F.coalesce(gap, F.lit(0.0)).alias("max_gap"))


def count_gap(df: DataFrame, label: str, bits: str, first, second) -> DataFrame:
    """``marginal_gap`` on the number of events of a row."""
    counted = df.withColumn("events", F.aggregate(bits, F.lit(0), lambda s, b: s + b.cast("int")))
    return marginal_gap(counted, label, ["events"], 1, first, second)


