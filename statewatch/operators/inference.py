"""Intervals, bounded-mean tests, multiplicity and rank tests on result tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewatch.functions.arrays import col
from statewatch.operators.evaluation import average_rank
from statewatch.plans import place, require
from statewatch.plans.guards import null_safe

# ---------------------------------------------------------------- distribution tails


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + step * d) or tiny)
        c = (1.0 + step / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15 and i:
            break
    return front * (f - 1.0)


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
        if high - low < 1e-16:
            break
    return 0.5 * (low + high)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square: finite sums for integer degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, sum_ = math.exp(-half), 0.0
        for k in range(df // 2):
            sum_ += term
            term *= half / (k + 1)
        return min(1.0, sum_)
    term, sum_ = math.sqrt(half) * math.exp(-half) / math.gamma(1.5), 0.0
    for k in range(1, (df + 1) // 2):
        sum_ += term
        term *= half / (k + 0.5)
    return min(1.0, math.erfc(math.sqrt(half)) + sum_)


def signed_rank_tail(w: float, n: int) -> float:
    """Two-sided exact p of the smaller signed-rank sum, by counting sign vectors."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return min(1.0, 2.0 * ways[: int(math.floor(w)) + 1].sum() / 2.0**n)


# ---------------------------------------------------------------- I1 intervals


def wilson(k: Column | str, n: Column | str, confidence: float = 0.95) -> Column:
    """Score interval: the two roots p of ``(k - n p)^2 = z^2 n p (1 - p)``.

    In p that is ``(n + z^2) p^2 - (2 k + z^2) p + k^2 / n = 0``.
    """
    square = NormalDist().inv_cdf(0.5 + confidence / 2) ** 2
    trials, found = col(n).cast("double"), col(k).cast("double")
    hits = require((found >= 0) & (trials >= found) & (trials > 0), found, "need trials > 0 and hits between 0 and trials")
    middle = (hits + square / 2) / (trials + square)
    spread = F.sqrt(square * (hits * (trials - hits) / trials + square / 4)) / (trials + square)
    return F.struct((middle - spread).alias("lower"), (middle + spread).alias("upper"))


def clopper_pearson(k: Column | str, n: Column | str, confidence: float = 0.95) -> Column:
    """Exact equal-tailed binomial interval, 0 and 1 at the edges."""
    tail = (1 - confidence) / 2

    @F.pandas_udf("lower double, upper double")
    def interval(hits: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for x, m in zip(hits, size, strict=True):
            if m < 1 or not 0 <= x <= m:
                raise ValueError("require trials >= 1 and 0 <= successes <= trials")
            low = 0.0 if x == 0 else beta_quantile(tail, x, m - x + 1)
            high = 1.0 if x == m else beta_quantile(1 - tail, x + 1, m - x)
            rows.append((low, high))
        return pd.DataFrame(rows, columns=["lower", "upper"])

    return interval(col(k), col(n))


# ---------------------------------------------------------------- I9, I10


def hoeffding(df: DataFrame, diff: str, horizon: float, alpha: float, key: Sequence[str] = ()) -> DataFrame:
    """One-sided p-value and upper bound for the mean of differences bounded by +-horizon."""
    d = F.col(diff)
    good = ~F.isnan(d) & (F.abs(d) <= horizon + 1e-9)
    out = df.groupBy(*key).agg(
        F.avg(require(good, d.cast("double"), "differences must lie in [-H, H]")).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    down = F.greatest(F.lit(0.0), -F.col("mean"))
    p = F.least(F.lit(1.0), F.exp(-F.col("n") * down * down / (2.0 * horizon * horizon)))
    upper = F.col("mean") + horizon * F.sqrt(2.0 * math.log(1.0 / alpha) / F.col("n"))
    return out.select(*key, "n", "mean", p.alias("p"), upper.alias("upper"))


def holm(df: DataFrame, p: str, by: Sequence[str] = (), id: Sequence[str] = ()) -> DataFrame:
    """Holm-adjusted p-values (``holm``) inside each ``by``."""
    checked = df.withColumn(p, require((F.col(p) >= 0) & (F.col(p) <= 1), F.col(p), "p-values must lie in [0, 1]"))
    size = checked.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    rows = null_safe(place(checked, by, [p, *id], "_k").rows(), size, list(by))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_k") + 1) * F.col(p))
    placed = place(rows.withColumn("_s", step), by, ["_k"], "_j")
    return placed.running(holm=("max", F.col("_s"))).rows().drop("_k", "_j", "_m", "_s")


# ---------------------------------------------------------------- I11 sign flips


def sign_flip(df: DataFrame, diff: str, key: Sequence[str] = (), largest: int = 24) -> DataFrame:
    """Exact two-sided sign-flip p: share of all 2**n sign vectors with a mean at least as large.

    n is bounded by ``largest``. The vectors are split in two stages, so that even one key
    spreads over the cluster.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    # checked before anything is gathered: a key that is too long never meets collect_list
    small = require(F.col("_size") <= largest, F.col("_size"), f"sign flips are exact up to {largest} rows")
    checked = null_safe(df, sizes.select(*key, small.alias("_size")), list(key)).where("_size > 0")
    groups = checked.groupBy(*key).agg(F.collect_list(F.col(diff).cast("double")).alias("_d"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("int")
    rows = groups.select(*key, "n", "_d").withColumn(
        "_obs", F.abs(F.aggregate("_d", F.lit(0.0), lambda s, x: s + x)) / F.col("n")
    )
    low = F.least(n, F.lit(12))
    high = rows.withColumn("_h", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), n - low) - 1).cast("int"))))
    spread = high.repartition(F.col("_h"))
    flips = spread.withColumn("_l", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), low) - 1).cast("int"))))
    code = F.col("_h").cast("bigint") * F.pow(F.lit(2.0), low).cast("bigint") + F.col("_l")
    signs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.getbit(code, i))
    total = F.aggregate(F.zip_with("_d", signs, lambda x, b: F.when(b == 1, -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x)
    hit = F.abs(total / F.col("n")) >= F.col("_obs") - 1e-15
    scored = flips.withColumn("_hit", hit.cast("double"))
    return scored.groupBy(*key).agg(F.any_value("n").alias("n"), F.avg("_hit").alias("p"))


# ---------------------------------------------------------------- I13 rank tests


def friedman(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """Friedman statistic with tie correction and its chi-square p; one row per (block, method)."""
    ranked = average_rank(df.select(block, method, value), [block], value, ascending=True)
    ties = df.groupBy(block, value).agg(F.count(F.lit(1)).alias("_t")).agg(
        F.sum((F.col("_t") * F.col("_t") - 1) * F.col("_t")).alias("ties")
    )
    sums = ranked.groupBy(method).agg(F.sum("rank").alias("_r"), F.count(F.lit(1)).alias("_n"))
    total = sums.agg(F.sum(F.col("_r") * F.col("_r")).alias("_ss"), F.count(F.lit(1)).alias("k"), F.max("_n").alias("n"), F.min("_n").alias("_least"))
    row = total.crossJoin(F.broadcast(ties))  # one row each
    k, n = F.col("k"), require(F.col("_least") == F.col("n"), F.col("n"), "every block needs every method")
    raw = 12.0 / (k * n * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1)
    stat = raw / (1.0 - F.col("ties") / (k * (k * k - 1) * n))

    @F.pandas_udf("double")
    def tail(x: pd.Series, methods: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(m) - 1) for a, m in zip(x, methods, strict=True)])

    return row.select("n", "k", stat.alias("statistic")).withColumn("p", tail("statistic", "k"))


def wilcoxon(df: DataFrame, diff: str, key: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """Signed-rank test, zero differences dropped. Ranks come from running counts over distinct magnitudes.

    ``method`` is how p is found: ``normal``, ``exact`` (an error with ties, zeros or more than 1,000 rows, whose table of rank sums
    would not fit), or ``auto``, exact up to 50 rows without ties and zeros, as other statistics packages do.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError("method must be auto, exact or normal")
    d = F.col(diff).cast("double")
    tally = df.groupBy(*key).agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("draws"), F.count_if(d < 0).alias("losses"))
    cells = df.where(d != 0).groupBy(*key, F.abs(d).alias("_a")).agg(
        F.count_if(d > 0).alias("_up"), F.count(F.lit(1)).alias("_n")
    )
    cum = place(cells, key, ["_a"], "_t").running(_c=("sum", F.col("_n"))).rows()
    rank = F.col("_c") - (F.col("_n") - 1) / 2.0
    sums = cum.groupBy(*key).agg(
        F.sum(rank * F.col("_up")).alias("_plus"), F.sum(rank * (F.col("_n") - F.col("_up"))).alias("_minus"),
        F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("_ties"),
    )
    out = null_safe(tally, sums, list(key), "left")
    out = out.withColumn("statistic", F.least("_plus", "_minus"))

    @F.pandas_udf("double")
    def tail(w: pd.Series, m: pd.Series, ties: pd.Series, draws: pd.Series) -> pd.Series:
        res = []
        for x, n, t, zeros in zip(w, m, ties, draws, strict=True):
            if n is None or pd.isna(n) or n == 0:
                res.append(1.0)
            elif method == "exact" and (n > 1000 or t or zeros):
                raise ValueError("exact p needs distinct nonzero differences, 1,000 at most")
            elif method == "exact" or (method == "auto" and n <= 50 and t == 0 and zeros == 0):
                res.append(signed_rank_tail(x, int(n)))
            else:
                spread = math.sqrt((n * (n + 1) * (2 * n + 1) - t / 2) / 24)
                res.append(math.erfc(abs(x - n * (n + 1) / 4) / spread / math.sqrt(2)))
        return pd.Series(res)

    return out.withColumn("p", tail("statistic", "_m", "_ties", "draws")).drop("_plus", "_minus", "_m", "_ties")


# ---------------------------------------------------------------- I14


def paired_delays(rows: DataFrame, proposed: str, baseline: str, unit: Sequence[str] = ("replicate", "seed")) -> DataFrame:
    """Pivot two methods to paired delays per (family, effect, replicate, seed); a missing one fails."""
    keys = ["family", "effect", *unit]
    kept = rows.where(F.col("method").isin(proposed, baseline) & (F.col("evaluation") == "restart_at_change"))
    wide = kept.groupBy(*keys).agg(
        F.max(F.when(F.col("method") == proposed, F.col("delay"))).alias("a"),
        F.max(F.when(F.col("method") == baseline, F.col("delay"))).alias("b"),
        F.max("horizon").alias("horizon"),
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return wide.withColumn("diff", require(both, (F.col("a") - F.col("b")).cast("double"), "paired delays are incomplete"))


def primary_audit(
    rows: DataFrame, proposed: str, baseline: str, alpha: float, horizon: float, hypotheses: int, requirement_met: bool = True
) -> DataFrame:
    """Proposed against baseline per hypothesis: bounded-mean test at alpha / m, Holm, pass flags.

    ``hypotheses`` is m, the number of (family, effect) pairs. The descriptive bootstrap interval
    comes from ``paired_bootstrap`` on ``paired_delays``.
    """
    pairs = paired_delays(rows, proposed, baseline)
    tested = hoeffding(pairs, "diff", horizon, alpha / hypotheses, ["family", "effect"])
    adjusted = holm(tested, "p", id=["family", "effect"])
    passes = (F.col("upper") < 0) & (F.col("holm") < alpha)
    whole = Window.partitionBy()  # one row per hypothesis
    out = adjusted.withColumn("passes", passes & F.lit(requirement_met))
    return out.withColumn("all_pass", (F.count_if(F.col("passes")).over(whole) == hypotheses))
