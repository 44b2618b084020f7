"""Role-isolated scorer bank on paired event rows, shot-level evidence, replay, and audits of it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import doubles, log0, vector
from statewatch.functions.bets import bounded_score
from statewatch.functions.bits import firing_rate
from statewatch.functions.learners import logistic_step, pair_features, smoothing, spectral_effects, top_k_scores
from statewatch.operators.adaptive import _matrix, _names
from statewatch.operators.bootstrap import order_threshold
from statewatch.operators.sequences import _alarms, affine_logs
from statewatch.plans import draw_index, place
from statewatch.plans.durable import durable, model_table
from statewatch.plans.guards import null_safe
from statewatch.plans.ordering import Group

# Betting fractions, learning rates, half-lives, top-k sizes and the refit stride.
BETS = (0.1, 0.3, 0.6, 0.9)
RATES = (0.001, 0.01, 0.1)
SPARSE_HALF_LIVES = (4.0, 16.0, 64.0, 256.0)
SPARSE_KS = (1, 4, 16, 64)
SPECTRAL_HALF_LIVES = (4.0, 16.0, 64.0)
SPECTRAL_RANKS = ("one", "positive")
STRIDE = 8
L2 = 1e-4
METHODS = ("rate", "likelihood", "logistic", "sparse", "spectral", "composite")


def eligible_ks(q: int) -> list[int]:
    return [k for k in SPARSE_KS if k <= q * (q + 1) // 2]


def component_priors(q: int) -> dict[str, list[tuple[str, float]]]:
    """Components ``(id, prior weight)`` of every method, in factor order; weights sum to one."""
    signed = [f"{s * b:+g}" for b in BETS for s in (1, -1)]
    ids = {
        "rate": signed,
        "likelihood": signed,
        "logistic": [f"rate={r}|bet={b}" for r in RATES for b in BETS],
        "sparse": [f"half={h}|k={k}|bet={b}" for h in SPARSE_HALF_LIVES for k in eligible_ks(q) for b in BETS],
        "spectral": [f"half={h}|rank={r}|bet={b}" for h in SPECTRAL_HALF_LIVES for r in SPECTRAL_RANKS for b in BETS],
    }
    out = {m: [(c, 1.0 / len(cs)) for c in cs] for m, cs in ids.items()}
    out["composite"] = [(f"{m}|{c}", 0.5 * w) for m in ("sparse", "spectral") for c, w in out[m]]
    return out


# ---------------------------------------------------------------- fixed scores


def nll_score(pairs: DataFrame, profile: DataFrame, role: Sequence[str], ref: str, mon: str, epsilon: float = 1e-4) -> DataFrame:
    """Adds ``nll``: mean Bernoulli cost of the monitor row minus that of the reference row, in [-1, 1].

    ``profile`` has (role..., chk, p); its rows per role become one array, so there is no explode.
    """
    logs = profile.groupBy(*role).agg(
        F.array_sort(F.collect_list(F.struct("chk", F.log("p").alias("a"), F.log1p(-F.col("p")).alias("b")))).alias("_l")
    )
    joined = null_safe(pairs, logs, list(role))
    # (monitor - reference) * (log(1-p) - log p) summed: the constant part cancels
    gaps = F.zip_with(doubles(mon), doubles(ref), lambda m, r: m - r)
    cost = F.zip_with(gaps, F.col("_l"), lambda d, e: d * (e["b"] - e["a"]))
    mean = F.aggregate(cost, F.lit(0.0), lambda s, x: s + x) / F.size("_l")
    return joined.withColumn("nll", bounded_score(mean / math.log((1 - epsilon) / epsilon))).drop("_l")


def hotelling_score(df: DataFrame, vec: str, means: DataFrame, precision: np.ndarray, role: Sequence[str]) -> DataFrame:
    """Adds ``hotelling``: ``(x - mean_role)' P (x - mean_role)``, tiny negatives set to zero."""
    joined = null_safe(df, model_table(means.select(*role, F.col("mean").alias("_m"))), list(role))
    p = np.asarray(precision, dtype=float)

    @F.pandas_udf("double")
    def quadratic(x: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        gap = _matrix(x) - _matrix(m)
        value = np.einsum("ni,ni->n", gap @ p, gap)
        if (value < -1e-12 * max(1.0, np.abs(p).max())).any():
            raise ValueError("the precision is not positive")
        return pd.Series(np.maximum(value, 0.0))

    return joined.withColumn("hotelling", quadratic(doubles(vec), F.col("_m"))).drop("_m")


# ---------------------------------------------------------------- the bank


class _Layout:
    """Where the learners of one role live in its flat state vector."""

    def __init__(self, q: int) -> None:
        self.q, self.p = q, q * (q + 1) // 2
        self.parts = [
            ("t", (1,)),
            ("w", (len(RATES), self.p)),
            ("sparse", (len(SPARSE_HALF_LIVES), self.p)),
            ("spectral", (len(SPECTRAL_HALF_LIVES), q, q)),
            ("effects", (len(SPECTRAL_HALF_LIVES), 2, q, q)),
        ]
        self.size = sum(math.prod(s) for _, s in self.parts)

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts:
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape).copy()
            at += n
        return out

    def join(self, state: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([state[name].ravel() for name, _ in self.parts])


def bank_step(layout: _Layout, state: dict[str, np.ndarray], r: np.ndarray, m: np.ndarray) -> list[tuple]:
    """Run consecutive rows of one role: scores before learning, learners updated in ``state``."""
    q = layout.q
    ks = eligible_ks(q)
    rates = np.array(RATES)
    a_sparse = np.array([smoothing(h) for h in SPARSE_HALF_LIVES])[:, None]
    a_spectral = np.array([smoothing(h) for h in SPECTRAL_HALF_LIVES])[:, None, None]
    diffs = pair_features(m) - pair_features(r)
    zm, zr = 1 - 2 * m, 1 - 2 * r
    densities = (np.einsum("ni,nj->nij", zm, zm) - np.einsum("ni,nj->nij", zr, zr)) / q
    out = []
    for d, delta in zip(diffs, densities, strict=True):
        logistic, _, state["w"] = logistic_step(state["w"], d, rates, L2)
        sparse = top_k_scores(state["sparse"], d, ks)
        state["sparse"] = (1 - a_sparse) * state["sparse"] + a_sparse * d
        spectral = np.clip(np.einsum("heij,ji->he", state["effects"], delta), -1.0, 1.0)
        state["spectral"] = (1 - a_spectral) * state["spectral"] + a_spectral * delta
        state["t"] += 1
        if int(state["t"][0]) % STRIDE == 0:
            state["effects"] = spectral_effects(state["spectral"])
        out.append((logistic, sparse.ravel(), spectral.ravel()))
    return out


def bank_kernel(names: Sequence[str], q: int):
    """``step(rows, state)`` of the bank: rows of one role in order with bits in ``_r`` and ``_m``."""
    layout, names = _Layout(q), list(names)

    def step(g: Group, flat: np.ndarray) -> tuple[Group, np.ndarray]:
        state = layout.split(flat)
        r, m = _matrix(g["_r"]), _matrix(g["_m"])
        if not (np.isin(r, (0, 1)).all() and np.isin(m, (0, 1)).all()):
            raise ValueError("paired rows must be binary")
        scores = bank_step(layout, state, r, m)
        logistic, sparse, spectral = zip(*scores, strict=True)
        out = {**{n: g[n] for n in names}, "logistic": logistic, "sparse": sparse, "spectral": spectral}
        return out, layout.join(state)

    return step


def bank_start(q: int) -> np.ndarray:
    return np.zeros(_Layout(q).size)


def score_bank(
    pairs: DataFrame, key: Sequence[str], order: Sequence[str], ref: str, mon: str, q: int, states: DataFrame | None = None,
    keep: Sequence[str] = (), rows_per_block: int | None = None, longest: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Adaptive scores of every paired row and the final learner state per key.

    ``key`` includes the role: roles share nothing, so they run in parallel. ``states`` (from an
    earlier call) warms the keys it lists, which is how a replay starts.
    """
    key = list(key)
    names = list(dict.fromkeys([*key, *keep]))
    schema = _names(pairs, names) + ", t bigint, logistic array<double>, sparse array<double>, spectral array<double>"
    rows = pairs.withColumns({"_r": doubles(ref), "_m": doubles(mon)})
    placed = place(rows, key, order, rows_per_block=rows_per_block, longest=longest, spread=True)

    step = bank_kernel([*names, "t"], q)
    return placed.fold(schema, [*names, "_r", "_m"], step, bank_start(q), states)


def empirical_scores(bank: DataFrame, q: int) -> DataFrame:
    """Score per method: absolute value for signed ones, best expert for adaptive ones.

    ``composite`` is the larger of sparse and spectral, sparse on ties; winners are named.
    """
    ids = {
        "logistic": [f"rate={r}" for r in RATES],
        "sparse": [f"half={h}|k={k}" for h in SPARSE_HALF_LIVES for k in eligible_ks(q)],
        "spectral": [f"half={h}|rank={r}" for h in SPECTRAL_HALF_LIVES for r in SPECTRAL_RANKS],
    }
    out = bank
    for name, labels in ids.items():
        spot = F.array_position(name, F.array_max(name)).cast("int")
        table = F.array(*[F.lit(x) for x in labels])
        out = out.withColumns({f"{name}_score": F.array_max(name), f"{name}_winner": F.element_at(table, spot)})
    sparse = F.col("sparse_score") >= F.col("spectral_score")
    return out.withColumns(
        {
            "composite_score": F.greatest("sparse_score", "spectral_score"),
            "composite_winner": F.when(sparse, F.lit("sparse")).otherwise(F.lit("spectral")),
        }
    )


def rate_score(ref: str, mon: str) -> Column:
    return firing_rate(mon) - firing_rate(ref)


def factor_array(scores: Column, two_sided: bool = False) -> Column:
    """Betting factors of an array of scores, in component order."""
    bets = vector([s * b for b in BETS for s in ((1, -1) if two_sided else (1,))])
    return F.flatten(F.transform(scores, lambda s: F.transform(bets, lambda b: F.greatest(1.0 + b * s, F.lit(0.0)))))


def method_factors(bank: DataFrame, method: str) -> DataFrame:
    """Adds ``factors`` of one method. ``rate`` and ``likelihood`` read columns ``rate`` and ``nll``."""
    if method in ("rate", "likelihood"):
        column = factor_array(F.array(F.col("rate" if method == "rate" else "nll")), True)
    elif method == "composite":
        column = factor_array(F.concat("sparse", "spectral"))
    else:
        column = factor_array(F.col(method))
    return bank.withColumn("factors", column)


# ---------------------------------------------------------------- shot-level evidence


def shot_process(
    rows: DataFrame, key: Sequence[str], role: str, pair: Sequence[str], weights: Sequence[float], roles: int,
    kind: str = "eprocess", horizon: int | None = None, alpha: float = 0.01, gamma: float = 1e6, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """One evidence step per complete shot: the roles of a shot are simultaneous experts, prior 1/roles each.

    Components never interact, so every role runs its own recursion and a shot adds them up.
    ``horizon`` defaults to the number of shots of the key.
    """
    role_key = [*key, role]
    if kind == "eprocess" and horizon is None and "_H" in rows.columns:
        pass  # the caller attached the horizon of each key
    elif kind == "eprocess" and horizon is None:
        sizes = rows.groupBy(*key).agg(F.count_distinct(*[F.col(c) for c in pair]).alias("_H"))
        rows = null_safe(rows, sizes, list(key))
    else:
        rows = rows.withColumn("_H", F.lit(horizon or 1))
    placed = place(rows, role_key, pair, "shot_index", rows_per_block=rows_per_block, longest=longest, spread=True)
    inject = 1.0 / F.col("_H") if kind == "eprocess" else F.lit(1.0)
    keep = [*pair, "_H"]
    logs = affine_logs(placed, F.col("factors"), inject, keep, len(weights))
    log_w = vector([math.log(w / roles) if w > 0 else float("-inf") for w in weights])
    own = logs.withColumn("_t", F.zip_with("log_a", log_w, lambda a, b: a + b)).withColumn("_top", F.array_max("_t"))
    mass = F.aggregate(F.zip_with("_t", F.array_repeat("_top", F.size("_t")), lambda a, m: F.exp(a - m)), F.lit(0.0), lambda s, x: s + x)
    own = own.withColumn("_own", F.when(F.col("_top") == float("-inf"), F.col("_top")).otherwise(F.col("_top") + F.log(mass)))
    shots = own.groupBy(*key, *pair, "shot_index").agg(
        F.count(F.lit(1)).alias("_roles"), F.collect_list("_own").alias("_list"), F.max("_own").alias("_top"), F.any_value("_H").alias("_H")
    )
    # roles are few; the shift by the largest keeps the sum in range
    shifted = F.aggregate(F.zip_with("_list", F.array_repeat("_top", F.size("_list")), lambda a, m: F.when(a == float("-inf"), 0.0).otherwise(F.exp(a - m))), F.lit(0.0), lambda s, x: s + x)
    started = F.when(F.col("_top") == float("-inf"), F.col("_top")).otherwise(F.col("_top") + F.log(shifted))
    shots = shots.where(F.col("_roles") == roles).withColumn("_s", started)
    if kind == "eprocess":
        tail = log0(F.greatest((F.col("_H") - F.col("shot_index")) / F.col("_H"), F.lit(0.0)))
        high = F.greatest("_s", tail)
        log_stat = high + F.log(F.exp(F.col("_s") - high) + F.exp(tail - high))
        level = 1.0 / alpha
    else:
        log_stat, level = F.col("_s"), gamma
    out = shots.withColumn("log_stat", log_stat).withColumn("stat", F.exp(F.least("log_stat", F.lit(709.0))))
    out = out.select(*key, *pair, "shot_index", "log_stat", "stat")
    return _alarms(out, placed, key, "shot_index", F.col("stat") >= level, False)


# ---------------------------------------------------------------- resampled replays


def _copy_states(states: DataFrame, replicates: int) -> DataFrame:
    """The same warm state for every replicate."""
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))
    return states.withColumn("replicate", F.explode(copies))


def bootstrap_max_e(
    pairs: DataFrame, key: Sequence[str], role: str, pair_index: str, ref: str, mon: str, q: int, roles: int, method: str, indices: DataFrame,
    replicates: int, horizon: int | None, states: DataFrame | None = None, alpha: float = 0.01,
) -> tuple[DataFrame, DataFrame]:
    """Largest log e-value of each resampled replay from the same warm state, and the threshold.

    ``indices`` (replicate, position, index) name the shots of each replay. The replays of a key step together in its task
    and share no state once their draws differ. Where ``indices`` has columns of ``key``, each key replays its own draws;
    without a ``horizon`` each key's is the number of its shots.
    """
    from statewatch.operators.replays import replayed_maxima  # replays build on this module

    found = replayed_maxima(pairs, key, role, pair_index, ref, mon, q, roles, method, indices, horizon, states)
    maxima = durable(found, "maxima")  # the replays run once
    return maxima, order_threshold(maxima, "max_log_e", alpha, key, replicates)


def swap_pairs(pairs: DataFrame, key: Sequence[str], pair: Sequence[str], ref: str, mon: str, replicates: int, seed: int) -> DataFrame:
    """Every replicate exchanges reference and monitor of whole shots by one hashed bit per shot."""
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))
    rows = pairs.withColumn("replicate", F.explode(copies))
    bit = draw_index(2, seed, F.col("replicate"), *[F.col(c) for c in [*key, *pair]]) == 1
    return rows.withColumns(
        {"swapped": bit, ref: F.when(bit, F.col(mon)).otherwise(F.col(ref)), mon: F.when(bit, F.col(ref)).otherwise(F.col(mon))}
    )


def swap_audit(
    pairs: DataFrame, key: Sequence[str], role: str, pair: Sequence[str], ref: str, mon: str, q: int, roles: int, replicates: int, seed: int,
    methods: Sequence[str] = ("logistic", "sparse", "spectral", "composite"), states: DataFrame | None = None, alpha: float = 0.01,
    family: float = 600.0, rows_per_block: int | None = None,
) -> DataFrame:
    """Replay with whole-shot swaps: crossing of 1/alpha and of ``family``, largest and final log e, per replicate and method."""
    sizes = pairs.groupBy(*key).agg(F.count_distinct(*[F.col(c) for c in pair]).alias("_H"))
    longest = int(sizes.agg(F.max("_H")).first()[0] or 0)
    swapped = swap_pairs(pairs, key, pair, ref, mon, replicates, seed)
    who = [*key, "replicate"]
    warm = None if states is None else _copy_states(states, replicates).select(*who, role, "_state")
    keep = [*who, role, *pair, ref, mon]
    bank, _ = score_bank(swapped, [*who, role], list(pair), ref, mon, q, warm, keep, rows_per_block, longest)
    bank = null_safe(bank, sizes, list(key))
    bank = durable(bank.withColumn("rate", rate_score(ref, mon)), "bank")  # every method reads it; the learners run once
    priors = component_priors(q)
    out = None
    for method in methods:
        weights = [w for _, w in priors[method]]
        trace = shot_process(method_factors(bank, method), who, role, list(pair), weights, roles, "eprocess", None, alpha, rows_per_block=rows_per_block, longest=longest)
        row = trace.groupBy(*who).agg(
            F.min("alarm_time").alias("first_crossing"),
            F.greatest(F.lit(0.0), F.max("log_stat")).alias("max_log_e"),
            F.max_by("log_stat", "shot_index").alias("final_log_e"),
            F.count(F.lit(1)).alias("shots"),
        )
        row = row.select(
            *who, F.lit(method).alias("method"), F.col("first_crossing").isNotNull().alias("crossed"), "first_crossing", "max_log_e", "final_log_e",
            (F.col("max_log_e") >= math.log(family)).alias("crossed_family"), "shots",
        )
        out = row if out is None else out.unionByName(row)
    return out
