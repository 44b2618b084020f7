"""Detectors that learn their witness from the past of the same key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import doubles
from statewatch.functions.learners import logistic_step, smoothing, spectral_effects, top_k_scores
from statewatch.operators.sequences import START, _mixture, _weights
from statewatch.plans import longest_group, place, require
from statewatch.plans.ordering import Group, block_rows

GEOMETRIC_BETS = [0.01 * 99 ** (i / 19) for i in range(20)]  # 0.01 .. 0.99


def _names(df: DataFrame, columns: Sequence[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {fields[c]}" for c in columns)


def _matrix(column) -> np.ndarray:
    return np.stack(list(column)).astype(float)


# ---------------------------------------------------------------- contrast e-process


def witness_kernel(names: Sequence[str], rho0: np.ndarray, window: int, rank: int | None = None, tolerance: float = 1e-12):
    """Kernel of ``witness_scores`` over consecutive rows ``_x``, of which those marked ``_warm`` only serve as past."""

    def apply(g: Group, _: np.ndarray) -> Group:
        x, warm = _matrix(g["_x"]), g["_warm"].astype(bool)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if (size <= 1e-15).any():
            raise ValueError("a zero vector has no state")
        x = x / size
        # the rows before each row, with zero rows before the first
        past = np.lib.stride_tricks.sliding_window_view(np.vstack([np.zeros((window, x.shape[1])), x]), window, axis=0)
        own = np.flatnonzero(~warm)
        score, contrast, found = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), np.int32)
        for a in range(0, len(own), 1024):  # one batched eigenproblem for so many rows
            at = own[a : a + 1024]
            known = np.minimum(at, window)
            gram = past[at] @ past[at].transpose(0, 2, 1) / np.maximum(known, 1)[:, None, None]
            values, vectors = np.linalg.eigh(gram - rho0)
            chosen = (values > tolerance) & (known > 0)[:, None]
            if rank is not None:
                chosen[:, : max(0, chosen.shape[1] - rank)] = False
            seen = np.einsum("nd,ndk->nk", x[at], vectors) ** 2
            expected = np.einsum("ndk,ndk->nk", vectors, rho0 @ vectors)
            score[a : a + 1024] = ((seen - expected) * chosen).sum(axis=1)
            contrast[a : a + 1024] = (values * chosen).sum(axis=1)
            found[a : a + 1024] = chosen.sum(axis=1)
        return {**{n: g[n][~warm] for n in names}, "score": score, "contrast": contrast, "rank": found}

    return apply


def witness_scores(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, reference: np.ndarray, window: int = 64, rank: int | None = None,
    tolerance: float = 1e-12, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """``(t, score, contrast, rank)``: each row scored by the best effect of the ``window`` rows before it.

    The effect depends on a bounded past only, so blocks of a long key overlap by ``window`` rows
    and run independently.
    """
    rho0 = 0.5 * (np.asarray(reference, dtype=float) + np.asarray(reference, dtype=float).T)
    placed = place(df.withColumn("_x", doubles(vec)), key, order, rows_per_block=rows_per_block, longest=longest, spread=True)
    key = list(key)
    schema = "".join(f"{_names(df, [k])}, " for k in key) + "t bigint, score double, contrast double, rank int"

    apply = witness_kernel([*key, "t"], rho0, window, rank, tolerance)
    return placed.scan(schema, ["_x"], apply, np.zeros(1), before=window)


def mixture_eprocess(
    scores: DataFrame, key: Sequence[str], bets: Sequence[float] = GEOMETRIC_BETS, alpha: float = 0.01, rows_per_block: int | None = None, longest: int | None = None
) -> DataFrame:
    """Mixture over bets and start times (weights 6 / (pi k)^2) of products ``1 + bet * score``.

    All start times share one recursion per bet, ``A <- (A + w_t) f``, so the state is one number per bet.
    """
    if any(not 0 < b < 1 for b in bets):
        raise ValueError("bets must lie strictly between 0 and 1")
    placed = place(scores, key, ["t"], "_i", rows_per_block=rows_per_block, longest=longest)
    start = F.lit(START) / (F.col("_i") * F.col("_i"))
    placed = placed.running(_begun=("sum", start))
    factors = [1.0 + F.lit(float(b)) * F.col("score") for b in bets]
    tail = F.greatest(F.lit(0.0), 1.0 - F.col("_begun"))
    keep = [c for c in scores.columns if c not in key]
    rows = _mixture(placed, factors, _weights(len(bets), None), start, [*keep, "_begun"], -math.log(1 - max(bets)))
    # the unstarted mass is added here: it is a column of the same rows
    e = F.exp(F.least(F.greatest(F.col("log_stat"), F.lit(-745.0)), F.lit(700.0)))
    total = F.when(F.col("log_stat") == float("-inf"), F.lit(0.0)).otherwise(e) + tail
    rows = rows.withColumn("e_value", F.least(total, F.exp(F.lit(700.0))))
    top = place(rows, key, ["_i"], "_j", rows_per_block=rows_per_block, longest=placed.longest).running(_max=("max", F.col("e_value")))
    best = F.greatest(F.lit(1.0), F.col("_max"))
    out = top.rows().withColumns({"p": F.least(F.lit(1.0), 1.0 / best), "alarm": best >= 1.0 / alpha})
    return out.drop("_i", "_j", "_begun", "_max", "log_stat", "stat")


def contrast_eprocess(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, reference: np.ndarray, window: int = 64,
    bets: Sequence[float] = GEOMETRIC_BETS, rank: int | None = None, alpha: float = 0.01, rows_per_block: int | None = None,
) -> DataFrame:
    """Learned contrast against a known reference state, tested on the next row: ``t, score, contrast, e_value, p, alarm, rank``."""
    longest = longest_group(df, key)
    scores = witness_scores(df, key, order, vec, reference, window, rank, rows_per_block=rows_per_block, longest=longest)
    return mixture_eprocess(scores, key, bets, alpha, rows_per_block, longest)


# ---------------------------------------------------------------- EWMA witnesses


def _ewma_end(x: np.ndarray, alpha: float) -> np.ndarray:
    weight = alpha * (1 - alpha) ** np.arange(len(x) - 1, -1, -1.0)
    return weight @ x


def topk_step(names: Sequence[str], alpha: float, ks: Sequence[int]):
    """Step of ``ewma_topk`` over consecutive rows ``_x``; the state is the average."""

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        average, rows = state[None, :].copy(), []
        for v in _matrix(g["_x"]):
            rows.append(top_k_scores(average, v, ks)[0])
            average = (1 - alpha) * average + alpha * v
        return {**{n: g[n] for n in names}, "scores": rows}, average[0]

    return step


def ewma_topk(
    df: DataFrame, key: Sequence[str], order: Sequence[str], diff: str, dim: int, half_life: float, ks: Sequence[int], rows_per_block: int | None = None
) -> DataFrame:
    """``(t, scores)``: one score per k from the signed top-k witnesses of one shared EWMA.

    The EWMA is linear, so a block of a long key needs only its decayed sum from the blocks before.
    """
    if min(ks) < 1 or max(ks) > dim:
        raise ValueError("every k must lie in 1..dim")
    alpha = smoothing(half_life)
    x = doubles(diff)
    bounded = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) <= 1 + 1e-12)) & (F.size(x) == dim)
    placed = place(df.withColumn("_x", require(bounded, x, "differences must lie in [-1, 1]")), key, order, rows_per_block=rows_per_block, spread=True)
    key = list(key)
    schema = "".join(f"{_names(df, [k])}, " for k in key) + "t bigint, scores array<double>"

    step = topk_step([*key, "t"], alpha, ks)

    def apply(g: Group, state: np.ndarray) -> Group:
        return step(g, state)[0]

    def summarize(g: Group) -> np.ndarray:
        values = _matrix(g["_x"])
        return np.concatenate([[len(values)], _ewma_end(values, alpha)])

    def combine(state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return state * (1 - alpha) ** summary[0] + summary[1:]

    return placed.scan(schema, ["_x"], apply, np.zeros(dim), summarize, combine)


def spectral_step(names: Sequence[str], dim: int, alpha: float, stride: int):
    """Step of ``ewma_spectral`` over consecutive rows ``_x`` with their positions ``t``, and the check of the matrices.

    The state is the average, and the average as of the last refit.
    """

    def matrices(g: Group) -> np.ndarray:
        m = _matrix(g["_x"]).reshape(-1, dim, dim)
        scale = np.maximum(1.0, np.linalg.norm(m, axis=(1, 2)))
        if (np.linalg.norm(m - m.transpose(0, 2, 1), axis=(1, 2)) > 1e-9 * scale).any():
            raise ValueError("differences must be symmetric")
        if (np.abs(np.trace(m, axis1=1, axis2=2)) > 1e-9 * scale).any():
            raise ValueError("differences must be traceless")
        norm = np.abs(np.linalg.eigvalsh(m)).sum(axis=1)
        if (norm > 2 + 1e-9 * np.maximum(1.0, norm)).any():
            raise ValueError("differences must have trace norm at most two")
        return 0.5 * (m + m.transpose(0, 2, 1))

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        (average, fitted), rows = state.reshape(2, 1, dim, dim).copy(), []
        effects = spectral_effects(fitted)[0]
        for t, m in zip(g["t"], matrices(g), strict=True):
            rows.append(np.einsum("eij,ji->e", effects, m))
            average = (1 - alpha) * average + alpha * m
            if t % stride == 0:
                fitted = average
                effects = spectral_effects(fitted)[0]
        scores = np.clip(np.array(rows), -1.0, 1.0)
        out = {**{n: g[n] for n in names}, "rank_one": scores[:, 0], "positive": scores[:, 1]}
        return out, np.concatenate([average.ravel(), fitted.ravel()])

    return step, matrices


def ewma_spectral(
    df: DataFrame, key: Sequence[str], order: Sequence[str], delta: str, dim: int, half_life: float, stride: int = 1, rows_per_block: int | None = None
) -> DataFrame:
    """``(t, rank_one, positive)``: scores of matrix differences under effects refitted every ``stride`` rows.

    One eigendecomposition serves both effects. Differences must be symmetric, traceless and have
    trace norm at most two.
    """
    alpha = smoothing(half_life)
    if stride < 1:
        raise ValueError("stride must be positive")
    # a block starts where the effects are refitted
    placed = place(df.withColumn("_x", doubles(delta)), key, order, rows_per_block=block_rows(rows_per_block, stride), spread=True)
    key = list(key)
    schema = "".join(f"{_names(df, [k])}, " for k in key) + "t bigint, rank_one double, positive double"

    step, matrices = spectral_step([*key, "t"], dim, alpha, stride)

    def apply(g: Group, state: np.ndarray) -> Group:
        return step(g, np.concatenate([state, state]))[0]

    def summarize(g: Group) -> np.ndarray:
        m = matrices(g).reshape(len(g["t"]), -1)
        return np.concatenate([[len(m)], _ewma_end(m, alpha)])

    def combine(state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return state * (1 - alpha) ** summary[0] + summary[1:]

    return placed.scan(schema, ["_x"], apply, np.zeros(dim * dim), summarize, combine)


def logistic_kernel(names: Sequence[str], rate: float, l2: float):
    """``step(rows, weights)`` of the pairwise learner: rows in order with the difference in ``_d``."""
    rates, names = np.array([rate]), list(names)

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        w, out = state[None, :].copy(), []
        for v in _matrix(g["_d"]):
            margin = float(w[0] @ v)
            score, loss, w = logistic_step(w, v, rates, l2)
            out.append((float(score[0]), margin, float(loss[0])))
        score, margin, loss = zip(*out, strict=True)
        return {**{n: g[n] for n in names}, "score": score, "margin": margin, "loss": loss}, w[0]

    return step


def online_logistic(
    df: DataFrame, key: Sequence[str], order: Sequence[str], ref: str, mon: str, dim: int, rate: float, l2: float = 0.0,
    rows_per_block: int | None = None, states: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pairwise logistic learner without intercept: ``(t, score, margin, loss)`` rows and final weights.

    One gradient step per row after scoring it. A nonlinear recursion cannot be split, so a key
    longer than a block is walked block by block with only the weights carried between blocks.
    """
    if not 0 < rate < float("inf") or l2 < 0:
        raise ValueError("rate must be positive and l2 nonnegative")
    unit = lambda c: F.forall(doubles(c), lambda v: ~F.isnan(v) & (v >= -1e-12) & (v <= 1 + 1e-12))
    d = F.zip_with(doubles(mon), doubles(ref), lambda a, b: a - b)
    rows = df.withColumn("_d", require(unit(ref) & unit(mon), d, "features must lie in [0, 1]"))
    placed = place(rows, key, order, rows_per_block=rows_per_block, spread=True)
    key = list(key)
    schema = "".join(f"{_names(df, [k])}, " for k in key) + "t bigint, score double, margin double, loss double"
    step = logistic_kernel([*key, "t"], rate, l2)
    return placed.fold(schema, ["_d"], step, np.zeros(dim), states)

