"""Steps with a bounded past for streams: a ring of the last rows of a key, and what the batch kernels of the learned witnesses make of it.

The kernels are those of the batch operators wherever these run in Python; the linear witnesses, which Spark's windows compute in batch, have
theirs here. State per key is one flat vector whose length the window bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from statewatch.operators.adaptive import GEOMETRIC_BETS, witness_kernel
from statewatch.operators.sequences import START
from statewatch.plans.ordering import Group

Step = Callable[[Group, np.ndarray], tuple[Group, np.ndarray]]


def counted(step: Step, start: np.ndarray) -> tuple[Step, np.ndarray]:
    """``step`` with the positions ``t`` of the rows of a key, counted from 1; the count is kept behind the step's own state."""

    def run(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        n = len(next(iter(g.values())))
        out, after = step({**g, "t": int(state[-1]) + 1 + np.arange(n)}, state[:-1])
        return out, np.concatenate([after, [state[-1] + n]])

    return run, np.concatenate([np.asarray(start, float).ravel(), [0.0]])


def held(step: Step, start: np.ndarray, threshold: float) -> tuple[Step, np.ndarray]:
    """``step`` with a sticky alarm from ``stat`` and the position ``t``; the statistic keeps its value from the alarm on."""
    level = threshold * (1 - 1e-12)

    def run(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        out, after = step(g, state[:-3])
        at, log_stat, stat = state[-3:]
        hit = np.flatnonzero(out["stat"] >= level)
        if not at and len(hit):
            at, log_stat, stat = out["t"][hit[0]], out["log_stat"][hit[0]], out["stat"][hit[0]]
        alarm = (out["t"] >= at) & bool(at)
        out |= {"log_stat": np.where(alarm, log_stat, out["log_stat"]), "stat": np.where(alarm, stat, out["stat"]), "alarm": alarm}
        out["alarm_time"] = [int(at) if a else None for a in alarm]
        return out, np.concatenate([after, [at, log_stat, stat]])

    return run, np.concatenate([np.asarray(start, float).ravel(), [0.0, 0.0, 0.0]])


def ringed(rows: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], names: Sequence[str], column: str, dim: int, past: int) -> tuple[Step, np.ndarray]:
    """A step from ``rows(values, old, t)``: ``values`` are up to ``past`` earlier rows of ``column`` and the new ones, ``old`` counts the earlier
    ones, and ``t`` all rows of the key before the new ones. The state holds the last ``past`` rows, newest last, and ``t``."""
    names = list(names)

    def run(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        t = int(state[-1])
        old = min(t, past)
        ring = state[:-1].reshape(past, dim)[past - old :]
        new = np.stack(list(g[column])).astype(float)
        values = np.concatenate([ring, new])
        made = rows(values, old, t)
        kept = np.concatenate([np.zeros((past, dim)), values])[-past:] if past else values[:0]
        out = {**{n: g[n] for n in names}, "t": t + 1 + np.arange(len(new)), **made}
        return out, np.concatenate([kept.ravel(), [t + len(new)]])

    return run, np.zeros(past * dim + 1)


def sliding_kernel(names: Sequence[str], dim: int, n: int, column: str = "_x") -> tuple[Step, np.ndarray]:
    """Sums of the outer products of the last ``n`` rows scaled to length one: ``t, mass, full, acc``, as ``sliding_state`` without weights."""

    def rows(values: np.ndarray, old: int, t: int) -> dict[str, np.ndarray]:
        unit = values / np.linalg.norm(values, axis=1, keepdims=True)
        padded = np.concatenate([np.zeros((n - 1, dim)), unit])
        last = np.lib.stride_tricks.sliding_window_view(padded, n, axis=0)[old:]
        mass = np.minimum(n, old + 1 + np.arange(len(values) - old))
        acc = last @ last.transpose(0, 2, 1)
        return {"mass": mass.astype(float), "full": mass == n, "acc": list(acc.reshape(len(acc), -1))}

    return ringed(rows, names, column, dim, n - 1)


def witness_step(names: Sequence[str], reference: np.ndarray, window: int = 64, rank: int | None = None, tolerance: float = 1e-12, column: str = "_x"):
    """Step of ``witness_scores``: ``t, score, contrast, rank``."""
    rho0 = 0.5 * (np.asarray(reference, dtype=float) + np.asarray(reference, dtype=float).T)
    kernel = witness_kernel([], rho0, window, rank, tolerance)

    def rows(values: np.ndarray, old: int, t: int) -> dict[str, np.ndarray]:
        return kernel({"_x": list(values), "_warm": np.arange(len(values)) < old}, np.zeros(1))

    return ringed(rows, names, column, len(rho0), window)


def contrast_kernel(
    names: Sequence[str], reference: np.ndarray, window: int = 64, bets: Sequence[float] = GEOMETRIC_BETS, rank: int | None = None, alpha: float = 0.01,
    column: str = "_x",
) -> tuple[Step, np.ndarray]:
    """Step of ``contrast_eprocess``: ``t, score, contrast, e_value, p, alarm, rank``. State: ring and count, log mass of each bet, mass begun, largest value."""
    b = np.asarray(bets, dtype=float)
    learn, start = witness_step(names, reference, window, rank, column=column)
    size = len(start)

    def run(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        out, after = learn(g, state[:size])
        logs, (begun, top) = state[size:-2], state[-2:]
        weight = START / out["t"].astype(float) ** 2
        grown = np.cumsum(np.log1p(out["score"][:, None] * b), axis=0)
        # A_t = (A_{t-1} + w_t) f_t, all rows at once: A_t = G_t (A_0 + sum of w_s / G_{s-1})
        entering = np.log(weight)[:, None] - np.concatenate([np.zeros((1, len(b))), grown[:-1]])
        mass = grown + np.logaddexp.accumulate(np.concatenate([logs[None, :], entering]), axis=0)[1:]
        tail = np.maximum(0.0, 1.0 - begun - np.cumsum(weight))
        e = np.minimum(np.exp(np.minimum(mass, 700.0)).mean(axis=1) + tail, math.exp(700.0))
        best = np.maximum.accumulate(np.maximum(e, top))
        out |= {"e_value": e, "p": np.minimum(1.0, 1.0 / best), "alarm": best >= 1.0 / alpha}
        return out, np.concatenate([after, mass[-1], [begun + weight.sum(), best[-1]]])

    return run, np.concatenate([start, np.full(len(b), -np.inf), [0.0, 1.0]])


def _refits(values: np.ndarray, old: int, t: int, window: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new row the trailing mean as of the latest refit before it, and whether there is one."""
    new = len(values) - old
    at = (t + np.arange(new)) // every * every  # rows seen at the last refit before each new row
    fits, which = np.unique(at, return_inverse=True)
    first = t - old  # rows of the key before those held
    means = np.array([values[max(f - window, 0) - first if f > window else 0 : f - first].mean(axis=0) if f > 0 else np.zeros(values.shape[1]) for f in fits])
    return means[which], at > 0


def _whitened(delta: np.ndarray, covariance, ridge: float) -> np.ndarray:
    d = delta.shape[1]
    v = np.eye(d) if covariance is None else 0.5 * (np.asarray(covariance, float) + np.asarray(covariance, float).T)
    return delta @ np.linalg.pinv(v + ridge * np.eye(d), hermitian=True).T


def simplex_kernel(
    names: Sequence[str], reference: Sequence[float], mode: str = "raw", covariance=None, ridge: float = 1e-6, window: int = 64, every: int = 1,
    tolerance: float = 1e-12, column: str = "_x",
) -> tuple[Step, np.ndarray]:
    """Step of ``simplex_witness``: ``t, score``."""
    ref = np.asarray(reference, float)
    if mode not in ("raw", "variance"):
        raise ValueError("mode must be 'raw' or 'variance'")

    def rows(values: np.ndarray, old: int, t: int) -> dict[str, np.ndarray]:
        if not (np.isfinite(values).all() and (values >= -1e-9).all() and (np.abs(values.sum(axis=1) - 1) <= 1e-9).all()):
            raise ValueError("not a probability vector")
        values = np.maximum(values, 0.0)
        values = values / values.sum(axis=1, keepdims=True)
        x = values[old:]
        means, known = _refits(values, old, t, window, every)
        delta = means - ref
        if mode == "raw":
            effect = (delta > tolerance).astype(float)
        else:
            w = _whitened(delta, covariance, ridge)
            low, span = w.min(axis=1, keepdims=True), np.ptp(w, axis=1, keepdims=True)
            effect = np.where(span <= tolerance, 0.0, (w - low) / np.where(span <= tolerance, 1.0, span))
        return {"score": np.clip(np.where(known, (effect * (x - ref)).sum(axis=1), 0.0), -1.0, 1.0)}

    return ringed(rows, names, column, len(ref), window + every - 1)


def box_kernel(
    names: Sequence[str], reference: Sequence[float], lower: Sequence[float], upper: Sequence[float], mode: str = "raw", covariance=None, ridge: float = 1e-6,
    window: int = 64, every: int = 1, tolerance: float = 1e-12, column: str = "_x",
) -> tuple[Step, np.ndarray]:
    """Step of ``box_witness``: ``t, score``."""
    ref, low, high = (np.asarray(v, float) for v in (reference, lower, upper))
    if mode not in ("raw", "variance"):
        raise ValueError("mode must be 'raw' or 'variance'")
    if (high <= low).any() or (ref < low).any() or (ref > high).any():
        raise ValueError("bounds must be ordered and contain the reference")

    def rows(values: np.ndarray, old: int, t: int) -> dict[str, np.ndarray]:
        if not ((values >= low - 1e-9) & (values <= high + 1e-9)).all():
            raise ValueError("feature lies outside its bounds")
        values = np.clip(values, low, high)
        x = values[old:]
        means, known = _refits(values, old, t, window, every)
        w = means - ref if mode == "raw" else _whitened(means - ref, covariance, ridge)
        bound = np.abs(w) @ (high - low)
        flat = ~known | (bound <= tolerance)
        return {"score": np.where(flat, 0.0, np.clip((w * (x - ref)).sum(axis=1) / np.where(flat, 1.0, bound), -1.0, 1.0))}

    return ringed(rows, names, column, len(ref), window + every - 1)
