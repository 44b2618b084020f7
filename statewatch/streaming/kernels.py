"""``step(rows, state)`` rules for the betting detectors; the adaptive ones come from the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from statewatch.plans.ordering import Group


def checked_scores(g: Group) -> np.ndarray:
    """The scores of consecutive rows; what the batch operators reject is rejected here."""
    s = g["_s"].astype(float)
    if not (np.abs(s) <= 1.0 + 1e-9).all():
        raise ValueError("scores must be finite and lie in [-1, 1]")
    return np.clip(s, -1.0, 1.0)


def factor_kernel(names: Sequence[str], weights: Sequence[float], threshold: float, freeze: bool):
    """Mixture of ``R <- (R + 1) f`` over the factors in ``_f``; ``freeze`` holds everything from the alarm on.

    With ``freeze`` it is the likelihood-ratio detector, without it the bank. State: components, step count, alarm step (0 = none).
    """
    w, names = np.asarray(weights, dtype=float), list(names)
    level = threshold * (1 - 1e-12) if freeze else threshold

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        factors = np.stack([np.asarray(f, dtype=float) for f in g["_f"]])
        if not (np.isfinite(factors) & (factors >= 0)).all():
            raise ValueError("factors must be finite and nonnegative")
        r, t, alarm, rows = state[:-2].copy(), state[-2], state[-1], []
        for f in factors:
            t += 1
            if not (alarm and freeze):
                r = (r + 1.0) * f
            if not alarm and w @ r >= level:
                alarm = t
            rows.append((int(t), float(w @ r), bool(alarm), int(alarm) if alarm else None))
        steps, stat, alarms, first = zip(*rows, strict=True)
        out = {**{n: g[n] for n in names}, "t": steps, "stat": stat, "alarm": alarms, "alarm_time": first}
        return out, np.concatenate([r, [t, alarm]])

    return step, np.zeros(len(w) + 2)


def cusum_kernel(names: Sequence[str], kappas: Sequence[float]):
    """Two-sided ``S <- max(0, S +- s - kappa)`` of the score; state: the sums of both sides and the step count."""
    margins, names = np.asarray(kappas, dtype=float), list(names)

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        s = g["_s"].astype(float)[:, None]
        total = np.cumsum(np.concatenate([s - margins, -s - margins], axis=1), axis=0)
        level = total - np.minimum(-state[:-1], np.minimum.accumulate(total, axis=0))
        up, down = level[:, : len(margins)].max(axis=1), level[:, len(margins) :].max(axis=1)
        steps = (state[-1] + 1 + np.arange(len(s))).astype(np.int64)
        out = {**{n: g[n] for n in names}, "t": steps, "positive": up, "negative": down, "cusum": np.maximum(up, down)}
        return out, np.concatenate([level[-1], [steps[-1]]])

    return step, np.zeros(2 * len(margins) + 1)


def sr_kernel(names: Sequence[str], bets: Sequence[float], weights: Sequence[float] | None = None, threshold: float = 1000.0):
    """Mixture of ``R <- (R + 1)(1 + beta s)``, frozen after the alarm.

    State: components, step count, alarm step (0 = none). Returns the step and its start state.
    """
    b, names = np.asarray(bets, dtype=float), list(names)
    w = np.full(len(b), 1.0 / len(b)) if weights is None else np.asarray(weights, dtype=float)

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        r, t, alarm, rows = state[:-2].copy(), state[-2], state[-1], []
        for s in checked_scores(g):
            t += 1
            if not alarm:
                r = (r + 1.0) * (1.0 + b * s)
                if w @ r >= threshold * (1 - 1e-12):
                    alarm = t
            rows.append((int(t), float(w @ r), bool(alarm), int(alarm) if alarm else None))
        steps, stat, alarms, first = zip(*rows, strict=True)
        out = {**{n: g[n] for n in names}, "t": steps, "stat": stat, "alarm": alarms, "alarm_time": first}
        return out, np.concatenate([r, [t, alarm]])

    return step, np.zeros(len(b) + 2)


def eprocess_kernel(names: Sequence[str], bets: Sequence[float], weights: Sequence[float], horizon: int, alpha: float = 0.01):
    """Uniform-start e-process in the log domain; more rows than ``horizon`` is an error."""
    b, w, names = np.asarray(bets, dtype=float), np.asarray(weights, dtype=float), list(names)

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        a, t, alarm, rows = state[:-2].copy(), state[-2], state[-1], []
        with np.errstate(divide="ignore"):
            for s in checked_scores(g):
                t += 1
                if t > horizon:
                    raise ValueError("the e-process horizon is exhausted")
                a = np.log(np.clip(1.0 + b * s, 0.0, None)) + np.logaddexp(a, -np.log(horizon))
                e = (horizon - t) / horizon + float(w @ np.exp(np.minimum(a, 700.0)))
                alarm = alarm or (t if e >= 1.0 / alpha else 0)
                rows.append((int(t), e, bool(alarm)))
        steps, stat, alarms = zip(*rows, strict=True)
        out = {**{n: g[n] for n in names}, "t": steps, "stat": stat, "alarm": alarms}
        return out, np.concatenate([a, [t, alarm]])

    return step, np.concatenate([np.full(len(b), -np.inf), [0.0, 0.0]])
