"""One-row update rules of the adaptive witnesses, shared by the batch and streaming operators.

Every rule scores a row with what it learned from earlier rows and only then learns from it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def smoothing(half_life: float) -> float:
    """EWMA weight of a new row."""
    if not 0 < half_life < float("inf"):
        raise ValueError("half_life must be finite and positive")
    return 1.0 - 2.0 ** (-1.0 / half_life)


def top_k_scores(average: np.ndarray, x: np.ndarray, ks: Sequence[int], tolerance: float = 1e-12) -> np.ndarray:
    """Scores of ``x`` (p, or a row for each of ``average``) under the signed top-k witnesses of each row of ``average`` (m x p): m x len(ks)."""
    order = np.argsort(-np.abs(average), axis=1, kind="stable")[:, : max(ks)]  # ties keep the lower index first
    gains = np.where(np.take_along_axis(average, order, 1) < 0, -1.0, 1.0) * (x[order] if x.ndim == 1 else np.take_along_axis(x, order, 1))
    cum = gains.cumsum(axis=1)
    scores = np.stack([cum[:, k - 1] / k for k in ks], axis=1)
    scores[np.abs(average).max(axis=1) <= tolerance] = 0.0
    return np.clip(scores, -1.0, 1.0)


def spectral_effects(average: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Rank-one and positive-part effects of each symmetric matrix: (m, d, d) -> (m, 2, d, d).

    Among tied leading eigenvectors the rank-one effect is anchored at the coordinate with the
    largest weight in the tied space (lowest index on ties), so it does not depend on the solver.
    """
    values, vectors = np.linalg.eigh(0.5 * (average + average.transpose(0, 2, 1)))
    out = np.zeros((len(average), 2, *average.shape[1:]))
    some = np.flatnonzero(values[:, -1] > tolerance)
    lam, vec = values[some], vectors[some]
    gained = vec * (lam > tolerance)[:, None]
    out[some, 1] = gained @ gained.transpose(0, 2, 1)
    tied = vec * (lam >= lam[:, -1:] - tolerance)[:, None]
    space = tied @ tied.transpose(0, 2, 1)
    weight = np.clip(np.diagonal(space, axis1=1, axis2=2), 0.0, None)
    anchor = (weight >= weight.max(axis=1, keepdims=True) - tolerance).argmax(axis=1)
    each = np.arange(len(some))
    unit = space[each, :, anchor] / np.sqrt(weight[each, anchor])[:, None]
    out[some, 0] = unit[:, :, None] * unit[:, None]
    return out


def logistic_step(w: np.ndarray, d: np.ndarray, rates: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, losses and next weights of pairwise logistic learners (one row of ``w`` each)."""
    margin = w @ d
    score = np.tanh(margin / np.maximum(1.0, np.abs(w).sum(axis=1)))
    loss = np.logaddexp(0.0, -margin) + 0.5 * l2 * (w * w).sum(axis=1)
    small = np.exp(-np.abs(margin))
    miss = np.where(margin >= 0, small, 1.0) / (1.0 + small)
    after = w + rates[:, None] * (miss[:, None] * d - l2 * w)
    return np.clip(score, -1.0, 1.0), loss, after


def pair_features(bits: np.ndarray) -> np.ndarray:
    """``[e_i ; 1{e_i = e_j}]`` for each row of a 0/1 matrix."""
    i, j = np.triu_indices(bits.shape[1], 1)
    return np.concatenate([bits, (bits[:, i] == bits[:, j]).astype(float)], axis=1)
