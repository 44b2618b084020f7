"""Encodings of a numeric row as a unit vector."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statewatch.functions.arrays import col, doubles, norm
from statewatch.plans.guards import require

ZERO_NORM = 1e-12


def amplitude(x: Column | str) -> Column:
    """``x / |x|``; a zero vector fails the query."""
    # one-level lambdas only: Spark cannot feed nested capturing lambdas to a Python UDF
    v = doubles(x)
    length = require(norm(v) > ZERO_NORM, norm(v), "a zero vector has no amplitude encoding")
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda a, n: a / n)


def affine(x: Column | str, scale: float = 1.0) -> Column:
    """Unit vector of ``[x, scale]``, so that scores see the sign of ``x``."""
    _positive(scale)
    return amplitude(F.concat(doubles(x), F.array(F.lit(float(scale)))))


def stereographic(x: Column | str, scale: float = 1.0) -> Column:
    """``(2 s x, |x|^2 - s^2) / (|x|^2 + s^2)``; a zero vector is allowed."""
    _positive(scale)
    v = doubles(x)
    square = F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a)
    below = F.array_repeat(square + scale * scale, F.size(v))
    head = F.zip_with(v, below, lambda a, b: 2.0 * scale * a / b)
    return amplitude(F.concat(head, F.array((square - scale * scale) / (square + scale * scale))))


def _positive(scale: float) -> None:
    if not 0 < scale < float("inf"):
        raise ValueError("scale must be finite and positive")


def encode(x: Column | str, kind: str = "amplitude", scale: float = 1.0) -> Column:
    """Encoding by name; case, ``-`` and ``_`` do not matter."""
    name = kind.strip().lower().replace("-", "_")
    if name == "amplitude":
        return amplitude(x)
    if name in ("affine", "affine_amplitude"):
        return affine(x, scale)
    if name in ("stereographic", "stereo"):
        return stereographic(x, scale)
    raise ValueError(f"unknown encoding {kind!r}")


def encoded_size(size: int, kind: str) -> int:
    return size if kind.strip().lower() == "amplitude" else size + 1


def pad_pow2(x: Column | str) -> Column:
    """Zero-pad to the next power of two."""
    v = doubles(x)
    n = F.size(v)
    target = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    return F.concat(v, F.array_repeat(F.lit(0.0), target - n))


def one_hot(value: Column | str, categories: Sequence) -> Column:
    """Basis vector of a category; a value outside ``categories`` gives all zeros."""
    c = col(value)
    return F.array(*[(c == F.lit(k)).cast("double") for k in categories])


def power_spectrum(x: Column | str) -> Column:
    """Squared modulus of the DFT, scaled to sum to one: blind to cyclic shifts and to sign."""
    @F.pandas_udf("array<double>")
    def spectrum(rows: pd.Series) -> pd.Series:
        def one(block: np.ndarray) -> np.ndarray:
            power = np.abs(np.fft.fft(block, axis=1)) ** 2
            return power / power.sum(axis=1, keepdims=True)

        if not len(rows):
            return rows
        sizes = rows.map(len)
        if sizes.nunique() == 1:
            return pd.Series(list(one(np.stack(rows.to_list()))), index=rows.index)
        return rows.map(lambda r: one(np.asarray(r)[None, :])[0])

    return spectrum(doubles(x))
