"""Features of binary event rows (``array`` of 0/1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statewatch.functions.arrays import col, doubles, let, minus, outer, total


def unpack(code: Column | str, width: int) -> Column:
    """Bits of an integer, least significant first."""
    return F.array(*[F.getbit(col(code), F.lit(i)).cast("int") for i in range(width)])


def pack(bits: Column | str) -> Column:
    """Inverse of ``unpack`` for up to 62 bits."""
    shifted = F.transform(col(bits), lambda b, i: b.cast("bigint") * F.pow(F.lit(2.0), i.cast("double")).cast("bigint"))
    return F.aggregate(shifted, F.lit(0).cast("bigint"), lambda s, x: s + x)


def signs(bits: Column | str) -> Column:
    """``1 - 2 e``."""
    return F.transform(doubles(bits), lambda b: 1.0 - 2.0 * b)


def firing_rate(bits: Column | str) -> Column:
    return total(doubles(bits)) / F.size(col(bits))


def pair_equality(bits: Column | str) -> Column:
    """``[e_i ; 1{e_i = e_j}]`` with pairs in lexicographic order; length ``q (q+1) / 2``."""

    def lifted(b: Column) -> Column:
        rest = F.transform(
            b, lambda x, i: F.transform(F.slice(b, i + 2, F.size(b)), lambda y: (x == y).cast("double"))
        )
        return F.concat(b, F.flatten(rest))

    return let(doubles(bits), lifted)


def spin_density(bits: Column | str) -> Column:
    """``z z' / q`` with ``z = 1 - 2 e``, row-major."""
    return let(signs(bits), lambda z: outer(F.transform(z, lambda a: a / F.size(z)), z))


def paired_contrast(reference: Column | str, monitor: Column | str) -> Column:
    """Monitor minus reference for the three features."""
    return F.struct(
        minus(pair_equality(monitor), pair_equality(reference)).alias("features"),
        minus(spin_density(monitor), spin_density(reference)).alias("density"),
        (firing_rate(monitor) - firing_rate(reference)).alias("rate"),
    )


def grid_counts(bits: Column | str, size: int) -> Column:
    """``(s, c1, c2)``: events, and adjacent event pairs at distance 1 and 2 along both axes.

    On a periodic square grid these three integers carry everything the translation statistics
    and the template likelihood need.
    """

    def together(b: Column, step: int) -> Column:
        def at(v: Column) -> Column:
            row, column = F.floor(v / size), v % size
            right = (row * size + (column + step) % size).cast("int")
            down = ((row + step) % size * size + column).cast("int")
            return F.get(b, v.cast("int")) * (F.get(b, right) + F.get(b, down))

        return total(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), at))

    return let(
        doubles(bits),
        lambda b: F.struct(total(b).alias("s"), together(b, 1).alias("c1"), together(b, 2).alias("c2")),
    )


def grid_pair_stats(bits: Column | str, size: int) -> Column:
    """``(mean z, g1, g2)`` with ``g_l`` the mean of ``z_v z_{v+l}`` over sites and both axes."""
    n = float(size * size)

    # sum of z_v z_w over 2n neighbour pairs: (1-2a)(1-2b) = 1 - 2a - 2b + 4ab, each site in 4 pairs
    def g(c: Column, name: str) -> Column:
        return ((2.0 * n - 8.0 * c["s"] + 4.0 * c[name]) / (2.0 * n)).alias(name.replace("c", "g"))

    return let(
        grid_counts(bits, size), lambda c: F.struct((1.0 - 2.0 * c["s"] / n).alias("z"), g(c, "c1"), g(c, "c2"))
    )


def power_state_2d(bits: Column | str, size: int) -> Column:
    """Normalised squared modulus of the 2-D DFT of ``1 - 2 e``; row-major, sums to one."""
    @F.pandas_udf("array<double>")
    def spectrum(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return rows
        z = 1.0 - 2.0 * np.stack(rows.to_list()).reshape(-1, size, size)
        power = np.abs(np.fft.fft2(z)) ** 2
        power /= power.sum(axis=(1, 2), keepdims=True)
        return pd.Series(list(power.reshape(len(rows), -1)), index=rows.index)

    return spectrum(doubles(bits))


def mode_orbits(size: int) -> list[list[int]]:
    """Fourier modes of a square grid that the eight grid symmetries map to each other."""
    groups: dict[int, list[int]] = {}
    for mode in range(size * size):
        r, c = divmod(mode, size)
        images = [(a * u % size) * size + (b * v % size) for u, v in ((r, c), (c, r)) for a in (1, -1) for b in (1, -1)]
        groups.setdefault(min(images), []).append(mode)
    return [groups[k] for k in sorted(groups)]


def orbit_sum(power: Column | str, orbits: list[list[int]]) -> Column:
    """Sum a spectrum inside each orbit; a simplex stays a simplex. Row-local, no shuffle."""

    def summed(p: Column) -> Column:
        return F.array(*[sum((F.get(p, F.lit(i)) for i in o[1:]), F.get(p, F.lit(o[0]))) for o in orbits])

    return let(col(power), summed)
