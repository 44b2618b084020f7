"""Random draws that depend on (seed, replicate, draw) only, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_index(n: Column | int, seed: int, *parts: Column) -> Column:
    """A draw from ``0 .. n-1``."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(F.lit(seed), *parts), size.cast("bigint"))


def draw_uniform(seed: int, *parts: Column) -> Column:
    """A draw from ``[0, 1)`` with 2**-52 resolution."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**52)).cast("double") / F.lit(float(2**52))
