"""Exact interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewatch.plans import ordering
from statewatch.plans.guards import null_safe


def quantiles(
    df: DataFrame, key: Sequence[str], value: str, levels: Mapping[str, float], rows_per_block: int | None = None
) -> DataFrame:
    """One row per key with a column per entry of ``levels`` (linear interpolation, NULLs ignored).

    Equal values are merged first, so a column of few values costs few rows however many hold them. Running counts over the distinct
    values then show which of them hold the two order statistics on either side of each level.
    """
    data = df.where(F.col(value).isNotNull())
    cells = data.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = ordering.place(cells, key, [value], "_rank", rows_per_block or ordering.ROWS_PER_BLOCK)
    ranked = placed.running(_upto=("sum", F.col("_c"))).rows()
    joined = null_safe(ranked, data.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), list(key))
    picks = []
    for name, q in levels.items():
        spot = (F.col("_n") - 1) * F.lit(q)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            holds = (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c"))
            picks.append(F.max(F.when(holds, F.col(value))).cast("double").alias(f"_{side}_{name}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"_f_{name}"))
    found = joined.groupBy(*key).agg(*picks)
    between = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")
    return found.select(*key, *[between(n).alias(n) for n in levels])
