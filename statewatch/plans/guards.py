"""Checks of size and of data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_ROWS = 4096


def require(condition: Column, value: Column, message: str) -> Column:
    """``value`` where ``condition`` holds; the query fails with ``message`` elsewhere."""
    holds = F.coalesce(condition, F.lit(False))
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)))


def bounded_model(df: DataFrame, rows: int = MODEL_ROWS) -> list:
    """Collect a fitted model. A model has one row per class, mode or role; more is an error."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a model may have at most {rows} rows")
    return found


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys, keeping one copy of the keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right
    condition = F.lit(True)
    for name in keys:
        renamed = renamed.withColumnRenamed(name, f"_r_{name}")
    for name in keys:
        condition = condition & left[name].eqNullSafe(renamed[f"_r_{name}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{name}" for name in keys])
