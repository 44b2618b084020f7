"""Several detectors on the same stream, reduced to one alarm time per key and method."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import doubles
from statewatch.operators import sequences as T
from statewatch.plans import longest_group
from statewatch.plans.ordering import Group, key_runs, shuffle_tasks

BETS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)


def run_detectors(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, reference: Sequence[float], matched: Sequence[float],
    covariance=None, ridge: float = 1e-6, window: int = 64, every: int = 1, threshold: float = 1000.0, bets: Sequence[float] = BETS,
    ratios: str | None = None, alternatives: int = 0, rows_per_block: int | None = None,
) -> DataFrame:
    """``(key, method, alarm_time)`` for blind, raw, variance and matched scores, and likelihood ratios if given.

    The methods read the same rows and share nothing else; NULL means no alarm.
    """
    known = {"rows_per_block": rows_per_block, "longest": longest_group(df, key)}
    raw = T.simplex_witness(df, key, order, vec, reference, "raw", None, ridge, window, every, **known)
    variance = T.simplex_witness(df, key, order, vec, reference, "variance", covariance, ridge, window, every, **known)
    scored = {
        "blind": df.withColumn("score", F.lit(0.0)),
        "raw": raw,
        "variance": variance,
        "matched": df.withColumn("score", T.static_simplex_score(vec, reference, matched)),
    }
    traces = {
        name: T.bounded_sr(rows.select(*key, *order, "score"), key, order, "score", bets, None, threshold, **known)
        for name, rows in scored.items()
    }
    if ratios:
        traces["likelihood"] = T.lr_sr(df.select(*key, *order, ratios), key, order, ratios, alternatives, None, threshold, **known)
    out = None
    for name, trace in traces.items():
        row = trace.groupBy(*key).agg(F.min("alarm_time").alias("alarm_time")).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select(*key, "method", "alarm_time")


class KeyDetectors:
    """All detectors of one key: a product of their states, stepped together until each has alarmed."""

    def __init__(self, scorers: dict, threshold: float, bets: Sequence[float], alternatives: int) -> None:
        self.scorers = {name: (step, start.copy()) for name, (step, start) in scorers.items()}
        self.level, self.bets = threshold * (1 - 1e-12), np.asarray(bets, float)
        self.alarms: dict[str, int | None] = dict.fromkeys([*scorers, *(["likelihood"] if alternatives else [])])
        self.mass = {name: np.zeros(alternatives if name == "likelihood" else len(bets)) for name in self.alarms}
        self.t = 0

    @property
    def done(self) -> bool:
        return all(a is not None for a in self.alarms.values())

    def feed(self, g: Group) -> None:
        n = len(g["_x"])
        for name in [m for m, a in self.alarms.items() if a is None]:
            if name == "likelihood":
                factors = np.stack(list(g["_f"])).astype(float)
                if not (np.isfinite(factors) & (factors >= 0)).all():
                    raise ValueError("factors must be finite and nonnegative")
            else:
                step, state = self.scorers[name]
                out, after = step(g, state)
                self.scorers[name] = step, after
                factors = 1.0 + out["score"][:, None] * self.bets
            mass = self.mass[name]
            for i, f in enumerate(factors):
                mass = (mass + 1.0) * f
                if mass.mean() >= self.level:
                    self.alarms[name] = self.t + i + 1
                    break
            self.mass[name] = mass
        self.t += n


def run_detectors_once(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, reference: Sequence[float], matched: Sequence[float],
    covariance=None, ridge: float = 1e-6, window: int = 64, every: int = 1, threshold: float = 1000.0, bets: Sequence[float] = BETS,
    ratios: str | None = None, alternatives: int = 0,
) -> DataFrame:
    """``run_detectors`` in one pass: one shuffle by key, one Python stage, and no more work for a detector once it has alarmed.

    Rows of a key stream through the task that holds it, with the windows' rings and one mass per bet in memory; a key whose detectors have all
    alarmed lets its other rows pass.
    """
    from statewatch.streaming.rolling import simplex_kernel

    if any(not 0 <= e <= 1 for e in matched):
        raise ValueError("effect entries must lie in [0, 1]")
    key = list(key)
    ref, effect = np.asarray(reference, float), np.asarray(matched, float)
    factors = F.lit(None).cast("array<double>") if ratios is None else doubles(ratios)
    rows = df.select(*key, *[c for c in order if c not in key], doubles(vec).alias("_x"), factors.alias("_f"))
    ordered = rows.repartition(shuffle_tasks(rows), *key).sortWithinPartitions(*key, *order)
    count = alternatives if ratios else 0

    def fixed(weights: np.ndarray):
        def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
            x = np.maximum(np.stack(list(g["_x"])).astype(float), 0.0)
            return {"score": np.clip((x / x.sum(axis=1, keepdims=True) - ref) @ weights, -1.0, 1.0)}, state

        return step, np.zeros(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = {
            "blind": fixed(np.zeros(len(ref))),
            "raw": simplex_kernel([], ref, "raw", None, ridge, window, every),
            "variance": simplex_kernel([], ref, "variance", covariance, ridge, window, every),
            "matched": fixed(effect),
        }
        last, held = None, None

        def ended() -> pd.DataFrame:
            out = pd.DataFrame([(*last, m, a) for m, a in held.alarms.items()], columns=[*key, "method", "alarm_time"])
            out["alarm_time"] = out["alarm_time"].astype("Int64")
            return out

        for pdf in batches:
            if not len(pdf):
                continue
            for name, a, b in key_runs(pdf, key):
                if name != last:
                    if held is not None:
                        yield ended()
                    last, held = name, KeyDetectors(scorers, threshold, bets, count)
                if not held.done:
                    held.feed({c: pdf[c].iloc[a:b].to_numpy() for c in ("_x", "_f")})
        if held is not None:
            yield ended()

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ordered.mapInPandas(run, "".join(f"`{k}` {fields[k]}, " for k in key) + "method string, alarm_time bigint")
