"""Ordered detectors: Shiryaev-Roberts mixtures, uniform-start e-processes, Page CUSUM, HMM blocks.

All of them are running sums, running minima or affine recursions ``A <- (A + c) * f``. They are
computed with window functions when the known length of the longest key proves that the closed
form cannot overflow; otherwise by a log-domain kernel over blocks of consecutive rows, with a
small carry per block, so a key of any length is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewatch.functions.arrays import doubles, log0, vector
from statewatch.functions.bets import bounded_score
from statewatch.functions.likelihood import TemplateModel
from statewatch.plans import Placed, place, require
from statewatch.plans.durable import durable
from statewatch.plans.guards import null_safe
from statewatch.plans.ordering import Group, block_rows

SAFE_LOG = 600.0
START = 6.0 / math.pi**2


# ---------------------------------------------------------------- affine recursions


def _log_accumulate(log_f: np.ndarray, log_c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logs of ``A_t = (A_{t-1} + c_t) f_t`` for each column, from ``log A_0 = start``.

    A zero factor sets A to zero, so the rows after it are a fresh run.
    """
    if np.isfinite(log_f).all():
        c = np.cumsum(log_f, axis=0)
        terms = np.repeat(log_c[:, None], log_f.shape[1], axis=1)
        terms[1:] -= c[:-1]
        terms[0] = np.logaddexp(terms[0], start)
        return c + np.logaddexp.accumulate(terms, axis=0)
    out = np.empty_like(log_f)
    for j in range(log_f.shape[1]):
        carry, first = start[j], 0
        stops = [*np.flatnonzero(np.isneginf(log_f[:, j])), len(log_f)]
        for stop in stops:
            if stop > first:
                c = np.cumsum(log_f[first:stop, j])
                shift = np.concatenate([[0.0], c[:-1]])
                terms = log_c[first:stop] - shift
                terms[0] = np.logaddexp(terms[0], carry)
                out[first:stop, j] = c + np.logaddexp.accumulate(terms)
            if stop < len(log_f):
                out[stop, j] = -np.inf
            carry, first = -np.inf, stop + 1
    return out


def affine_logs(placed: Placed, factors: Column, inject: Column, keep: Sequence[str], components: int) -> DataFrame:
    """``log_a``: logs of every component of the recursion, one array per row, plus ``keep``."""
    table = placed.with_columns({"_f": doubles(factors), "_c": inject.cast("double")})
    columns = [*keep, "_f", "_c"]
    names = [*placed.key, placed.pos, *keep]
    fields = {f.name: f.dataType.simpleString() for f in table.df.schema.fields}
    schema = ", ".join(f"`{n}` {fields[n]}" for n in dict.fromkeys(names)) + ", log_a array<double>"

    names = list(dict.fromkeys(names))

    def logs(g: Group) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return np.log(np.stack(g["_f"])), np.log(g["_c"].astype(float))

    def apply(g: Group, state: np.ndarray) -> Group:
        log_f, log_c = logs(g)
        return {**{n: g[n] for n in names}, "log_a": _log_accumulate(log_f, log_c, state)}

    def summarize(g: Group) -> np.ndarray:
        log_f, log_c = logs(g)
        end = _log_accumulate(log_f, log_c, np.full(components, -np.inf))[-1]
        return np.concatenate([log_f.sum(axis=0), end])

    def combine(state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        slope, end = summary[:components], summary[components:]
        return np.logaddexp(state + slope, end)

    return table.scan(schema, columns, apply, np.full(components, -np.inf), summarize, combine)


def affine_window(placed: Placed, factors: Sequence[Column], inject: Column) -> Placed:
    """The same recursion as window functions, for keys short enough not to overflow.

    With C the running log product, ``A_t = exp(C_t) * sum_s c_s exp(-C_{s-1})``. Adds ``_a0``, ``_a1``, ....
    """
    logs = {f"_l{j}": F.log(f) for j, f in enumerate(factors)}
    p = placed.with_columns({**logs, "_inj": inject.cast("double")})
    p = p.running(**{f"_C{j}": ("sum", F.col(f"_l{j}")) for j in range(len(factors))})
    terms = {f"_S{j}": ("sum", F.col("_inj") * F.exp(F.col(f"_l{j}") - F.col(f"_C{j}"))) for j in range(len(factors))}
    p = p.running(**terms)
    values = {f"_a{j}": F.exp(F.col(f"_C{j}")) * F.col(f"_S{j}") for j in range(len(factors))}
    p = p.with_columns(values)
    drop = [f"{n}{j}" for j in range(len(factors)) for n in ("_l", "_C", "_S")]
    return p.with_df(p.df.drop(*drop, "_inj"))


def _weights(n: int, weights: Sequence[float] | None) -> list[float]:
    w = [1.0 / n] * n if weights is None else [float(x) for x in weights]
    if len(w) != n or min(w) < 0 or not math.isclose(sum(w), 1.0, rel_tol=1e-12):
        raise ValueError("weights must be nonnegative and sum to one")
    return w


def _mixture(placed: Placed, factors: Sequence[Column], weights: list[float], inject: Column, keep: Sequence[str], log_range: float | None, tail: Column | None = None) -> DataFrame:
    """``log_stat``, ``stat``: the weighted mixture of components (plus ``tail``) at every row."""
    names = list(dict.fromkeys([*placed.key, placed.pos, *keep]))
    if log_range is not None and placed.longest * log_range <= SAFE_LOG:
        p = affine_window(placed, factors, inject)
        stat = sum(F.lit(w) * F.col(f"_a{j}") for j, w in enumerate(weights))
        stat = stat if tail is None else stat + tail
        out = p.df.withColumn("stat", stat).withColumn("log_stat", log0(F.col("stat")))
        return out.select(*names, "log_stat", "stat")
    rows = affine_logs(placed, F.array(*factors), inject, keep, len(factors))
    log_w = vector([math.log(w) if w > 0 else float("-inf") for w in weights])
    terms = F.zip_with("log_a", log_w, lambda a, b: a + b)
    if tail is not None:
        terms = F.concat(terms, F.array(log0(tail)))
    rows = rows.withColumn("_t", terms).withColumn("_top", F.array_max("_t"))
    summed = F.aggregate(F.zip_with("_t", F.array_repeat("_top", F.size("_t")), lambda a, m: F.exp(a - m)), F.lit(0.0), lambda s, x: s + x)
    log_stat = F.when(F.col("_top") == float("-inf"), F.col("_top")).otherwise(F.col("_top") + F.log(summed))
    return rows.withColumn("log_stat", log_stat).withColumn("stat", F.exp(F.least("log_stat", F.lit(709.0)))).select(*names, "log_stat", "stat")


def _alarms(rows: DataFrame, placed: Placed, key: Sequence[str], pos: str, crossing: Column, freeze: bool) -> DataFrame:
    """Sticky alarm with its first step; with ``freeze`` the statistic keeps its value from then on.

    The trace is evaluated once: where every key fits a task, the first crossing is a window over the key; where keys are cut into
    blocks, the trace is written and its first crossings joined to it.
    """
    first = F.min(F.when(crossing, F.col(pos)))
    at = F.min_by(F.struct("log_stat", "stat"), F.when(crossing, F.col(pos)))
    if placed.blocked:
        rows = durable(rows, "trace")
        found = rows.where(crossing).groupBy(*key).agg(first.alias("alarm_time"), at.alias("_at"))
        out = null_safe(rows, found, list(key), "left")
    else:
        whole = Window.partitionBy(*key)
        out = rows.withColumns({"alarm_time": first.over(whole), **({"_at": at.over(whole)} if freeze else {})})
    alarm = F.coalesce(F.col(pos) >= F.col("alarm_time"), F.lit(False))
    out = out.withColumn("alarm", alarm)
    if freeze:
        held = F.col("alarm")
        out = out.withColumns(
            {n: F.when(held, F.col(f"_at.{n}")).otherwise(F.col(n)) for n in ("log_stat", "stat")}
        )
    return out.withColumn("alarm_time", F.when(F.col("alarm"), F.col("alarm_time"))).drop("_at")


def bounded_sr(
    df: DataFrame, key: Sequence[str], order: Sequence[str], score: str, bets: Sequence[float] = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    weights: Sequence[float] | None = None, threshold: float = 1000.0, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Mixture of ``R <- (R + 1)(1 + beta s)``; frozen once it reaches ``threshold``."""
    if threshold <= 0 or any(not 0 < b <= 1 for b in bets):
        raise ValueError("threshold must be positive and bets in (0, 1]")
    w = _weights(len(bets), weights)
    s = bounded_score(score, 1e-9)
    placed = place(df.withColumn("_s", s), key, order, rows_per_block=rows_per_block, longest=longest)
    factors = [1.0 + F.lit(float(b)) * F.col("_s") for b in bets]
    span = None if max(bets) >= 1 else -math.log(1 - max(bets))
    rows = _mixture(placed, factors, w, F.lit(1.0), [score], span)
    return _alarms(rows, placed, key, "t", F.col("stat") >= threshold * (1 - 1e-12), True)


def lr_sr(
    df: DataFrame, key: Sequence[str], order: Sequence[str], ratios: str, alternatives: int, weights: Sequence[float] | None = None,
    threshold: float = 1000.0, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Mixture of ``R <- (R + 1) L`` for likelihood ratios L >= 0 (array column); frozen after the alarm."""
    w = _weights(alternatives, weights)
    good = (F.size(ratios) == alternatives) & F.forall(doubles(ratios), lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    checked = df.withColumn("_f", require(good, doubles(ratios), "likelihood ratios must be finite and nonnegative"))
    placed = place(checked, key, order, rows_per_block=rows_per_block, longest=longest, spread=True)
    factors = [F.get("_f", F.lit(j)) for j in range(alternatives)]
    rows = _mixture(placed, factors, w, F.lit(1.0), [], None)
    return _alarms(rows, placed, key, "t", F.col("stat") >= threshold * (1 - 1e-12), True)


def eprocess_bank(
    df: DataFrame, key: Sequence[str], order: Sequence[str], factors: str, weights: Sequence[float], horizon: int, alpha: float = 0.01,
    log_range: float | None = None, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Uniform-start e-process ``E = (H - t)/H + sum pi A`` with ``A <- L (A + 1/H)``; alarm at 1/alpha.

    ``factors`` is an array column; ``log_range`` bounds its absolute logs, if known. More rows
    than ``horizon`` in a key fail the query. The bank keeps running after the alarm.
    """
    w = _weights(len(weights), weights)
    placed = place(df.withColumn("_f", _factors(factors, len(w))), key, order, rows_per_block=rows_per_block, longest=longest, spread=True)
    if placed.longest > horizon:
        raise ValueError("the e-process horizon is exhausted")
    parts = [F.get("_f", F.lit(j)) for j in range(len(w))]
    tail = (F.lit(float(horizon)) - F.col("t")) / float(horizon)
    rows = _mixture(placed, parts, w, F.lit(1.0 / horizon), [], log_range, tail)
    return _alarms(rows, placed, key, "t", F.col("stat") >= 1.0 / alpha, False)


def sr_bank(
    df: DataFrame, key: Sequence[str], order: Sequence[str], factors: str, weights: Sequence[float], gamma: float,
    log_range: float | None = None, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Mixture of ``R <- (R + 1) L``; sticky alarm at ``gamma``, the statistic keeps running."""
    w = _weights(len(weights), weights)
    placed = place(df.withColumn("_f", _factors(factors, len(w))), key, order, rows_per_block=rows_per_block, longest=longest, spread=True)
    parts = [F.get("_f", F.lit(j)) for j in range(len(w))]
    rows = _mixture(placed, parts, w, F.lit(1.0), [], log_range)
    return _alarms(rows, placed, key, "t", F.col("stat") >= gamma, False)


def _factors(name: str, n: int) -> Column:
    f = doubles(name)
    good = (F.size(f) == n) & F.forall(f, lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return require(good, f, "factors must be finite and nonnegative")


# ---------------------------------------------------------------- Page CUSUM


def page_cusum(
    df: DataFrame, key: Sequence[str], order: Sequence[str], channels: Sequence[str], kappas: Sequence[float] = (0.01, 0.05, 0.1),
    rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Two-sided ``S <- max(0, S +- x - kappa)`` per channel, restarted at each key; score = largest.

    With P the running sum of a block that starts in S, ``S_t = P_t - min(-S, min P)``: two cumulative array operations for all channels,
    margins and sides at once. A block is summed up by its total and its smallest P, so long keys run in parallel.
    """
    margins = np.array(kappas, dtype=float)
    names = [c for c in df.columns if c != "t"]
    inputs = [f"_x{i}" for i in range(len(channels))]
    rows = df.select(*names, *[F.col(c).cast("double").alias(n) for c, n in zip(channels, inputs, strict=True)])
    placed = place(rows, key, order, rows_per_block=rows_per_block, longest=longest, spread=True)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
    size = 2 * len(channels) * len(margins)

    def paths(g: Group) -> np.ndarray:
        x = np.stack([np.asarray(g[n], dtype=float) for n in inputs], axis=1)[:, :, None]
        return np.cumsum(np.concatenate([(x - margins).reshape(len(x), -1), (-x - margins).reshape(len(x), -1)], axis=1), axis=0)

    def apply(g: Group, state: np.ndarray) -> Group:
        total = paths(g)
        level = total - np.minimum(-state, np.minimum.accumulate(total, axis=0))
        up, down = level[:, : size // 2].max(axis=1), level[:, size // 2 :].max(axis=1)
        return {**{n: g[n] for n in [*names, "t"]}, "positive": up, "negative": down, "cusum": np.maximum(up, down)}

    def summarize(g: Group) -> np.ndarray:
        total = paths(g)
        return np.concatenate([total[-1], total.min(axis=0)])

    def combine(state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return summary[:size] - np.minimum(-state, summary[size:])

    schema = fields + ", t bigint, positive double, negative double, cusum double"
    return placed.scan(schema, [*names, *inputs], apply, np.zeros(size), summarize, combine)


# ---------------------------------------------------------------- two-state chains


def hmm_increments(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bits: str, model: TemplateModel, q: float, kappa: float,
    rows_per_block: int | None = None, check: bool = True, longest: int | None = None,
) -> DataFrame:
    """Log-ratio increment of each block of two rows: two-state chain against independent rows.

    The increments of a key add up to its exact path log ratio. The filter is a product of 2 x 2
    matrices, so blocks of a long key are multiplied in parallel.
    """
    counts = model.counts(bits)
    rows = df.withColumn("_g", counts)
    rows = rows.withColumns({"_e1": model.conditional(F.col("_g"), 1), "_e2": model.conditional(F.col("_g"), 2), "_n": model.loglik(F.col("_g"), q)})
    placed = place(rows.drop("_g"), key, order, rows_per_block=block_rows(rows_per_block, 2), longest=longest, spread=True)
    step = np.array(model.transition(q, kappa))
    start = np.array([1 - q, q])
    names, pos = list(placed.key), placed.pos
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{n}` {fields[n]}, " for n in names) + "block bigint, increment double"

    def emissions(g: Group) -> tuple[np.ndarray, np.ndarray]:
        e = np.stack([g["_e1"], g["_e2"]], axis=1).astype(float)
        top = e.max(axis=1)
        return np.exp(e - top[:, None]), top

    # state: filtered probabilities before the next transition, or the prior flagged by a third entry
    def apply(g: Group, state: np.ndarray) -> Group:
        e, top = emissions(g)
        p, fresh = state[:2], state[2] > 0
        gain = np.empty(len(e))
        for i in range(len(e)):
            joint = (p if fresh else p @ step) * e[i]
            mass = joint.sum()
            gain[i] = math.log(mass) + top[i]
            p, fresh = joint / mass, False
        gain -= g["_n"].astype(float)
        if len(gain) % 2:
            if check:
                raise ValueError("block increments need an even number of rows per key")
            gain = gain[:-1]
        pairs = len(gain) // 2
        out = {n: g[n][:pairs] for n in names}
        return {**out, "block": (g[pos][: len(gain) : 2] - 1) // 2, "increment": gain.reshape(-1, 2).sum(axis=1)}

    def summarize(g: Group) -> np.ndarray:
        e, _ = emissions(g)
        first, rest = np.diag(e[0]), np.eye(2)
        for i in range(1, len(e)):
            rest = rest @ step * e[i]
            rest /= rest.sum()
        return np.concatenate([(first @ rest).ravel(), (step @ first @ rest).ravel()])

    def combine(state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        m = summary[:4] if state[2] > 0 else summary[4:]
        p = state[:2] @ m.reshape(2, 2)
        return np.array([*(p / p.sum()), 0.0])

    return placed.scan(schema, ["_e1", "_e2", "_n"], apply, np.array([*start, 1.0]), summarize, combine)


def chain_step(names: Sequence[str], mats: np.ndarray, prior: np.ndarray, w: np.ndarray):
    """Step of ``hmm_sr`` over consecutive rows ``_a``, ``_b``, with the parts its summaries use. The state is the masses and their scale in logs."""
    k, h = mats.shape[0], mats.shape[1]

    def emissions(g: Group) -> tuple[np.ndarray, np.ndarray]:
        return np.stack(g["_a"]), np.stack(g["_b"])

    def advance(mass: np.ndarray, scale: float, a: np.ndarray, b: np.ndarray, inject: bool) -> tuple[np.ndarray, float]:
        moved = np.einsum("...kh,khj->...kj", mass, mats)
        if inject:
            moved = moved + prior * math.exp(-scale)
        moved = np.einsum("...kh,khj->...kj", moved * a, mats) * b
        top = moved.max()
        if top > 1e100 or (0 < top < 1e-100):
            return moved / top, scale + math.log(top)
        return moved, scale

    def step(g: Group, state: np.ndarray) -> tuple[Group, np.ndarray]:
        a, b = emissions(g)
        mass, scale = state[:-1].reshape(k, h), float(state[-1])
        logs = np.empty(len(a))
        for i in range(len(a)):
            mass, scale = advance(mass, scale, a[i], b[i], True)
            total = float(w @ mass.sum(axis=1))
            logs[i] = math.log(total) + scale if total > 0 else -np.inf
        out = {**{n: g[n] for n in names}, "log_stat": logs, "stat": np.exp(np.minimum(logs, 709.0))}
        return out, np.concatenate([mass.ravel(), [scale]])

    return step, emissions, advance


def hmm_sr(
    df: DataFrame, key: Sequence[str], order: Sequence[str], first: str, second: str, transitions: Sequence[Sequence[Sequence[float]]],
    stationary: Sequence[float], weights: Sequence[float] | None = None, threshold: float = 1000.0, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Shiryaev-Roberts mass per alternative chain and hidden state, two emissions per row.

    ``first`` and ``second`` are arrays of emission ratios per hidden state. The prior enters
    before the first emission of each row. The map of a row is affine, so rows compose; logs are
    kept as a scale beside the masses.
    """
    mats, prior = np.asarray(transitions, dtype=float), np.asarray(stationary, dtype=float)
    k, h = mats.shape[0], mats.shape[1]
    if (mats < 0).any() or not np.allclose(mats.sum(axis=2), 1) or not np.allclose(np.einsum("h,khj->kj", prior, mats), prior):
        raise ValueError("transitions must be stochastic with the given stationary vector")
    w = np.array(_weights(k, weights))
    positive = lambda c: F.forall(doubles(c), lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    rows = df.withColumns(
        {"_a": require(positive(first), doubles(first), "ratios must be finite and nonnegative"),
         "_b": require(positive(second), doubles(second), "ratios must be finite and nonnegative")}
    )
    placed = place(rows, key, order, rows_per_block=rows_per_block, longest=longest, spread=True)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names, pos = list(placed.key), placed.pos
    schema = "".join(f"`{n}` {fields[n]}, " for n in names) + "t bigint, log_stat double, stat double"

    step, emissions, advance = chain_step([*names, pos], mats, prior, w)

    def apply(g: Group, state: np.ndarray) -> Group:
        return step(g, state)[0]

    def summarize(g: Group) -> np.ndarray:
        a, b = emissions(g)
        own, own_scale = np.zeros((k, h)), 0.0
        basis, basis_scale = np.broadcast_to(np.eye(h)[:, None, :], (h, k, h)).copy(), 0.0
        for i in range(len(a)):
            own, own_scale = advance(own, own_scale, a[i], b[i], True)
            basis, basis_scale = advance(basis, basis_scale, a[i], b[i], False)
        return np.concatenate([own.ravel(), [own_scale], basis.ravel(), [basis_scale]])

    def combine(state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        n = k * h
        own, own_scale = summary[:n].reshape(k, h), summary[n]
        basis, basis_scale = summary[n + 1 : -1].reshape(h, k, h), summary[-1]
        carried = np.einsum("kg,gkh->kh", state[:-1].reshape(k, h), basis)
        moved_scale = state[-1] + basis_scale
        scale = max(own_scale, moved_scale)
        return np.concatenate([(own * math.exp(own_scale - scale) + carried * math.exp(moved_scale - scale)).ravel(), [scale]])

    scanned = placed.scan(schema, ["_a", "_b"], apply, np.zeros(k * h + 1), summarize, combine)
    return _alarms(scanned, placed, key, "t", F.col("stat") >= threshold * (1 - 1e-12), True)


# ---------------------------------------------------------------- predictable linear witnesses


def _trailing(df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, dim: int, window: int, every: int, rows_per_block: int | None, longest: int | None) -> Placed:
    """Trailing mean of the last ``window`` rows as of the latest refit before each row (``_m``), NULL before the first."""
    placed = place(df, key, order, rows_per_block=rows_per_block, longest=longest)
    x = doubles(vec)

    def means(w):
        frame = w.rowsBetween(-(window - 1), 0)
        mean = F.array(*[F.avg(F.get(x, F.lit(i))).over(frame) for i in range(dim)])
        return {"_fit": F.when(F.pmod(F.col("t"), F.lit(every)) == 0, mean)}

    placed = placed.look_back(window, means)
    placed = placed.look_back(every, lambda w: {"_m": F.last("_fit", ignorenulls=True).over(w.rowsBetween(-every, -1))})
    return placed.with_df(placed.df.drop("_fit"))


def _direction(delta: Column, dim: int, covariance, ridge: float) -> Column:
    """``(V + ridge I)^-1 delta``."""
    v = np.eye(dim) if covariance is None else 0.5 * (np.asarray(covariance, float) + np.asarray(covariance, float).T)
    p = np.linalg.pinv(v + ridge * np.eye(dim), hermitian=True)
    parts = [F.get(delta, F.lit(j)) for j in range(dim)]
    return F.array(*[sum((F.lit(float(p[i, j])) * parts[j] for j in range(1, dim)), F.lit(float(p[i, 0])) * parts[0]) for i in range(dim)])


def simplex_witness(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, reference: Sequence[float], mode: str = "raw", covariance=None,
    ridge: float = 1e-6, window: int = 64, every: int = 1, tolerance: float = 1e-12, rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """Score each simplex row with an effect learned from the rows before it; adds ``score``.

    ``raw`` takes the coordinates whose trailing mean exceeds the reference; ``variance`` maps the
    whitened mean difference affinely into [0, 1]. Refits happen every ``every`` rows.
    """
    from statewatch.functions.bets import effect_from_direction
    from statewatch.operators.shaping import require_simplex

    dim = len(reference)
    ref = vector(reference)
    placed = _trailing(df.withColumn("_x", require_simplex(vec)), key, order, "_x", dim, window, every, rows_per_block, longest)
    delta = F.zip_with("_m", ref, lambda a, b: a - b)
    rows = placed.rows().withColumn("_delta", delta)
    if mode == "raw":
        effect = F.transform("_delta", lambda d: (d > tolerance).cast("double"))
    elif mode == "variance":
        rows = rows.withColumn("_w", _direction(F.col("_delta"), dim, covariance, ridge))
        effect = effect_from_direction("_w", tolerance)
    else:
        raise ValueError("mode must be 'raw' or 'variance'")
    rows = rows.withColumn("_e", effect)
    score = F.aggregate(F.zip_with("_e", F.zip_with("_x", ref, lambda a, b: a - b), lambda e, d: e * d), F.lit(0.0), lambda s, v: s + v)
    bounded = F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return rows.withColumn("score", bounded).drop("_x", "_m", "_delta", "_w", "_e")


def box_witness(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, reference: Sequence[float], lower: Sequence[float], upper: Sequence[float],
    mode: str = "raw", covariance=None, ridge: float = 1e-6, window: int = 64, every: int = 1, tolerance: float = 1e-12,
    rows_per_block: int | None = None, longest: int | None = None,
) -> DataFrame:
    """``simplex_witness`` for box-bounded rows: the direction is divided by ``sum |w| (upper - lower)``."""
    from statewatch.operators.shaping import require_box

    dim = len(reference)
    if any(u <= a for a, u in zip(lower, upper, strict=True)) or any(not a <= r <= u for a, r, u in zip(lower, reference, upper, strict=True)):
        raise ValueError("bounds must be ordered and contain the reference")
    ref, spans = vector(reference), vector([u - a for a, u in zip(lower, upper, strict=True)])
    boxed = df.withColumn("_x", require_box(vec, vector(lower), vector(upper)))
    placed = _trailing(boxed, key, order, "_x", dim, window, every, rows_per_block, longest)
    rows = placed.rows().withColumn("_delta", F.zip_with("_m", ref, lambda a, b: a - b))
    if mode not in ("raw", "variance"):
        raise ValueError("mode must be 'raw' or 'variance'")
    rows = rows.withColumn("_w", F.col("_delta") if mode == "raw" else _direction(F.col("_delta"), dim, covariance, ridge))
    score = F.when(F.col("_m").isNull(), F.lit(0.0)).otherwise(_box_score("_w", "_x", ref, spans, tolerance))
    return rows.withColumn("score", score).drop("_x", "_m", "_delta", "_w")


def _box_score(w: str, x: str, ref: Column, spans: Column, tolerance: float) -> Column:
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    bound = add(F.zip_with(w, spans, lambda a, b: F.abs(a) * b))
    raw = add(F.zip_with(w, F.zip_with(x, ref, lambda a, b: a - b), lambda a, b: a * b))
    return F.when(bound <= tolerance, F.lit(0.0)).otherwise(F.least(F.greatest(raw / bound, F.lit(-1.0)), F.lit(1.0)))


def static_simplex_score(vec: str, reference: Sequence[float], effect: Sequence[float]) -> Column:
    """Fixed effect on a simplex row: ``effect . (x - reference)``."""
    from statewatch.operators.shaping import require_simplex

    if any(not 0 <= e <= 1 for e in effect):
        raise ValueError("effect entries must lie in [0, 1]")
    gaps = F.zip_with(require_simplex(vec), vector(reference), lambda a, b: a - b)
    return F.aggregate(F.zip_with(vector(effect), gaps, lambda e, d: e * d), F.lit(0.0), lambda s, v: s + v)


def static_box_score(vec: str, reference: Sequence[float], direction: Sequence[float], lower: Sequence[float], upper: Sequence[float]) -> Column:
    """Fixed direction on a box row, normalised to [-1, 1]; a zero direction scores 0."""
    from statewatch.operators.shaping import is_box

    bound = sum(abs(w) * (u - a) for w, a, u in zip(direction, lower, upper, strict=True))
    x = require(is_box(vec, vector(lower), vector(upper)), doubles(vec), "feature lies outside its bounds")
    unit = [w / bound if bound else 0.0 for w in direction]
    gaps = F.zip_with(x, vector(reference), lambda a, b: a - b)
    return F.aggregate(F.zip_with(vector(unit), gaps, lambda e, d: e * d), F.lit(0.0), lambda s, v: s + v)


