"""Additive matrix states: mergeable sums of weighted projectors, one packed row per group.

A state row is ``(key..., n, mass, acc)``: rows seen, total weight, and the row-major d x d sum
``sum w x x' / |x|^2``. Merging, removal and decay act on these sums, the density is
``acc / mass``. The matrix is bounded by the dimension, never by the data.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.functions.arrays import col, doubles, let, scaled, total
from statewatch.plans import place, require
from statewatch.plans.durable import model_table
from statewatch.plans.guards import null_safe
from statewatch.plans.rowmap import add_columns

SQL_DIM = 8
BUFFERED_CELLS = 4_000_000


def _entries(dim: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dim) for j in range(i, dim)]


def _mirror(upper: Column, dim: int) -> Column:
    """Full row-major matrix from the packed upper triangle."""
    spots = F.sequence(F.lit(0), F.lit(dim - 1))

    def cell(u: Column, i: Column, j: Column) -> Column:
        low, high = F.least(i, j), F.greatest(i, j)
        return F.get(u, (low * dim - F.shiftright(low * (low - 1), 1) + high - low).cast("int"))

    return let(upper, lambda u: F.flatten(F.transform(spots, lambda i: F.transform(spots, lambda j: cell(u, i, j)))))


def additive_state(
    df: DataFrame, key: Sequence[str], vec: str, dim: int, weight: Column | str | None = None, normalize: bool = True
) -> DataFrame:
    """Weighted sum of projectors of unit-normalised rows per ``key``.

    Up to ``SQL_DIM`` dimensions each matrix entry is an ordinary sum inside one code-generated
    aggregation. Beyond, a task reduces each Arrow batch with one matrix product and buffers one
    triangle per key, so only triangles reach the shuffle. ``normalize=False`` keeps the raw
    outer products (moments).
    """
    if dim < 1:
        raise ValueError("dim must be positive")
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    good = ~F.isnan(w) & (w > 0) & (w < float("inf"))
    rows = df.select(*key, require(good, w, "weights must be finite and positive").alias("_w"), doubles(vec).alias("_x"))
    rows = rows.withColumn("_x", require(F.size("_x") == dim, F.col("_x"), f"vectors must have {dim} entries"))
    if normalize:
        square = total(F.transform("_x", lambda a: a * a))
        unit = F.col("_w") / square
        rows = rows.withColumn("_u", require(square > 1e-30, unit, "a zero vector has no state"))
    else:
        rows = rows.withColumn("_u", F.col("_w"))
    if dim <= SQL_DIM:
        flat = rows.select(*key, "_w", "_u", *[F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(dim)])
        sums = [
            F.sum(F.col("_u") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in _entries(dim)
        ]
        found = flat.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("mass"), *sums)
        upper = F.array(*[F.col(f"_s{i}_{j}") for i, j in _entries(dim)])
        return found.where("n > 0").select(*key, "n", "mass", _mirror(upper, dim).alias("acc"))
    return _finish(_partial_grams(rows.select(*key, "_w", "_u", "_x"), list(key), dim), list(key), dim)


def _partial_grams(rows: DataFrame, key: list[str], dim: int) -> DataFrame:
    """Per task and key: count, mass and triangle, from one matrix product per batch and key."""
    upper = np.triu_indices(dim)
    width = len(upper[0]) + 2
    fields = [rows.schema[k] for k in key] + [T.StructField("_p", T.ArrayType(T.DoubleType()))]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            keys = list(sums)
            flat = np.concatenate([sums[k] for k in keys])
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * width
            arrays = [pa.array([k[i] for k in keys], type=types[i]) for i in range(len(key))]
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*key, "_p"])

        types: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(i).type for i in range(len(key))]
            x = batch.column(len(key) + 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            w = batch.column(len(key)).to_numpy(zero_copy_only=False)
            u = batch.column(len(key) + 1).to_numpy(zero_copy_only=False)
            if key:
                names = list(zip(*[batch.column(i).to_pylist() for i in range(len(key))], strict=True))
                codes = {name: k for k, name in enumerate(dict.fromkeys(names))}
                which = np.fromiter((codes[name] for name in names), dtype=np.int64, count=len(names))
            else:
                codes, which = {(): 0}, np.zeros(len(w), dtype=np.int64)
            order = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[order], np.arange(len(codes) + 1))
            for name, k in codes.items():
                pick = order[edges[k] : edges[k + 1]]
                block = x[pick]
                gram = (block * u[pick, None]).T @ block
                row = np.concatenate([[len(pick), w[pick].sum()], gram[upper]])
                sums[name] = sums[name] + row if name in sums else row
            if len(sums) * width > BUFFERED_CELLS:
                yield flush()
        if sums:
            yield flush()

    return rows.mapInArrow(reduce, T.StructType(fields))


def _finish(partials: DataFrame, key: list[str], dim: int) -> DataFrame:
    """Sum partial triangles entry by entry (map-side combine), then pack one row per key."""
    cells = partials.select(*key, F.posexplode("_p").alias("_i", "_v"))
    summed = cells.groupBy(*key, "_i").agg(F.sum("_v").alias("_v"))
    packed = summed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
    values = F.transform("_c", lambda c: c["_v"])
    packed = packed.where(F.size("_c") > 0).select(*key, values.alias("_t"))
    upper = F.slice("_t", 3, len(_entries(dim)))
    return packed.select(
        *key,
        F.get("_t", F.lit(0)).cast("bigint").alias("n"),
        F.get("_t", F.lit(1)).alias("mass"),
        _mirror(upper, dim).alias("acc"),
    )


def state_of_matrices(df: DataFrame, key: Sequence[str], rho: str, dim: int, weight: Column | str | None = None) -> DataFrame:
    """Additive state of rows that already are d x d positive matrices (flat), normalised to trace one."""
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    trace = sum(F.get(rho, F.lit(i * dim + i)) for i in range(dim))
    rows = df.select(*key, w.alias("_w"), scaled(rho, w / trace).alias("_m"))
    cells = rows.select(*key, F.posexplode(F.concat(F.array(F.lit(1.0), F.col("_w")), F.col("_m"))).alias("_i", "_v"))
    return _pack(cells, list(key))


def _pack(cells: DataFrame, key: list[str]) -> DataFrame:
    summed = cells.groupBy(*key, "_i").agg(F.sum("_v").alias("_v"))
    packed = summed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
    packed = packed.where(F.size("_c") > 0).select(*key, F.transform("_c", lambda c: c["_v"]).alias("_t"))
    return packed.select(
        *key,
        F.get("_t", F.lit(0)).cast("bigint").alias("n"),
        F.get("_t", F.lit(1)).alias("mass"),
        F.slice("_t", 3, F.size("_t")).alias("acc"),
    )


def merge_states(key: Sequence[str], *states: DataFrame) -> DataFrame:
    """Element-wise sum of states with equal dimension."""
    everything = functools.reduce(DataFrame.unionByName, [s.select(*key, "n", "mass", "acc") for s in states])
    head = F.array(F.col("n").cast("double"), F.col("mass"))
    size = everything.groupBy(*key).agg(F.count_distinct(F.size("acc")).alias("_d"))
    cells = everything.select(*key, F.posexplode(F.concat(head, F.col("acc"))).alias("_i", "_v"))
    merged = null_safe(_pack(cells, list(key)), size, list(key))
    checked = require(F.col("_d") == 1, F.col("acc"), "only states of equal dimension can be merged")
    return merged.select(*key, "n", "mass", checked.alias("acc"))


def remove_from_state(state: DataFrame, removed: DataFrame, key: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """Subtract one state from another; too much mass or a lost positivity fails the query."""
    right = removed.select(*key, F.col("n").alias("_n"), F.col("mass").alias("_m"), F.col("acc").alias("_a"))
    joined = null_safe(state, right, list(key), "left")
    left = F.col("mass") - F.coalesce("_m", F.lit(0.0))
    zeros = F.transform("acc", lambda x: F.lit(0.0))
    rest = F.zip_with("acc", F.coalesce(F.col("_a"), zeros), lambda a, b: a - b)
    empty = left <= tolerance
    positive = min_eigenvalue(rest) >= -tolerance * F.greatest(F.lit(1.0), left)
    kept = require(left >= -tolerance, F.when(empty, zeros).otherwise(rest), "cannot remove more mass than is stored")
    # samples seen is a history counter: removal does not lower it
    return joined.select(
        *key,
        "n",
        F.when(empty, F.lit(0.0)).otherwise(left).alias("mass"),
        require(empty | positive, kept, "removal would make the state nonpositive").alias("acc"),
    )


def min_eigenvalue(rho: Column) -> Column:
    """Smallest eigenvalue of a flat symmetric matrix."""

    @F.pandas_udf("double")
    def smallest(rows: pd.Series) -> pd.Series:
        return rows.map(lambda m: float(np.linalg.eigvalsh(_square(m))[0]))

    return smallest(rho)


def _square(flat) -> np.ndarray:
    a = np.asarray(flat, dtype=float)
    d = int(round(len(a) ** 0.5))
    a = a.reshape(d, d)
    return 0.5 * (a + a.T)


def density(acc: Column | str = "acc", mass: Column | str = "mass") -> Column:
    m = col(mass)
    return require(m > 0, scaled(acc, F.lit(1.0) / m), "an empty state has no density")


def entries(df: DataFrame, key: Sequence[str], flat: str, dim: int) -> DataFrame:
    """Long form ``(key, i, j, value)`` of a flat matrix column."""
    long = df.select(*key, F.posexplode(flat).alias("_k", "value"))
    return long.select(*key, F.floor(F.col("_k") / dim).cast("int").alias("i"), (F.col("_k") % dim).alias("j"), "value")


def decayed_state(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, dim: int, factor: float
) -> DataFrame:
    """State after multiplying by ``factor`` before each new row: weights ``factor ** (T - t)``.

    Weights that underflow to zero carry no mass and are left out of the sum.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor must lie in (0, 1]")
    placed = place(df, key, order, "_t").rows()
    size = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    joined = null_safe(placed, size, list(key))
    aged = joined.withColumn("_age", F.pow(F.lit(float(factor)), F.col("_n") - F.col("_t")))
    return additive_state(aged.where("_age > 0"), key, vec, dim, "_age").drop("n")


def class_densities(df: DataFrame, label: str, vec: str, dim: int, priors: str | dict = "empirical") -> DataFrame:
    """One density per class with its prior: ``empirical``, ``balanced`` or explicit weights."""
    states = additive_state(df, [label], vec, dim)
    if isinstance(priors, str):
        name = priors.lower()
        if name == "empirical":
            prior = F.col("n") / F.col("_all")
        elif name == "balanced":
            prior = F.lit(1.0) / F.col("_classes")
        else:
            raise ValueError("priors must be 'empirical', 'balanced' or a mapping")
    else:
        if any(not 0 < p < float("inf") for p in priors.values()):
            raise ValueError("explicit priors must be finite and positive")
        raw = F.create_map(*[F.lit(x) for pair in priors.items() for x in pair])[F.col(label)]
        prior = raw / sum(priors.values())
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    joined = states.crossJoin(F.broadcast(totals))  # one row; the matrices stay where they are
    return joined.select(label, "n", prior.alias("prior"), density().alias("rho"))


def sliding_state(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, dim: int, n: int, weight: Column | None = None
) -> DataFrame:
    """State of the last ``n`` rows at every row (shorter at the start) with a ``full`` flag."""
    if n < 1:
        raise ValueError("n must be positive")
    w = F.lit(1.0) if weight is None else weight
    square = total(F.transform(doubles(vec), lambda a: a * a))
    placed = place(df.withColumn("_u", w / square).withColumn("_w", w), key, order)

    def build(window):
        frame = window.rowsBetween(-(n - 1), 0)
        x = [F.get(doubles(vec), F.lit(i)) for i in range(dim)]
        sums = [F.sum(F.col("_u") * x[i] * x[j]).over(frame) for i, j in _entries(dim)]
        return {
            "mass": F.sum("_w").over(frame),
            "full": F.count(F.lit(1)).over(frame) == n,
            "_upper": F.array(*sums),
        }

    out = placed.look_back(n - 1, build).rows()
    return out.withColumn("acc", _mirror(F.col("_upper"), dim)).drop("_upper", "_u", "_w")


def check_density(df: DataFrame, key: Sequence[str], rho: str, tolerance: float = 1e-10) -> DataFrame:
    """Trace, asymmetry, smallest eigenvalue and the verdict for each flat matrix."""

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for flat in pdf[rho]:
            a = np.asarray(flat, dtype=float)
            d = int(round(len(a) ** 0.5))
            a = a.reshape(d, d)
            h = 0.5 * (a + a.T)
            scale = max(1.0, float(np.linalg.norm(h)))
            gap, low, trace = float(np.linalg.norm(a - a.T)), float(np.linalg.eigvalsh(h)[0]), float(np.trace(h))
            good = gap <= tolerance * scale and low >= -tolerance * scale and np.isfinite(trace) and trace > tolerance
            out.append((trace, gap, low, bool(good)))
        return pd.DataFrame(out, columns=["trace", "asymmetry", "smallest", "valid"])

    fields = "trace double, asymmetry double, smallest double, valid boolean"
    return add_columns(df.select(*key, rho), fields, report).drop(rho)


def twirl(df: DataFrame, rho: str, group: Sequence[np.ndarray]) -> DataFrame:
    """Mean of ``U rho U'`` over a finite group of orthogonal matrices."""
    mats = [np.asarray(u, dtype=float) for u in group]
    for u in mats:
        if not np.allclose(u @ u.T, np.eye(len(u)), atol=1e-9):
            raise ValueError("every group element must be orthogonal")
    stack = np.stack(mats)

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = lambda m: np.mean(stack @ _square(m) @ stack.transpose(0, 2, 1), axis=0).reshape(-1)
        return pd.DataFrame({rho: [mean(m) for m in pdf[rho]]})

    return add_columns(df, f"{rho} array<double>", average)


def permutation_twirl(df: DataFrame, rho: str, perms: Sequence[Sequence[int]]) -> DataFrame:
    """``twirl`` for permutations: entry (i, j) averages its images. Row-local, no matrix product."""
    d = len(perms[0])
    inverse = []
    for p in perms:
        if sorted(p) != list(range(d)):
            raise ValueError("every group element must be a permutation")
        back = [0] * d
        for src, dst in enumerate(p):
            back[dst] = src
        inverse.append(back)
    sources = F.array(
        *[F.array(*[F.lit(b[i] * d + b[j]) for b in inverse]) for i in range(d) for j in range(d)]
    )
    def averaged(m: Column) -> Column:
        return F.transform(sources, lambda s: total(F.transform(s, lambda k: F.get(m, k))) / len(perms))

    return df.withColumn(rho, let(col(rho), averaged))


def cyclic_twirl(df: DataFrame, rho: str, dim: int) -> DataFrame:
    """Average over all cyclic shifts, that is along the circular diagonals ``(i - j) mod d``."""
    offsets = F.sequence(F.lit(0), F.lit(dim - 1))

    def diagonals(m: Column) -> Column:
        along = lambda o: F.transform(offsets, lambda j: F.get(m, F.pmod(j + o, F.lit(dim)) * dim + j))
        return F.transform(offsets, lambda o: total(along(o)) / dim)

    def spread(d: Column) -> Column:
        row = lambda i: F.transform(offsets, lambda j: F.get(d, F.pmod(i - j, F.lit(dim))))
        return F.flatten(F.transform(offsets, row))

    return df.withColumn(rho, let(let(col(rho), diagonals), spread))


def moments(df: DataFrame, key: Sequence[str], vec: str, dim: int) -> DataFrame:
    """Count, mean and sample covariance (n - 1) per key.

    Rows are first shifted by a value of their key near the mean (the mean of its rows, from a first pass over the column sums), so the sums
    of products do not cancel where the mean is large against the spread.
    """
    rows = df.select(*key, doubles(vec).alias("_x"))
    rows = rows.withColumn("_x", require(F.size("_x") == dim, F.col("_x"), f"vectors must have {dim} entries"))
    first = rows.groupBy(*key).agg(*[F.avg(F.get("_x", F.lit(i))).alias(f"_m{i}") for i in range(dim)])
    shift = model_table(first.select(*key, F.array(*[f"_m{i}" for i in range(dim)]).alias("_m")))
    centred = null_safe(rows, shift, list(key)).select(*key, F.zip_with("_x", "_m", lambda x, m: x - m).alias("_x"))
    lifted = centred.select(*key, F.concat("_x", F.array(F.lit(1.0))).alias("_x"))
    sums = additive_state(lifted, key, "_x", dim + 1, normalize=False)
    spots = F.sequence(F.lit(0), F.lit(dim - 1))
    sums = sums.select(*key, "n", "acc", F.slice("acc", dim * (dim + 1) + 1, dim).alias("_s"))

    def covariance(e: Column) -> Column:
        def cell(i: Column, j: Column) -> Column:
            second = F.get(e["acc"], i * (dim + 1) + j)
            return (second - F.get(e["s"], i) * F.get(e["s"], j) / e["n"]) / (e["n"] - 1)

        return F.flatten(F.transform(spots, lambda i: F.transform(spots, lambda j: cell(i, j))))

    whole = F.struct(F.col("acc").alias("acc"), F.col("_s").alias("s"), F.col("n").alias("n"))
    found = sums.select(*key, "n", "_s", F.when(F.col("n") > 1, let(whole, covariance)).alias("cov"))
    joined = null_safe(found, shift, list(key))
    mean = let(F.col("n"), lambda n: F.zip_with("_m", "_s", lambda m, s: m + s / n))
    return joined.select(*key, "n", mean.alias("mean"), "cov")


def pooled_covariance(moment_rows: DataFrame) -> DataFrame:
    """``sum (n_c - 1) cov_c / (N - C)`` over the rows of ``moments``: one flat matrix."""
    cells = moment_rows.where("n > 1").select("n", F.posexplode("cov").alias("_i", "_v"))
    summed = cells.groupBy("_i").agg(
        (F.sum((F.col("n") - 1) * F.col("_v")) / F.sum(F.col("n") - 1)).alias("_v")
    )
    packed = summed.agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
    return packed.select(F.transform("_c", lambda c: c["_v"]).alias("cov"))


def ledoit_wolf(df: DataFrame, key: Sequence[str], vec: str, dim: int) -> DataFrame:
    """Shrinkage covariance and precision of residuals around the mean of each ``key``.

    With S = X'X / n the optimal weight needs only trace S, |S|^2 and the mean of |x|^4. The last is a corner of the products once |x|^2 stands
    beside x, so the data are read twice: once for the means, once for the sums.
    """
    rows = df.select(*key, doubles(vec).alias("_v"))
    rows = rows.withColumn("_v", require(F.size("_v") == dim, F.col("_v"), f"vectors must have {dim} entries"))
    means = rows.groupBy(*key).agg(*[F.avg(F.get("_v", F.lit(i))).alias(f"_m{i}") for i in range(dim)])
    means = means.select(*key, F.array(*[f"_m{i}" for i in range(dim)]).alias("_m"))
    residual = null_safe(rows, means, list(key)).select(F.zip_with("_v", "_m", lambda a, b: a - b).alias("_x"))
    lifted = residual.select(let(F.col("_x"), lambda x: F.concat(x, F.array(total(F.transform(x, lambda a: a * a))))).alias("_x"))
    scatter = additive_state(lifted, [], "_x", dim + 1, normalize=False)

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for count, flat in zip(pdf["n"], pdf["acc"], strict=True):
                whole = _square(flat)
                s, quartic = whole[:-1, :-1] / count, whole[-1, -1]
                p = len(s)
                mu = np.trace(s) / p
                delta = float((s * s).sum() - p * mu * mu) / p
                beta = (quartic / count - float((s * s).sum())) / (p * count)
                rate = 0.0 if delta <= 0 else min(max(beta, 0.0), delta) / delta
                cov = (1 - rate) * s + rate * mu * np.eye(p)
                inverse = np.linalg.pinv(cov, hermitian=True)
                out.append((count, rate, cov.reshape(-1), (0.5 * (inverse + inverse.T)).reshape(-1)))
            yield pd.DataFrame(out, columns=["n", "shrinkage", "cov", "precision"])

    return scatter.select("n", "acc").mapInPandas(shrink, "n bigint, shrinkage double, cov array<double>, precision array<double>")


def mmd2(df: DataFrame, label: str, vec: str, dim: int, first, second) -> DataFrame:
    """Biased squared MMD for the kernel ``<x, z>^2``: the squared distance of the two densities."""
    states = additive_state(df.where(F.col(label).isin(first, second)), [label], vec, dim)
    one = states.agg(
        F.any_value(F.when(F.col(label) == first, density()), ignoreNulls=True).alias("a"),
        F.any_value(F.when(F.col(label) == second, density()), ignoreNulls=True).alias("b"),
    )
    return one.select(total(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))).alias("mmd2"))
