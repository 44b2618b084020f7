"""Resampling with replacement where the rows are.

A resample of n rows is one multinomial draw of n counts. It is drawn from the top: the rows of a key are cut into ranges, a range's total in every
replicate follows from a walk down a binary tree of binomial draws, each seeded by its node, and the counts inside a range are one more
multinomial draw. So any task finds the counts of its range, and the draws before it, without the other ranges; each replicate draws
exactly n rows, and nothing that grows with replicates times rows is exchanged.

Draws that are given as a table of indices do have to move to the rows they name. They go there packed, by ranges of the index, and the work
on a range is done in its task (``over_draws``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.plans.guards import null_safe
from statewatch.plans.ordering import Group, arrays, each_key, frame, shuffle_tasks

#: Counts that a task holds at once: replicates times the rows of a range.
HELD = 1_000_000
#: Indices of a range that given draws go to, at most 65,536, and draws that a task packs at once.
DRAW_SPAN, PACKED = 16_384, 2_000_000


def range_rows(replicates: int) -> int:
    """Rows of a range, so that its counts in all replicates stay within ``HELD``."""
    return max(16, min(8192, HELD // replicates))


def range_totals(n: int, span: int, at: int, replicates: int, seed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(total, before)``: in each replicate the draws that fall into range ``at``, and into the ranges before it."""
    low, high = 0, -(-n // span)
    total, before = np.full(replicates, n, np.int64), np.zeros(replicates, np.int64)

    def rows(a: int, b: int) -> int:
        return min(n, b * span) - a * span

    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(total, rows(low, middle) / rows(low, high))
        if at < middle:
            total, high = left, middle
        else:
            total, before, low = total - left, before + left, middle
    return total, before


def range_copies(n: int, span: int, at: int, replicates: int, seed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(copies, before)``: how often each replicate draws each row of the range, as replicates x rows, and the draws of the ranges before."""
    total, before = range_totals(n, span, at, replicates, seed)
    size = min(n, (at + 1) * span) - at * span
    return np.random.default_rng([*seed, at]).multinomial(total, np.full(size, 1.0 / size)), before


def over_ranges(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], replicates: int, seed: int, schema: str, fn: Callable[[Group, np.ndarray, np.ndarray], Group],
    span: int | None = None,
) -> DataFrame:
    """``fn(rows, copies, before)`` for each range of each key. ``df`` has ``index`` 0, 1, ... inside each key; rows move once, to their range.

    The output has the key's columns, as far as ``fn`` returns them (``rows`` has them), and ``schema``.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    key, span = list(key), span or range_rows(replicates)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rows = null_safe(df.select(*dict.fromkeys([*key, "index", *columns])), sizes, key)
    named = F.xxhash64(F.lit(seed), *key).bitwiseAND(0x7FFFFFFFFFFFFFFF)
    rows = rows.withColumns({"_range": F.floor(F.col("index") / span).cast("bigint"), "_seed": named})

    def run(g: Group) -> Group:
        n, at = int(g["_n"][0]), int(g["_range"][0])
        copies, before = range_copies(n, span, at, replicates, [seed, int(g["_seed"][0])])
        if len(g["index"]) != copies.shape[1] or (np.asarray(g["index"], np.int64) != at * span + np.arange(copies.shape[1])).any():
            raise ValueError("rows must be numbered 0, 1, ... inside each key")
        return fn(g, copies, before)

    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return each_key(rows, [*key, "_range"], "index", "".join(f"`{k}` {fields[k]}, " for k in key) + schema, run)


def replicate_sums(df: DataFrame, key: Sequence[str], values: Sequence[str], replicates: int, seed: int = 0, span: int | None = None) -> DataFrame:
    """``(key, replicate, copies, values...)``: sums of the values over the drawn rows of each replicate. NULL values count as missing."""
    key, values = list(key), list(values)

    def run(g: Group, copies: np.ndarray, before: np.ndarray) -> Group:
        v = np.stack([np.asarray(g[c], float) for c in values], axis=1)
        sums = copies @ np.nan_to_num(v)
        return {**{k: g[k][:1] for k in key}, "_copies": [copies.sum(axis=1)], **{f"_v{i}": [sums[:, i]] for i in range(len(values))}}

    schema = "_copies array<bigint>, " + ", ".join(f"_v{i} array<double>" for i in range(len(values)))
    found = over_ranges(df, key, values, replicates, seed, schema, run, span)
    each = found.select(*key, F.posexplode(F.arrays_zip("_copies", *[f"_v{i}" for i in range(len(values))])).alias("replicate", "_r"))
    sums = [F.sum(f"_r._v{i}").alias(c) for i, c in enumerate(values)]
    return each.groupBy(*key, F.col("replicate").cast("bigint").alias("replicate")).agg(F.sum("_r._copies").alias("copies"), *sums)


def row_copies(df: DataFrame, columns: Sequence[str], replicates: int, seed: int = 0, chosen: str = "chosen", span: int | None = None) -> DataFrame:
    """``(index, columns..., copies)`` of the rows marked ``chosen``: how often each replicate drew them, as an array over replicates."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = ["index", *columns]

    def run(g: Group, copies: np.ndarray, before: np.ndarray) -> Group:
        mine = np.asarray(g[chosen], bool)
        return {**{c: g[c][mine] for c in names}, "copies": list(copies.T[mine])}

    schema = ", ".join(f"`{c}` {fields[c]}" for c in names) + ", copies array<bigint>"
    return over_ranges(df, [], [*columns, chosen], replicates, seed, schema, run, span)


def _small(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | int, int]:
    """``(codes, names, number)``: small codes of integers; ``names`` gives them back, as a table or as the value of code 0."""
    low, high = int(values.min()), int(values.max())
    if high - low < 1 << 20:
        return values - low, low, high - low + 1
    names, codes = np.unique(values, return_inverse=True)
    return codes, names, len(names)


def _named(codes: np.ndarray, names: np.ndarray | int) -> np.ndarray:
    return codes + names if isinstance(names, int) else names[codes]


def packed_draws(indices: DataFrame, own: Sequence[str], span: int) -> DataFrame:
    """``(own..., _range, _r, _o, _c)``: the draws of a range as bytes, replicate, offset in the range, and copies. Equal draws of a task merge."""
    own = list(own)
    fields = T.StructType([*[indices.schema[k] for k in own], T.StructField("_range", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("_r", "_o", "_c")]])

    def pack(table: pa.Table) -> pa.RecordBatch:
        who = np.zeros(len(table), np.int64)
        for k in own:
            coded = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            who = who * len(coded.dictionary) + coded.indices.to_numpy()
            who = np.unique(who, return_inverse=True)[1] if len(own) > 1 else who
        index = table["index"].to_numpy()
        ranges, range_names, n_ranges = _small(index // span)
        groups, first, group = np.unique(who * n_ranges + ranges, return_index=True, return_inverse=True)
        replicates, names, n = _small(table["replicate"].to_numpy())
        codes, copies = np.unique((group * n + replicates) * span + index % span, return_counts=True)
        offsets, rest = (codes % span).astype(np.uint16), codes // span
        replicates = _named(rest % n, names).astype(np.int64)
        cuts = [*np.searchsorted(rest // n, np.arange(len(groups))), len(codes)]
        heads = [table[k].combine_chunks().take(pa.array(first)) for k in own]
        split = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        columns = [*heads, pa.array(_named(groups % n_ranges, range_names).astype(np.int64)), split(replicates), split(offsets), split(copies.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=fields.fieldNames())

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch] if batch.num_rows else held, n + batch.num_rows
            if n >= PACKED:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))

    given = indices.select(*own, F.col("replicate").cast("bigint").alias("replicate"), F.col("index").cast("bigint").alias("index"))
    return given.where("index IS NOT NULL AND replicate IS NOT NULL").mapInArrow(run, fields)


def over_draws(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], indices: DataFrame, schema: str, fn: Callable[[Group, np.ndarray, np.ndarray, np.ndarray], Group],
    span: int | None = None,
) -> DataFrame:
    """``fn(rows, replicates, offsets, copies)`` for each range of the index in each key: its rows (``_o`` is their offset) and all draws from it.

    ``indices`` has ``(replicate, index)`` and those columns of ``key`` that have draws of their own; a draw without a row finds nothing. The
    output has the key's columns and ``schema``.
    """
    key, span = list(key), span or DRAW_SPAN
    own = [k for k in key if k in indices.columns]
    rest = [k for k in key if k not in own]
    at = F.col("index").cast("bigint")
    rows = df.where("index IS NOT NULL").select(*key, *columns, F.floor(at / span).cast("bigint").alias("_range"), F.pmod(at, F.lit(span)).alias("_o"))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = T._parse_datatype_string("".join(f"`{k}` {fields[k]}, " for k in key) + schema)

    def run(mine: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(draws):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in out.fields})
        r, o, c = (np.concatenate([np.frombuffer(x, t) for x in draws[n]]) for n, t in (("_r", np.int64), ("_o", np.uint16), ("_c", np.int32)))
        parts = [g for _, g in mine.groupby(rest, dropna=False, sort=False)] if rest else [mine]
        found = []
        for part in parts:
            made = fn(arrays(part), r, o.astype(np.int64), c.astype(np.int64))
            size = len(next(iter(made.values())))
            found.append({**{k: np.repeat(part[k].to_numpy()[:1], size) for k in key}, **made})
        return frame(found)[out.fieldNames()]

    by = [*own, "_range"]
    tasks = shuffle_tasks(df)
    left = rows.repartition(tasks, *by).groupBy(*by)
    right = packed_draws(indices, own, span).repartition(tasks, *by).groupBy(*by)
    return left.cogroup(right).applyInPandas(run, out)


def drawn_sums(df: DataFrame, key: Sequence[str], values: Sequence[str], indices: DataFrame, span: int | None = None) -> DataFrame:
    """``(key, replicate, copies, values...)``: ``replicate_sums`` of draws that are given as indices; a sum without any value is NULL."""
    key, values, size = list(key), list(values), span or DRAW_SPAN
    rows = df.select(*key, "index", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, v in enumerate(values)],
                     *[F.col(v).isNotNull().cast("double").alias(f"_n{i}") for i, v in enumerate(values)])
    columns = [f"_{x}{i}" for x in "vn" for i in range(len(values))]

    def run(g: Group, r: np.ndarray, o: np.ndarray, c: np.ndarray) -> Group:
        replicates, spot = np.unique(r, return_inverse=True)
        rows_at = np.bincount(g["_o"], minlength=size)
        sums = {"replicate": replicates, "copies": np.bincount(spot, rows_at[o] * c).astype(np.int64)}
        for name in columns:
            at = np.bincount(g["_o"], np.asarray(g[name], float), size)
            sums[name] = np.bincount(spot, at[o] * c)
        return sums

    found = over_draws(rows, key, columns, indices, "replicate bigint, copies bigint, " + ", ".join(f"{c} double" for c in columns), run, size)
    sums = found.where("copies > 0").groupBy(*key, "replicate").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in columns])
    return sums.select(*key, "replicate", "copies", *[F.when(F.col(f"_n{i}") > 0, F.col(f"_v{i}")).alias(v) for i, v in enumerate(values)])
