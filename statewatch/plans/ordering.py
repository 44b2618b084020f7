"""Ordered work inside a key that stays balanced when one key holds most of the rows.

``place`` numbers the rows of every key. When a count shows that each key fits one task, this
is one window and everything after it reuses the same shuffle and sort. When a key is larger,
rows are range-partitioned on (key, order), so the hot key is spread over many tasks; positions
come from per-chunk counts and a running offset, and from then on the key is cut into blocks of
``rows_per_block`` consecutive rows. Every later step works on (key, block) groups and joins a
small carry per block. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.plans.durable import durable
from statewatch.plans.guards import null_safe

ROWS_PER_BLOCK = 96_000


def block_rows(rows_per_block: int | None, multiple: int) -> int:
    """A block size near ``rows_per_block`` that ``multiple`` divides."""
    size = rows_per_block or ROWS_PER_BLOCK
    return max(multiple, size - size % multiple)


def longest_group(df: DataFrame, key: Sequence[str]) -> int:
    """Rows of the largest key: a partial count per key and a maximum."""
    if not key:
        return df.count()
    row = df.groupBy(*key).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


Group = dict[str, np.ndarray]


def arrays(pdf: pd.DataFrame) -> Group:
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def frame(groups: Sequence[Group]) -> pd.DataFrame:
    """One data frame from the column dictionaries of many groups."""

    def column(c: str):
        parts = [g[c] for g in groups]
        if all(isinstance(x, np.ndarray) and x.ndim == 1 and x.dtype != object for x in parts):
            return np.concatenate(parts)
        values = [x for part in parts for x in part]
        return values if values else pd.Series(values, dtype=object)  # a type of numbers would not become arrays

    return pd.DataFrame({c: column(c) for c in groups[0]})


def key_runs(pdf: pd.DataFrame, keys: Sequence[str]) -> list[tuple[tuple, int, int]]:
    """``(key, start, stop)`` of the runs of equal keys in consecutive rows; NULL keys are equal."""
    codes = np.stack([pd.factorize(pdf[k], use_na_sentinel=False)[0] for k in keys], axis=1)
    cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1), len(pdf)]
    heads = pdf[list(keys)].iloc[cuts[:-1]].itertuples(index=False, name=None)
    return [(tuple(None if pd.isna(v) else v for v in head), a, b) for head, a, b in zip(heads, cuts, cuts[1:], strict=False)]


def each_key(
    data: DataFrame, keys: Sequence[str], pos: str, schema: str | T.StructType, fn: Callable[[Group], Group]
) -> DataFrame:
    """``fn`` on the ordered rows of every key, for keys known to fit one block.

    One hash shuffle and one sort; a task then streams Arrow batches and cuts them at key
    changes, which is much cheaper than a grouped call per key when keys are small. The shuffle is
    the one ``place(spread=True)`` made: adaptive coalescing sizes tasks by bytes and would put
    a small but compute-heavy input on one core.
    """
    keys = list(keys)
    ordered = data.repartition(shuffle_tasks(data), *keys).sortWithinPartitions(*keys, pos)

    def whole(parts: list[Group]) -> Group:
        return {c: np.concatenate([g[c] for g in parts]) for c in parts[0]} if len(parts) > 1 else parts[0]

    def run(batches):
        held: list[Group] = []  # of a key that goes on in the next batch; joined once
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            columns = arrays(pdf)
            done: list[Group] = []
            for key, a, b in key_runs(pdf, keys):
                part = {c: v[a:b] for c, v in columns.items()}
                if held and key == last:
                    held.append(part)
                    continue
                if held:
                    done.append(whole(held))
                held, last = [part], key
            if done:
                yield frame([fn(g) for g in done])
        if held:
            yield frame([fn(whole(held))])

    return ordered.mapInPandas(run, schema)


@dataclass(frozen=True)
class Placed:
    df: DataFrame
    key: tuple[str, ...]
    order: tuple
    pos: str
    rows_per_block: int
    longest: int
    blocked: bool

    @property
    def group(self) -> list[str]:
        return [*self.key, "_blk"] if self.blocked else list(self.key)

    def window(self) -> WindowSpec:
        base = Window.partitionBy(*self.group)
        return base.orderBy(self.pos) if self.blocked else base.orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Placed:
        return replace(self, df=df)

    def with_columns(self, columns: dict[str, Column]) -> Placed:
        return self.with_df(self.df.withColumns(columns))

    def rows(self) -> DataFrame:
        return self.df.drop("_blk") if self.blocked else self.df

    def running(self, **parts: tuple[str, Column]) -> Placed:
        """Inclusive running ``sum``, ``min`` or ``max`` over each key."""
        make = {"sum": F.sum, "min": F.min, "max": F.max}
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.blocked:
            return self.with_columns({n: make[k](c).over(frame) for n, (k, c) in parts.items()})
        local = self.df.withColumns({n: make[k](c).over(frame) for n, (k, c) in parts.items()})
        totals = self.df.groupBy(*self.group).agg(*[make[k](c).alias(f"_c_{n}") for n, (k, c) in parts.items()])
        before = Window.partitionBy(*self.key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *self.group, *[make[k](F.col(f"_c_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in parts.items()]
        )
        joined = null_safe(local, carry, self.group)
        joins = {
            "sum": lambda a, b: F.coalesce(a + b, a, b),
            "min": lambda a, b: F.least(a, b),
            "max": lambda a, b: F.greatest(a, b),
        }
        merged = {n: joins[k](F.col(n), F.col(f"_c_{n}")) for n, (k, _) in parts.items()}
        return self.with_df(joined.withColumns(merged).drop(*[f"_c_{n}" for n in parts]))

    def look_back(self, before: int, build: Callable[[WindowSpec], dict[str, Column]]) -> Placed:
        """Add window columns that reach at most ``before`` rows back.

        In blocked mode the ``before`` rows ahead of a block are also sent to it, from as many blocks as they
        span, so a frame never needs a row that another task holds.
        """
        if not self.blocked:
            return self.with_columns(build(self.window()))
        doubled = self._with_halo(before)
        window = Window.partitionBy(*self.key, "_home").orderBy(self.pos)
        out = doubled.withColumns(build(window)).where(F.col("_home") == F.col("_blk"))
        return self.with_df(out.drop("_home"))

    def _with_halo(self, before: int) -> DataFrame:
        """Rows with the blocks (``_home``) that need them: their own, and those that begin at most ``before`` rows later."""
        last = F.floor((F.col(self.pos) - 1 + before) / self.rows_per_block).cast("bigint")
        return self.df.withColumn("_home", F.explode(F.sequence(F.col("_blk"), last)))

    def scan(
        self,
        schema: str,
        columns: Sequence[str],
        apply: Callable[[Group, np.ndarray], Group],
        start: np.ndarray,
        summarize: Callable[[Group], np.ndarray] | None = None,
        combine: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
        before: int = 0,
    ) -> DataFrame:
        """Ordered kernel over each key, parallel inside a key when the state composes.

        ``apply(rows, state)`` returns output rows for consecutive ``rows`` that begin in
        ``state``. For large keys ``summarize(rows)`` reduces a block to a vector and
        ``combine(state, summary)`` moves a state across that block; without them the kernel
        must be determined by the ``before`` rows preceding each block (marked ``_warm``).
        """
        keys = list(self.key)
        data = self.df.select(*dict.fromkeys([*self.group, self.pos, *columns]))
        pos = self.pos

        def run(pdf: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
            return frame([apply(arrays(pdf.sort_values(pos, kind="stable", ignore_index=True)), state)])

        if not keys:
            keys = ["_all"]
            data = data.withColumn("_all", F.lit(0))
        if not self.blocked:
            cold = data.withColumn("_warm", F.lit(False)) if before else data
            return each_key(cold, keys, pos, schema, lambda g: apply(g, start))

        group = [*keys, "_blk"]
        if before:
            halo = self.with_df(data)._with_halo(before)
            halo = halo.withColumn("_warm", F.col("_home") != F.col("_blk"))
            return halo.groupBy(*keys, "_home").applyInPandas(lambda pdf: run(pdf, start), schema)

        key_fields = [data.schema[name] for name in group]
        summary_schema = T.StructType([*key_fields, T.StructField("_s", T.ArrayType(T.DoubleType()))])

        def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
            ordered = pdf.sort_values(pos, kind="stable", ignore_index=True)
            head = ordered.loc[[0], group].reset_index(drop=True)
            head["_s"] = [np.asarray(summarize(arrays(ordered)), dtype=float)]
            return head

        def carry_over(pdf: pd.DataFrame) -> pd.DataFrame:
            ordered = pdf.sort_values("_blk", ignore_index=True)
            state, states = np.asarray(start, dtype=float), []
            for summary in ordered["_s"]:
                states.append(state)
                state = np.asarray(combine(state, np.asarray(summary, dtype=float)), dtype=float)
            ordered["_s"] = states
            return ordered

        summaries = data.groupBy(*group).applyInPandas(reduce_block, summary_schema)
        carries = summaries.groupBy(*keys).applyInPandas(carry_over, summary_schema)

        def finish(rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
            return run(rows, np.asarray(carry["_s"].iloc[0], dtype=float))

        return data.groupBy(*group).cogroup(carries.groupBy(*group)).applyInPandas(finish, schema)

    def fold(
        self,
        schema: str,
        columns: Sequence[str],
        step: Callable[[Group, np.ndarray], tuple[Group, np.ndarray]],
        start: np.ndarray,
        states: DataFrame | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Ordered kernel whose state cannot be composed (online learners).

        One shuffle by key and one sort; a task then streams Arrow batches through ``step`` with only the learner state of the current key in
        memory, so a key may be of any length. Keys run in parallel, a key's rows one after the other. Returns the rows and the final
        state per key, as separate plans: a caller who ignores one does not pay for it. ``states`` (key..., ``_state``) warms the
        keys it lists; a key without rows keeps its state.
        """
        keys = list(self.key) or ["_all"]
        pos = self.pos
        data = self.df if self.key else self.df.withColumn("_all", F.lit(0))
        names = list(dict.fromkeys([*keys, pos, *columns]))
        data = data.select(*names)
        state_schema = T.StructType([*[data.schema[name] for name in keys], T.StructField("_state", T.ArrayType(T.DoubleType()))])
        cold = np.asarray(start, dtype=float)
        rows = data.withColumn("_state", F.lit(None).cast("array<double>"))
        if states is not None:
            if not self.key:
                states = states.withColumn("_all", F.lit(0))
            # positions start at 1, so a warm state comes first
            empty = [F.lit(0).cast(data.schema[n].dataType).alias(n) if n == pos else F.lit(None).cast(data.schema[n].dataType).alias(n) for n in names if n not in keys]
            rows = rows.unionByName(states.select(*keys, *empty, F.col("_state").cast("array<double>").alias("_state")))
        ordered = rows.repartition(shuffle_tasks(data), *keys).sortWithinPartitions(*keys, pos)
        whole = [f.name for f in data.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]

        def walk(batches, want_rows: bool):
            last, state = None, cold
            for pdf in batches:
                if not len(pdf):
                    continue
                done: list[Group] = []
                ended: list[tuple] = []
                for key, a, b in key_runs(pdf, keys):
                    if last != (key,):
                        if last is not None:
                            ended.append((*last[0], state))
                        last, state = (key,), cold
                    part = pdf.iloc[a:b]
                    warm = part["_state"].notna()
                    if warm.any():
                        state = np.asarray(part["_state"][warm].iloc[0], dtype=float)
                        part = part[~warm].astype({n: "int64" for n in whole if n not in keys and not part[~warm][n].isna().any()})
                    if len(part):
                        out, state = step(arrays(part[names]), state)
                        done.append(out)
                if want_rows and done:
                    yield frame(done)
                elif not want_rows and ended:
                    yield pd.DataFrame(ended, columns=[*keys, "_state"])
            if not want_rows and last is not None:
                yield pd.DataFrame([(*last[0], state)], columns=[*keys, "_state"])

        out = ordered.mapInPandas(lambda batches: walk(batches, True), schema)
        ends = ordered.mapInPandas(lambda batches: walk(batches, False), state_schema)
        return out, ends if self.key else ends.drop("_all")


def place(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence,
    pos: str = "t",
    rows_per_block: int | None = None,
    longest: int | None = None,
    spread: bool = False,
) -> Placed:
    """Number rows 1, 2, ... inside ``key`` by ``order`` (a total order) into column ``pos``.

    ``longest`` states a known bound on rows per key and saves the count. ``spread`` is for callers
    that run a Python kernel next: the shuffle below the window then has an explicit number of
    partitions, which adaptive coalescing leaves alone and the kernel reuses.
    """
    size = rows_per_block or ROWS_PER_BLOCK
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    key = tuple(key)
    largest = longest_group(df, key) if longest is None else longest
    if largest <= size:
        if spread and key:
            df = df.repartition(shuffle_tasks(df), *key)
        number = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint")
        return Placed(df.withColumn(pos, number), key, order, pos, size, largest, False)

    spark = df.sparkSession
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest // size))
    ranged = df.repartitionByRange(chunks, *key, *order).withColumn("_place_chunk", F.spark_partition_id())
    ranged = durable(ranged, "ordered")
    sizes = ranged.groupBy(*key, "_place_chunk").agg(F.count(F.lit(1)).alias("_place_n"))
    earlier = Window.partitionBy(*key).orderBy("_place_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, "_place_chunk", F.coalesce(F.sum("_place_n").over(earlier), F.lit(0)).alias("_place_before"))
    inside = F.row_number().over(Window.partitionBy(*key, "_place_chunk").orderBy(*order))
    numbered = null_safe(ranged.withColumn("_place_i", inside), offsets, [*key, "_place_chunk"])
    numbered = numbered.withColumn(pos, (F.col("_place_i") + F.col("_place_before")).cast("bigint"))
    numbered = numbered.withColumn("_blk", F.floor((F.col(pos) - 1) / size).cast("bigint"))
    numbered = numbered.drop("_place_i", "_place_before", "_place_chunk")
    return Placed(numbered, key, order, pos, size, largest, True)
