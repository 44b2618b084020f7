"""Indexing, splits, pairing, folds, shard merging and domain checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewatch.functions.arrays import col, doubles, let, total
from statewatch.plans import place, require

# ---------------------------------------------------------------- shot-major indexing


def to_index(shot: Column | str, role: Column | str, roles: int, start: int = 0) -> Column:
    """``(shot - start) * roles + role``; out-of-range input fails the query."""
    s, r = col(shot), col(role)
    good = (s >= start) & (r >= 0) & (r < roles)
    return require(good, (s - start).cast("bigint") * roles + r, "shot or role out of range")


def from_index(index: Column | str, roles: int, start: int = 0) -> tuple[Column, Column]:
    """The shot and role of an index."""
    i = require(col(index) >= 0, col(index).cast("bigint"), "index must be nonnegative")
    role = F.pmod(i, F.lit(roles))
    return ((i - role) / roles).cast("bigint") + start, role.cast("int")


def flatten_shots(df: DataFrame, bits: str, shot: str, role: str, roles: int, start: int = 0) -> DataFrame:
    """One row per bit with its update index: shot-major, then role, then check."""
    index = to_index(shot, role, roles, start)
    rows = df.select(index.alias("index"), F.posexplode(bits).alias("chk", "bit"))
    return rows.withColumn("bit", require(F.col("bit").isin(0, 1), F.col("bit"), "bits must be binary"))


# ---------------------------------------------------------------- layout and differencing


def canonical_layout(layout: DataFrame) -> DataFrame:
    """Rank the checks of each role by coordinates; every role must have the same checks.

    ``layout`` has columns position, role, x, y. The result adds ``chk``.
    """
    ranked = layout.withColumn("chk", F.dense_rank().over(Window.partitionBy("role").orderBy("x", "y")) - 1)
    shape = layout.groupBy("role").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("checks"))
    distinct = shape.agg(F.count_distinct("checks").alias("n")).first()["n"]
    if distinct != 1:
        raise ValueError("every role must have the same checks")
    return ranked


def apply_layout(records: DataFrame, layout: DataFrame, bits: str = "bits", keep: Sequence[str] = ("shot",)) -> DataFrame:
    """Map declared bit positions to ``(role, chk)``. The layout has one row per bit of a record."""
    order = canonical_layout(layout).select("position", "role", "chk")
    long = records.select(*keep, F.posexplode(bits).alias("position", "bit"))
    return long.join(order, "position").drop("position")


def difference_events(df: DataFrame, key: Sequence[str], order: str, bit: str, rounds: int | None = None) -> DataFrame:
    """First round as measured, later rounds XOR the round before; no terminal event.

    ``key`` names one check of one shot; ``rounds`` is its known length, if the caller has one.
    """
    placed = place(df, key, [order], "_t", longest=rounds)
    changed = placed.look_back(
        1, lambda w: {"event": F.col(bit).bitwiseXOR(F.lag(bit, 1, 0).over(w)).cast("int")}
    )
    return changed.rows().drop("_t")


# ---------------------------------------------------------------- splits, pairs, samples, folds


def check_intervals(intervals: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Named half-open intervals must be nonempty, nonnegative and disjoint. Returned by start.

    Sweeps the ends: at each opening no other interval may still be open.
    """
    wrong = [name for name, start, stop in intervals if not 0 <= start < stop]
    if wrong:
        raise ValueError(f"empty or negative interval: {', '.join(wrong)}")
    ends = sorted((at, opens, name) for name, start, stop in intervals for at, opens, name in ((start, True, name), (stop, False, name)))
    current = None
    for _, opens, name in ends:
        if not opens:
            current = None
        elif current is not None:
            raise ValueError(f"{name} starts inside {current}: they overlap")
        else:
            current = name
    return sorted(intervals, key=lambda r: r[1])


def assign_split(df: DataFrame, index: str, intervals: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Name the interval that holds ``index``; rows outside all intervals are left out.

    The catalogue is a short list in the plan, so the range join is a projection.
    """
    name = F.lit(None).cast("string")
    for label, start, stop in check_intervals(intervals):
        name = F.when((F.col(index) >= start) & (F.col(index) < stop), F.lit(label)).otherwise(name)
    return df.withColumn("split", name).where(F.col("split").isNotNull())


def pair_blocks(
    reference: DataFrame, monitor: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Pair the i-th reference record with the i-th monitor record of the same ``key``.

    ``pair`` plus ``ref_*`` and ``mon_*`` columns. An unpaired row keeps its values, and ``side`` names where it comes from.
    """
    keys = [*key, "pair"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        placed = place(df, key, order, "pair").rows()
        return placed.select(*key, (F.col("pair") - 1).alias("pair"), *[F.col(v).alias(f"{prefix}_{v}") for v in values])

    ref, mon = side(reference, "ref"), side(monitor, "mon")
    marked = ref.withColumn("_r", F.lit(True)).join(mon.withColumn("_m", F.lit(True)), keys, "full")
    side_ = F.when(F.col("_m").isNull(), "reference").when(F.col("_r").isNull(), "monitor")
    return marked.withColumn("side", side_).drop("_r", "_m")


def stratified_sample(df: DataFrame, stratum: str, id: str, n: int, strata: int, seed: int) -> DataFrame:
    """``n // strata`` rows per stratum, one more in the first ``n % strata``; hash order, no replacement.

    ``stratum`` is numbered 0 .. strata-1.
    """
    share, extra = divmod(n, strata)
    quota = F.lit(share) + (F.col(stratum) < extra).cast("int")
    placed = place(df, [stratum], [F.xxhash64(F.lit(seed), F.col(stratum), F.col(id)), F.col(id)], "_n")
    return placed.rows().where(F.col("_n") <= quota).drop("_n")


def assign_folds(df: DataFrame, label: str, id: str, k: int, repeats: int, seed: int) -> DataFrame:
    """Repeated stratified folds: one row per (row, repeat); each class is spread evenly over k folds."""
    repeated = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    shuffled = F.xxhash64(F.lit(seed), F.col("repeat"), F.col(id))
    placed = place(repeated, ["repeat", label], [shuffled, F.col(id)], "_n").rows()
    return placed.withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(k)).cast("int")).drop("_n")


# ---------------------------------------------------------------- shard merging


def merge_shards(shards: Sequence[DataFrame], index: str, n: int) -> DataFrame:
    """Union of shards whose ``index`` must cover 0 .. n-1 exactly once, ordered by index."""
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    problems = coverage_problems(merged, index, n)
    found = problems.limit(5).collect()
    if found:
        raise ValueError(f"shards do not cover the index range: {[r.asDict() for r in found]}")
    return merged.orderBy(index)


def coverage_problems(df: DataFrame, index: str, n: int) -> DataFrame:
    """Indices of 0 .. n-1 that are missing, duplicated or unknown."""
    counts = df.groupBy(F.col(index).cast("bigint").alias("index")).agg(F.count(F.lit(1)).alias("copies"))
    full = df.sparkSession.range(n).withColumnRenamed("id", "index")
    missing = full.join(counts, "index", "left_anti").select("index", F.lit("missing").alias("problem"))
    double = counts.where("copies > 1").select("index", F.lit("duplicate").alias("problem"))
    unknown = counts.where((F.col("index") < 0) | (F.col("index") >= n) | F.col("index").isNull())
    return missing.unionByName(double).unionByName(unknown.select("index", F.lit("unknown").alias("problem")))


# ---------------------------------------------------------------- domain checks


def is_binary(bits: Column | str) -> Column:
    return F.coalesce(F.forall(doubles(bits), lambda b: b.isin(0.0, 1.0)), F.lit(False))


def is_simplex(v: Column | str, tolerance: float = 1e-9) -> Column:
    a = doubles(v)
    return (F.size(a) > 0) & F.forall(a, lambda x: x >= -tolerance) & (F.abs(total(a) - 1.0) <= tolerance)


def is_box(v: Column | str, lower: Column | str, upper: Column | str, tolerance: float = 1e-9) -> Column:
    low = F.zip_with(doubles(v), col(lower), lambda x, b: x >= b - tolerance)
    high = F.zip_with(doubles(v), col(upper), lambda x, b: x <= b + tolerance)
    return F.coalesce(F.forall(low, lambda x: x) & F.forall(high, lambda x: x), F.lit(False))


def require_binary(bits: Column | str) -> Column:
    return require(is_binary(bits), doubles(bits), "bits must be binary")


def require_simplex(v: Column | str, tolerance: float = 1e-9) -> Column:
    """Clip tiny negatives and renormalise; anything further from the simplex fails the query."""
    clipped = F.transform(doubles(v), lambda x: F.greatest(x, F.lit(0.0)))
    unit = let(clipped, lambda c: let(total(c), lambda m: F.transform(c, lambda x: x / m)))
    return require(is_simplex(v, tolerance), unit, "not a probability vector")


def require_box(v: Column | str, lower: Column | str, upper: Column | str, tolerance: float = 1e-9) -> Column:
    low = F.zip_with(doubles(v), col(lower), lambda x, b: F.greatest(x, b))
    value = F.zip_with(low, col(upper), lambda x, b: F.least(x, b))
    return require(is_box(v, lower, upper, tolerance), value, "feature lies outside its bounds")


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check, and rows that do not (NULL counts as failing)."""
    passed = F.coalesce(good, F.lit(False))
    return df.where(passed), df.where(~passed)
