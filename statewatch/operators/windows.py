"""Count-based windows: densities, adjacent-pair lifts and feature families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions import bits as B
from statewatch.functions.arrays import doubles, let, outer, total
from statewatch.operators.states import additive_state, density
from statewatch.plans import place, require
from statewatch.plans.guards import null_safe


def window_id(position: Column, length: int) -> Column:
    return F.floor((position - 1) / length).cast("bigint")


def window_density(
    df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, dim: int, length: int, partial: bool = False
) -> DataFrame:
    """Density and mean unit vector of consecutive windows of ``length`` rows.

    Only complete windows are kept unless ``partial``.
    """
    placed = place(df, key, order, "_t").rows().withColumn("window", window_id(F.col("_t"), length))
    keys = [*key, "window"]
    states = additive_state(placed, keys, vec, dim)
    size = F.sqrt(total(F.transform(doubles(vec), lambda a: a * a)))
    means = placed.groupBy(*keys).agg(
        F.array(*[F.avg(F.get(doubles(vec), F.lit(i)) / size) for i in range(dim)]).alias("mean")
    )
    out = null_safe(states, means, keys).select(*keys, "n", density().alias("rho"), "mean")
    return out if partial else out.where(F.col("n") == length)


def pair_lift(df: DataFrame, key: Sequence[str], order: Sequence[str], vec: str, check: bool = True) -> DataFrame:
    """Outer product of rows (1, 2), (3, 4), ...; with ``check`` an odd count fails the query."""
    placed = place(df, key, order, "_t")
    beside = placed.look_back(1, lambda w: {"_first": F.lag(doubles(vec)).over(w)}).rows()
    second = F.pmod(F.col("_t"), F.lit(2)) == 0
    lifted = beside.where(second).withColumn("pair", (F.col("_t") / 2).cast("bigint") - 1)
    lifted = lifted.withColumn("lift", outer("_first", doubles(vec))).drop("_first", "_t")
    if check:
        odd = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.pmod("_n", F.lit(2)) == 1)
        if odd.limit(1).count():
            raise ValueError("pair lifting needs an even number of rows per key")
    return lifted


def window_features(
    df: DataFrame, key: Sequence[str], order: Sequence[str], bits: str, size: int, cycles: int, scenario: str
) -> DataFrame:
    """Four feature families from the same complete windows of ``cycles`` rows.

    ``counts`` the event rate of each row in order, ``first_moment`` the mean per detector,
    ``translation`` and ``orbit_power`` the mean of the row statistics (``spatial``) or the mean
    outer product of rows (1, 2), (3, 4), ... (``temporal``). A window holds ``cycles`` rows, so
    the ordered list in each group is bounded.
    """
    if scenario not in ("spatial", "temporal"):
        raise ValueError("scenario must be 'spatial' or 'temporal'")
    if scenario == "temporal" and cycles % 2:
        raise ValueError("temporal windows need an even number of rows")
    sites, orbits = size * size, B.mode_orbits(size)
    stats = B.grid_pair_stats(bits, size)
    rows = place(df, key, order, "_t").rows()
    rows = rows.withColumns(
        {
            "window": window_id(F.col("_t"), cycles),
            "_rate": B.firing_rate(bits),
            "_stat": stats,
            "_orb": B.orbit_sum(B.power_state_2d(bits, size), orbits),
        }
    ).withColumn("_tr", F.array("_stat.z", "_stat.g1", "_stat.g2"))
    keys = [*key, "window"]

    def mean_of(name: str, n: int) -> Column:
        return F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(n)])

    def lift_mean(name: str, n: int) -> Column:
        seq = F.transform(F.array_sort(F.collect_list(F.struct("_t", name))), lambda e: e[name])
        pairs = F.sequence(F.lit(0), F.lit(cycles // 2 - 1))

        def cell(rows: Column, i: int, j: int) -> Column:
            product = lambda p: F.get(F.get(rows, 2 * p), F.lit(i)) * F.get(F.get(rows, 2 * p + 1), F.lit(j))
            return total(F.transform(pairs, product)) / (cycles // 2)

        return let(seq, lambda rows: F.array(*[cell(rows, i, j) for i in range(n) for j in range(n)]))

    family = mean_of if scenario == "spatial" else lift_mean
    counts = F.transform(F.array_sort(F.collect_list(F.struct("_t", "_rate"))), lambda e: e["_rate"])
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        counts.alias("counts"),
        mean_of(bits, sites).alias("first_moment"),
        family("_tr", 3).alias("translation"),
        family("_orb", len(orbits)).alias("orbit_power"),
    )
    return grouped.where(F.col("n") == cycles)


def pair_bank(size: int, displacements: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(displacement, first, second)`` for every site and declared displacement."""
    bank = []
    for d, (dr, dc) in enumerate(displacements):
        for site in range(size * size):
            r, c = divmod(site, size)
            other = (r + dr) % size * size + (c + dc) % size
            if other == site:
                raise ValueError("a pair needs two different detectors")
            bank.append((d, site, other))
    return bank


def _bank_values(df: DataFrame, keep: Sequence[str], bank: Sequence[tuple[int, int, int]], value) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("pair"), F.lit(d).alias("displacement"), value(a, b).alias("value"))
            for k, (d, a, b) in enumerate(bank)
        ]
    )
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def pair_products(df: DataFrame, keep: Sequence[str], bits: str, bank: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Product of the two signs of every pair in the bank, one row per (row, pair)."""
    signed = df.withColumn("_z", B.signs(bits))
    return _bank_values(signed, keep, bank, lambda a, b: F.get("_z", F.lit(a)) * F.get("_z", F.lit(b)))


def shadow_products(
    df: DataFrame, keep: Sequence[str], bases: str, outcomes: str, bank: Sequence[tuple[int, int, int]], z: int = 2
) -> DataFrame:
    """Unbiased pair estimate from random bases: 9 times the product when both bases are Z, else 0."""
    def value(a: int, b: int) -> Column:
        both = (F.get(bases, F.lit(a)) == z) & (F.get(bases, F.lit(b)) == z)
        product = F.get(outcomes, F.lit(a)) * F.get(outcomes, F.lit(b))
        return F.when(both, 9.0 * product).otherwise(F.lit(0.0))

    return _bank_values(df, keep, bank, value)


def checked_bits(bits: str) -> Column:
    return require(F.forall(doubles(bits), lambda b: b.isin(0.0, 1.0)), doubles(bits), "bits must be binary")
