"""Mixing sources to target weights, with Spark expressions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewatch.llm.common import unused
from statewatch.llm.sharding import hash52
from statewatch.plans.durable import durable

#: The exponent is searched on grids of so many points; each round narrows the bracket by GRID - 1.
GRID, ROUNDS = 33, 5
#: Top bits of the 52-bit order that cut a permutation into parts.
PART_BITS = 12


@dataclass(frozen=True)
class Mix:
    """What to aim at: an entropy of the weights (as a fraction of the log of the number of sources) or a limit on how often
    a record repeats. ``budget`` is the number of tokens to draw; None draws just enough that no source is used
    less than once."""

    entropy: float | None = None
    repeats: float | None = None
    budget: int | None = None
    seed: int = 0

    def __post_init__(self):
        if (self.entropy is None) == (self.repeats is None):
            raise ValueError("give either an entropy or a repetition limit")


def source_sizes(records: DataFrame) -> DataFrame:
    """``(source, size, rows)``: a partial sum per task, so a hot source costs one row per task."""
    return records.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("rows"))


def exponent(sizes: DataFrame, mix: Mix) -> float:
    """The exponent of the token shares that meets the target, in [0, 1], rounded to six decimals.

    Entropy and largest repetition both fall as the exponent grows, so the point where the target is met is bracketed
    and the bracket narrowed, a grid at a time; one small aggregate over the source table serves each grid.
    1 keeps the shares as they are; where even 0 (equal weights) stays within the target, the result is 0.
    """
    shares = sizes.where("size > 0")
    all_ = shares.agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.max("size").alias("most"), F.min("size").alias("least")).first()
    if not all_["k"]:
        return 1.0
    n = float(all_["n"])
    shares = shares.select(F.ln(F.col("size") / n).alias("lp"))
    largest, smallest = all_["most"] / n, all_["least"] / n

    def met(t: float, z: float, zl: float) -> bool:
        if mix.entropy is not None:  # flat enough
            return log(z) - t * zl / z >= mix.entropy * log(all_["k"]) - 1e-12
        draw = mix.budget / n if mix.budget is not None else z * largest ** (1 - t)
        return draw * smallest ** (t - 1) / z <= mix.repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        grid = shares.withColumn("t", F.explode(F.array(*map(F.lit, points))))
        sums = grid.groupBy("t").agg(F.sum(F.exp(F.col("t") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("t") * F.col("lp")) * F.col("lp")).alias("zl"))
        good = sorted((r["t"], met(r["t"], r["z"], r["zl"])) for r in sums.collect())  # GRID rows
        if mix.entropy is not None:  # the largest exponent that is still flat enough
            hits = [t for t, ok in good if ok]
            if not hits or hits[-1] == 1.0:
                return 0.0 if not hits else 1.0
            low, high = hits[-1], min(t for t, _ in good if t > hits[-1])
        else:  # the smallest exponent that keeps to the limit
            hits = [t for t, ok in good if ok]
            if not hits or hits[0] == 0.0:
                return 1.0 if not hits else 0.0
            low, high = max(t for t, _ in good if t < hits[0]), hits[0]
    return round(low if mix.entropy is not None else high, 6)


def order_of(mix: Mix, block: Column, id: str) -> Column:
    """Place of a record in the permutation of its source for one block: 52 bits, the same for repeated rows."""
    return hash52(F.lit(mix.seed), block, F.col(id))


def source_plan(records: DataFrame, id: str, source: str, tokens: Column, mix: Mix) -> DataFrame:
    """One row per source: ``source, size, weight, target, full, cut``.

    ``target`` tokens are drawn: ``full`` whole blocks, then the start of one more permutation up to ``cut``, the largest order
    value whose running token count fits the rest. Running counts come from per-part sums; only the part with the
    cut is ordered exactly, a 2**-PART_BITS share of the source.
    """
    records = records.select(F.col(id).alias("id"), F.col(source).alias("source"), F.greatest(tokens, F.lit(0)).cast("bigint").alias("tokens"))
    sizes = durable(source_sizes(records), "sizes")
    power = exponent(sizes, mix)
    sized = sizes.where("size > 0")
    total = sized.agg(F.sum("size").alias("n"), F.max("size").alias("most")).first()
    n = float(total["n"] or 1)
    z = sized.agg(F.sum(F.pow(F.col("size") / n, F.lit(power))).alias("z")).first()["z"] or 1.0
    weight = F.when(F.col("size") > 0, F.pow(F.col("size") / n, F.lit(power)) / z).otherwise(0.0)
    budget = mix.budget if mix.budget is not None else total["most"] / (((total["most"] / n) ** power) / z) if total["most"] else 0
    # a target within a millionth of a whole block counts as that block
    passes = F.col("target") / F.col("size")
    whole = F.floor(passes + 1e-6)
    plan = sizes.withColumn("weight", weight).withColumn("target", F.floor(F.col("weight") * float(budget) + 1e-6))
    plan = plan.withColumn("full", F.when(F.col("size") > 0, whole).otherwise(F.lit(1)))  # records without tokens cost nothing
    plan = durable(plan.withColumn("rest", F.greatest(F.col("target") - F.col("full") * F.col("size"), F.lit(0))), "weights")

    part = F.shiftright("order", 52 - PART_BITS)
    open_ = plan.where("rest > 0").select(F.col("source").alias("_s"), "full", "rest")
    last = records.join(open_, F.col("source").eqNullSafe(F.col("_s")))
    last = last.select("source", "rest", order_of(mix, F.col("full"), "id").alias("order"), "tokens")
    last = durable(last.withColumn("part", part), "orders")
    parts = last.groupBy("source", "part").agg(F.sum("tokens").alias("sum"), F.max("order").alias("top"), F.first("rest").alias("rest"))
    running = F.sum("sum").over(Window.partitionBy("source").orderBy("part"))
    parts = parts.withColumn("upto", running)
    before = parts.where("upto <= rest").groupBy("source").agg(F.max("top").alias("cut"))
    split = parts.where("upto > rest and upto - sum < rest").select(F.col("source").alias("_s"), F.col("part").alias("_p"), (F.col("upto") - F.col("sum")).alias("base"))
    inside = last.join(split, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    fits = inside.withColumn("upto", F.col("base") + F.sum("tokens").over(Window.partitionBy("source").orderBy("order")))
    within = fits.where("upto <= rest").groupBy("source").agg(F.max("order").alias("cut"))
    cuts = before.unionByName(within).groupBy(F.col("source").alias("_s")).agg(F.max("cut").alias("cut"))
    joined = plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    return durable(joined.select("source", "size", "rows", "weight", "target", "full", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def mix_sources(records: DataFrame, id: str = "id", source: str = "source", tokens: Column | None = None, mix: Mix = Mix(repeats=2.0)) -> DataFrame:
    """``records`` drawn to the target weights, with ``block`` and ``order`` added.

    For the project's labelled tables, whose rows carry a ``source``, and any other table with an id and a source. ``tokens`` is the size of
    a record (1 where not given). Block b of a source is a permutation of its records by ``order``; whole blocks hold every record
    once, the last one is cut where its tokens fill the target. Records never move by source: the plan, one row per
    source, is joined to them, and a row is repeated or left out where it is read.

    Cases: NULL sources are one source; NULL or negative sizes count as 0, and a source without tokens is drawn once. Rows that repeat an id
    share a place and are drawn together. An empty table gives no rows. Columns named block or order are replaced.
    """
    size = F.coalesce(tokens if tokens is not None else F.lit(1), F.lit(0))
    name, full, cut = (unused(records, c) for c in ("_source", "_full", "_cut"))
    plan = source_plan(records, id, source, size, mix).select(F.col("source").alias(name), F.col("full").alias(full), F.col("cut").alias(cut))
    columns = [c for c in records.columns if c not in ("block", "order")]
    rows = records.select(*columns).join(plan, F.col(source).eqNullSafe(F.col(name)))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(full))))
    rows = rows.withColumn("order", order_of(mix, F.col("block"), id))
    return rows.where((F.col("block") < F.col(full)) | (F.col("order") <= F.col(cut))).select(*columns, "block", "order")


def positions(drawn: DataFrame, source: str) -> DataFrame:
    """Adds ``position``: the place of a drawn record in its block, from 1, counted part by part so that no task orders a whole source."""
    placed = drawn.withColumn("_p", F.shiftright("order", 52 - PART_BITS))
    counts = placed.groupBy(F.col(source).alias("_s"), F.col("block").alias("_b"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s", "_b").orderBy("_q")) - F.col("_n")
    offsets = counts.withColumn("_before", before)
    rank = F.row_number().over(Window.partitionBy(source, "block", "_p").orderBy("order"))
    ranked = placed.withColumn("_r", rank)
    same = ranked[source].eqNullSafe(offsets["_s"]) & (ranked["block"] == offsets["_b"]) & (ranked["_p"] == offsets["_q"])
    return ranked.join(offsets, same).withColumn("position", F.col("_r") + F.col("_before")).drop("_p", "_r", "_s", "_b", "_q", "_n", "_before")
