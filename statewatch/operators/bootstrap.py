"""Resampling on result tables: indices are rows, replicates are keys, counts replace copies."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statewatch.plans import draw_index, place, quantiles
from statewatch.plans.durable import durable
from statewatch.plans.guards import null_safe
from statewatch.plans.ordering import Group
from statewatch.plans.resample import DRAW_SPAN, drawn_sums, over_draws, replicate_sums, row_copies

LEVELS = {"lower": 0.025, "upper": 0.975}


def circular_blocks(
    spark: SparkSession, n: int, horizon: int, block: int, replicates: int, seed: int = 0,
    start: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``(replicate, position, index)``: blocks of consecutive indices that wrap modulo n.

    Starts are drawn by hash of (seed, replicate, block) unless ``start`` gives them.
    """
    if min(n, horizon, block, replicates) < 1:
        raise ValueError("sizes must be positive")
    blocks = -(-horizon // block)
    make = start or (lambda r, b: draw_index(n, seed, r, b))
    rows = spark.range(replicates).withColumnRenamed("id", "replicate")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("_s", make(F.col("replicate"), F.col("_b")).cast("bigint"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    position = F.col("_b") * block + F.col("_o")
    out = rows.select("replicate", position.alias("position"), F.pmod(F.col("_s") + F.col("_o"), F.lit(n)).alias("index"))
    return out.where(F.col("position") < horizon)


def keyed_blocks(sizes: DataFrame, key: Sequence[str], n: str, block: int, replicates: int, seed: int = 0) -> DataFrame:
    """``(key, replicate, position, index)``: as ``circular_blocks``, for each row (key, ``n``) of ``sizes`` as many indices as it says."""
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))
    rows = sizes.where(F.col(n) > 0).select(*key, F.col(n).alias("_n"), F.explode(copies).alias("replicate")).repartition(*key, "replicate")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block).cast("bigint"))))
    rows = rows.withColumn("_s", draw_index(F.col("_n"), seed, *[F.col(k) for k in key], F.col("replicate"), F.col("_b")))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    rows = rows.withColumn("position", F.col("_b") * block + F.col("_o")).where(F.col("position") < F.col("_n"))
    return rows.select(*key, "replicate", "position", F.pmod(F.col("_s") + F.col("_o"), F.col("_n")).alias("index"))


def uniform_draws(spark: SparkSession, n: int, draws: int, replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, position, index)`` with independent draws from 0 .. n-1."""
    return circular_blocks(spark, n, draws, 1, replicates, seed)


def draw_counts(indices: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """How often each replicate drew each index (of each key)."""
    return indices.groupBy(*key, "replicate", "index").agg(F.count(F.lit(1)).alias("copies"))


def draws_per_row(
    df: DataFrame, key: Sequence[str], replicates: int, seed: int = 0, draw: Callable[[Column, Column, Column], Column] | None = None
) -> DataFrame:
    """``(key, replicate, index)``: as many draws from a key's rows as it has rows, in every replicate.

    ``df`` has ``index`` 0, 1, ... inside each key. Row p makes draw p of each replicate, so the draws are made where the rows are, and equal ones
    merge before they move. ``draw(replicate, position, rows)`` gives the index; by default it is a hash.
    """
    make = draw or (lambda r, p, n: draw_index(n, seed, r, p))
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rows = null_safe(df.select(*key, F.col("index").alias("_p")), sizes, list(key))
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    return rows.select(*key, "replicate", make(F.col("replicate"), F.col("_p"), F.col("_n")).cast("bigint").alias("index"))


def intervals(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Percentile interval and the number of valid replicates; groups without any keep NULL bounds."""
    df = durable(df.select(*key, value), "values")  # the replays run once
    valid = df.groupBy(*key).agg(F.count(value).alias("valid"))
    found = quantiles(df, key, value, LEVELS)
    return null_safe(valid, found, list(key), "left")


def bootstrap_risk(
    scores: DataFrame, indices: DataFrame, budgets: Sequence[int], method: str = "method", id: str = "id", label: str = "label"
) -> DataFrame:
    """Captured positives, recall, precision and retained rate per replicate, method and budget.

    The ranking is frozen: rows are ranked once, a replicate only changes how many copies each
    rank holds, and the copy count at the budget boundary is split. ``scores`` has (method, id,
    index, score, label) with ``index`` numbering ids 0, 1, ....

    Each range of the index gives its totals and the first of its drawn rows by rank: as many as the largest budget, since a drawn row has a
    copy at least. Only these heads are put in order.
    """
    ranked = place(scores, [method], [F.col("score").desc(), F.col(id)], "rank").rows()
    keys = ["replicate", method]
    whole = scores.schema[label].dataType
    wanted = max(budgets)
    rows = ranked.select(method, "index", "rank", F.col(label).cast("double").alias("_l"))

    def heads(g: Group, r: np.ndarray, o: np.ndarray, c: np.ndarray) -> Group:
        by_rank, by_draw = np.argsort(g["rank"], kind="stable"), np.argsort(r, kind="stable")
        at, rank, y = g["_o"][by_rank], g["rank"][by_rank], np.asarray(g["_l"], float)[by_rank]
        known, r, o, c = ~np.isnan(y), r[by_draw], o[by_draw], c[by_draw]
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1), len(r)]
        out = {n: [] for n in ("replicate", "_n", "_pos", "_rank", "_copies", "_label")}
        for a, b in zip(cuts, cuts[1:], strict=False):
            n = np.bincount(o[a:b], c[a:b], DRAW_SPAN).astype(np.int64)[at]
            first = np.flatnonzero(n)[:wanted]
            pos = float(y[known] @ n[known]) if (n[known] > 0).any() else None
            of = [int(r[a]), int(n.sum()), pos, rank[first], n[first], [v if k else None for v, k in zip(y[first].tolist(), known[first], strict=True)]]
            for name, value in zip(out, of, strict=True):
                out[name].append(value)
        return out

    schema = "replicate bigint, _n bigint, _pos double, _rank array<bigint>, _copies array<bigint>, _label array<double>"
    found = durable(over_draws(rows, [method], ["rank", "_l"], indices, schema, heads).where("_n > 0"), "heads")
    each = found.select(*keys, F.explode(F.arrays_zip("_rank", "_copies", "_label")).alias("_h"))
    each = each.select(*keys, F.col("_h._rank").alias("rank"), F.col("_h._copies").alias("copies"), F.col("_h._label").cast(whole).alias(label))
    cum = place(each, keys, ["rank"], "_t").running(_cum=("sum", F.col("copies"))).rows()
    before = F.col("_cum") - F.col("copies")
    taken = lambda b: F.least(F.col("copies"), F.greatest(F.lit(0), F.lit(b) - before))
    row = cum.groupBy(*keys).agg(*[F.sum(F.col(label) * taken(b)).alias(f"_c{b}") for b in budgets])
    row = null_safe(row, found.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos")), keys)
    row = row.withColumns({f"_c{b}": F.coalesce(f"_c{b}", F.when(F.col("_pos").isNotNull(), 0).cast(row.schema[f"_c{b}"].dataType)) for b in budgets})
    positives = F.when(F.col("_pos") > 0, F.col("_pos"))
    cells = F.array(
        *[
            F.struct(
                F.lit(b).alias("budget"), F.col(f"_c{b}").alias("captured"), (F.col(f"_c{b}") / positives).alias("recall"),
                (F.col(f"_c{b}") / F.lit(b)).alias("precision"), ((F.col("_pos") - F.col(f"_c{b}")) / (F.col("_n") - b)).alias("retained_rate"),
            )
            for b in budgets
        ]
    )
    return row.select(*keys, F.explode(cells).alias("_r")).select(*keys, "_r.*")


def risk_intervals(estimates: DataFrame, metric: str, method: str = "method") -> DataFrame:
    return intervals(estimates.withColumn("_v", F.col(metric).cast("double")), [method, "budget"], "_v")


def risk_differences(estimates: DataFrame, metric: str, target: str, comparators: Sequence[str], method: str = "method") -> DataFrame:
    """Interval of target minus comparator inside each replicate."""
    estimates = durable(estimates.select("replicate", method, "budget", metric), "estimates")  # read from both sides
    mine = estimates.where(F.col(method) == target).select("replicate", "budget", F.col(metric).alias("_mine"))
    other = estimates.where(F.col(method).isin(*comparators))
    gap = other.join(mine, ["replicate", "budget"]).withColumn("_v", (F.col("_mine") - F.col(metric)).cast("double"))
    return intervals(gap, [method, "budget"], "_v")


def bootstrap_threshold(
    maxima: DataFrame, indices: DataFrame, max_alerts: int, frozen: Mapping[str, float], method: str = "method"
) -> DataFrame:
    """Selected threshold and alert counts of each resample of shots.

    ``maxima`` has (method, index, maximum). Equal maxima of a replicate are merged before the
    running count, as in ``select_threshold``. Draws meet the maxima in a shuffled join: the planner does not see how many rows a draw table
    explodes to and would broadcast all of them.
    """
    limit = F.lit(None).cast("double")
    for name, value in frozen.items():
        limit = F.when(F.col(method) == name, F.lit(float(value))).otherwise(limit)
    keys = ["replicate", method]
    drawn = draw_counts(indices).join(maxima.hint("merge"), "index")
    cells = durable(drawn.groupBy(*keys, "maximum").agg(F.sum("copies").alias("_n")), "cells")  # the draws are joined once
    cum = place(cells, keys, [F.col("maximum").desc()], "_t").running(_c=("sum", F.col("_n"))).rows()
    above = F.col("_c") - F.col("_n")
    hit = (F.col("_c") > max_alerts) & (above <= max_alerts)
    out = cum.groupBy(*keys).agg(
        F.max(F.when(hit, F.col("maximum"))).alias("threshold"),
        F.max(F.when(hit, above)).alias("alert_count"),
        F.coalesce(F.sum(F.when(F.col("maximum") > limit, F.col("_n"))), F.lit(0)).alias("frozen_count"),
        F.max("maximum").alias("zero_alert_threshold"),
    )
    return out


def count_frequencies(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("replicates"))


def paired_bootstrap(df: DataFrame, diff: str, indices: DataFrame, key: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Mean paired difference with a percentile interval.

    ``df`` has ``index`` 0, 1, ... inside each key. ``indices`` from ``draws_per_row`` hold each key's own draws; a table without the key columns serves
    all keys alike.
    """
    observed = df.groupBy(*key).agg(F.avg(diff).alias("mean"), F.count(F.lit(1)).alias("n"))
    sums = drawn_sums(df, key, [diff], indices)
    means = durable(sums.select(*key, (F.col(diff) / F.col("copies")).alias("_m")), "means")  # the resamples run once
    tail = (1 - confidence) / 2
    bounds = quantiles(means, key, "_m", {"lower": tail, "upper": 1 - tail})
    return null_safe(observed, bounds, list(key))


def paired_resample(df: DataFrame, diff: str, replicates: int, key: Sequence[str] = (), seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """``paired_bootstrap`` with draws made where the rows are: one shuffle of the rows, whatever the number of replicates.

    ``df`` has ``index`` 0, 1, ... inside each key.
    """
    observed = df.groupBy(*key).agg(F.avg(diff).alias("mean"), F.count(F.lit(1)).alias("n"))
    sums = replicate_sums(df, key, [diff], replicates, seed)
    means = sums.select(*key, (F.col(diff) / F.col("copies")).alias("_m"))
    tail = (1 - confidence) / 2
    bounds = quantiles(means, key, "_m", {"lower": tail, "upper": 1 - tail})
    return null_safe(observed, bounds, list(key))


def cluster_resample(df: DataFrame, diff: str, cluster: str, replicates: int, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """``cluster_bootstrap`` with draws made where the clusters are."""
    sums = replicate_sums(numbered_clusters(df, diff, cluster), [], ["_s", "_k"], replicates, seed)
    means = sums.select((F.col("_s") / F.col("_k")).alias("_m"))
    tail = (1 - confidence) / 2
    bounds = quantiles(means, [], "_m", {"lower": tail, "upper": 1 - tail})
    return df.agg(F.avg(diff).alias("mean")).crossJoin(F.broadcast(bounds))  # one row each


def _heads(rows: DataFrame, method: str, value: str, id: str, depth: int) -> DataFrame:
    """The first ``depth`` rows of each method, largest value first, ties by id: bounded heaps in the tasks, then one short ranking."""
    window = Window.partitionBy(method).orderBy(F.col(value).desc(), F.col(id))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= depth)


def _drawn_heads(
    scores: DataFrame, wanted: int, replicates: int, seed: int, method: str, id: str, value: str, extra: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(rows, drawn)``: one row per id with its ``index``, and for each method and replicate the rows that hold its first ``wanted`` draws.

    Only a short head of a ranking can matter: about as many rows as draws are wanted. Their copies are made in place by id, so that all
    methods share the draws of a replicate, and the head is doubled until every replicate has its draws in it.
    """
    ids = durable(scores.select(id, "index").distinct(), "ids")
    n = ids.count()
    depth = wanted + 8 * math.isqrt(wanted) + 16
    while True:
        heads = durable(_heads(scores, method, value, id, depth).select(method, id, "index", value, *extra, "rank"), "heads")
        marks = heads.select(F.col("index").alias("_i")).distinct().withColumn("chosen", F.lit(True))
        marked = ids.join(marks, ids["index"] == marks["_i"], "left").select("index", F.coalesce("chosen", F.lit(False)).alias("chosen"))
        copies = durable(row_copies(marked, [], replicates, seed), "copies")
        each = heads.join(copies, "index").select(method, id, value, *extra, "rank", F.posexplode("copies").alias("replicate", "copies"))
        least = each.groupBy(method, "replicate").agg(F.sum("copies").alias("c")).agg(F.min("c").alias("c")).first()["c"]
        if depth >= n or (least is not None and least >= wanted):
            return ids, each.where("copies > 0").withColumn("replicate", F.col("replicate").cast("bigint"))
        depth *= 2


def risk_resample(
    scores: DataFrame, budgets: Sequence[int], replicates: int, seed: int = 0, method: str = "method", id: str = "id", label: str = "label"
) -> DataFrame:
    """``bootstrap_risk`` with draws made where the rows are; all methods share the draws of a replicate.

    Positives of a replicate are sums over all rows; what a budget captures comes from the head of the frozen ranking only.
    """
    _, drawn = _drawn_heads(scores, max(budgets), replicates, seed, method, id, "score", [label])
    before = F.sum("copies").over(Window.partitionBy(method, "replicate").orderBy("rank")) - F.col("copies")
    taken = lambda b: F.least(F.col("copies"), F.greatest(F.lit(0), F.lit(b) - F.col("_before")))
    cum = drawn.withColumn("_before", before)
    row = cum.groupBy("replicate", method).agg(*[F.sum(F.col(label) * taken(b)).alias(f"_c{b}") for b in budgets])
    labels = scores.groupBy("index").agg(F.max(label).cast("double").alias("_pos"))
    row = row.join(replicate_sums(labels, [], ["_pos"], replicates, seed).withColumnRenamed("copies", "_n"), "replicate")
    positives = F.when(F.col("_pos") > 0, F.col("_pos"))
    cells = F.array(
        *[
            F.struct(
                F.lit(b).alias("budget"), F.col(f"_c{b}").alias("captured"), (F.col(f"_c{b}") / positives).alias("recall"),
                (F.col(f"_c{b}") / F.lit(b)).alias("precision"), ((F.col("_pos") - F.col(f"_c{b}")) / (F.col("_n") - b)).alias("retained_rate"),
            )
            for b in budgets
        ]
    )
    return row.select("replicate", method, F.explode(cells).alias("_r")).select("replicate", method, "_r.*")


def threshold_resample(
    maxima: DataFrame, max_alerts: int, frozen: Mapping[str, float], replicates: int, seed: int = 0, method: str = "method"
) -> DataFrame:
    """``bootstrap_threshold`` with draws made where the rows are; all methods share the draws of a replicate."""
    limit = F.lit(None).cast("double")
    for name, value in frozen.items():
        limit = F.when(F.col(method) == name, F.lit(float(value))).otherwise(limit)
    ids = maxima.withColumn("_id", F.col("index"))
    _, drawn = _drawn_heads(ids, max_alerts + 1, replicates, seed, method, "_id", "maximum", [])
    cells = drawn.groupBy("replicate", method, "maximum").agg(F.sum("copies").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("replicate", method).orderBy(F.col("maximum").desc()))
    cells = cells.withColumn("_c", upto).withColumn("_above", F.col("_c") - F.col("_n"))
    hit = (F.col("_c") > max_alerts) & (F.col("_above") <= max_alerts)
    found = cells.groupBy("replicate", method).agg(
        F.max(F.when(hit, F.col("maximum"))).alias("threshold"), F.max(F.when(hit, F.col("_above"))).alias("alert_count"), F.max("maximum").alias("zero_alert_threshold")
    )
    above = maxima.select("index", method, F.coalesce(F.col("maximum") > limit, F.lit(False)).cast("double").alias("_over"))
    methods = sorted(frozen)
    wide = above.groupBy("index").agg(*[F.max(F.when(F.col(method) == m, F.col("_over"))).alias(f"_m{i}") for i, m in enumerate(methods)])
    counts = replicate_sums(wide, [], [f"_m{i}" for i in range(len(methods))], replicates, seed) if methods else None
    if counts is None:
        return found.withColumn("frozen_count", F.lit(0).cast("bigint"))
    each = counts.select("replicate", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"_m{i}").cast("bigint").alias("c")) for i, m in enumerate(methods)])).alias("_f"))
    each = each.select(F.col("replicate").alias("_r"), F.col("_f.m").alias("_m"), F.col("_f.c").alias("_c"))
    joined = found.join(each, (found["replicate"] == each["_r"]) & (found[method] == each["_m"]), "left")
    return joined.select("replicate", method, "threshold", "alert_count", F.coalesce("_c", F.lit(0).cast("bigint")).alias("frozen_count"), "zero_alert_threshold")


def discordance(df: DataFrame, a: str, b: str, resamples: int = 0, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """The four categories of two error bits and the difference of error rates.

    With ``resamples`` an interval is added: a resample is one multinomial draw of four counts,
    made per replicate in the tasks, so the rows are read once.
    """
    code = F.col(a).cast("int") * 2 + F.col(b).cast("int")
    counts = df.agg(*[F.count_if(code == i).alias(n) for i, n in enumerate(["both_right", "only_b", "only_a", "both_wrong"])])
    n = F.col("both_right") + F.col("only_b") + F.col("only_a") + F.col("both_wrong")
    out = counts.select("*", n.alias("n"), ((F.col("only_a") - F.col("only_b")) / n).alias("difference"))
    if not resamples:
        return out
    spark = df.sparkSession
    rows = spark.range(resamples).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(out))  # one row of counts

    def draw(batches):
        for pdf in batches:
            values = []
            for r in pdf.itertuples(index=False):
                p = np.array([r.both_right, r.only_b, r.only_a, r.both_wrong], dtype=float)
                k = np.random.default_rng([seed, int(r.replicate)]).multinomial(int(r.n), p / p.sum())
                values.append((k[2] - k[1]) / r.n)
            yield pd.DataFrame({"_v": values})

    draws = rows.mapInPandas(draw, "_v double")
    tail = (1 - confidence) / 2
    bounds = quantiles(draws, [], "_v", {"lower": tail, "upper": 1 - tail})
    return out.crossJoin(F.broadcast(bounds))  # one row each


def numbered_clusters(df: DataFrame, diff: str, cluster: str) -> DataFrame:
    """``(index, _s, _k)``: sum and count of each cluster, numbered from 0 in order of the cluster id."""
    sums = df.groupBy(cluster).agg(F.sum(diff).alias("_s"), F.count(diff).alias("_k"))
    return place(sums, [], [cluster], "_i").rows().select((F.col("_i") - 1).alias("index"), "_s", "_k")


def cluster_bootstrap(df: DataFrame, diff: str, cluster: str, indices: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Resample whole clusters: mean over all member rows of the drawn clusters.

    ``indices`` draws from 0 .. clusters-1 in order of the cluster id. Clusters are reduced to
    (sum, count) before they meet the draws.
    """
    sums = drawn_sums(numbered_clusters(df, diff, cluster), [], ["_s", "_k"], indices)
    means = durable(sums.select(F.when(F.col("_k") != 0, F.col("_s") / F.col("_k")).alias("_m")), "means")  # the resamples run once
    tail = (1 - confidence) / 2
    bounds = quantiles(means, [], "_m", {"lower": tail, "upper": 1 - tail})
    return df.agg(F.avg(diff).alias("mean")).crossJoin(F.broadcast(bounds))  # one row each


def order_threshold(maxima: DataFrame, value: str, alpha: float, key: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    """The ceil((B + 1)(1 - alpha))-th smallest of B replicate maxima (at most the largest)."""
    ranked = place(maxima, key, [value], "_k", longest=longest).rows()
    size = maxima.groupBy(*key).agg(F.count(F.lit(1)).alias("replicates"))
    rows = null_safe(ranked, size, list(key))
    spot = F.least(F.ceil((F.col("replicates") + 1) * F.lit(1.0 - alpha)), F.col("replicates"))
    return rows.groupBy(*key).agg(F.max("replicates").alias("replicates"), F.max(F.when(F.col("_k") == spot, F.col(value))).alias("threshold"))
