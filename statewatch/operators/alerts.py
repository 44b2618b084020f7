"""Shot alerts, alert-budget thresholds, event windows, triage by rank and stream endpoints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.operators.shaping import check_intervals
from statewatch.plans import place, require
from statewatch.plans.guards import null_safe

INF = float("inf")


def _threshold(df: DataFrame, threshold: float | DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach one threshold per key: a number, or a table (key..., threshold)."""
    if isinstance(threshold, DataFrame):
        return null_safe(df, threshold.select(*key, F.col("threshold").alias("_thr")), list(key))
    return df.withColumn("_thr", F.lit(float(threshold)))


def shot_alerts(scores: DataFrame, threshold: float | DataFrame, key: Sequence[str] = (), shot: Sequence[str] = ("shot",)) -> DataFrame:
    """One row per shot: maximum, its first role, alert (some role strictly above), first crossing role.

    ``scores`` has one row per (key, shot, role); all roles must already be scored.
    """
    rows = _threshold(scores, threshold, key)
    crossing = F.min(F.when(F.col("score") > F.col("_thr"), F.col("role")))
    return rows.groupBy(*key, *shot).agg(
        F.max("score").alias("shot_score"),
        F.max_by("role", F.struct(F.col("score"), -F.col("role"))).alias("score_role"),
        F.coalesce(crossing, F.lit(-1)).alias("first_role"),
        crossing.isNotNull().alias("alert"),
    )


def shot_maxima(scores: DataFrame, key: Sequence[str] = (), shot: Sequence[str] = ("shot",)) -> DataFrame:
    return scores.groupBy(*key, *shot).agg(F.max("score").alias("maximum"))


def select_threshold(scores: DataFrame, max_alerts: int, key: Sequence[str] = (), shot: Sequence[str] = ("shot",)) -> DataFrame:
    """Smallest strict threshold that alerts on at most ``max_alerts`` shots, with its alert count.

    It is the (max_alerts + 1)-th largest shot maximum, or -inf when every shot may alert.
    Equal maxima are counted first, so the running count is over distinct values.
    """
    maxima = shot_maxima(scores, key, shot)
    cells = maxima.groupBy(*key, "maximum").agg(F.count(F.lit(1)).alias("_n"))
    above = place(cells, key, [F.col("maximum").desc()], "_t").running(_cum=("sum", F.col("_n"))).rows()
    hit = (F.col("_cum") > max_alerts) & (F.col("_cum") - F.col("_n") <= max_alerts)
    out = above.groupBy(*key).agg(
        F.max(F.when(hit, F.struct("maximum", (F.col("_cum") - F.col("_n")).alias("c")))).alias("_h"), F.sum("_n").alias("_shots")
    )
    budget = F.lit(max_alerts)
    enough = require(F.col("_shots") >= budget, F.col("_h"), "max_alerts exceeds the number of shots")
    return out.select(
        *key,
        F.coalesce(enough["maximum"], F.lit(-INF)).alias("threshold"),
        F.coalesce(enough["c"], F.col("_shots")).alias("alert_count"),
    )


def frontier(scores: DataFrame, key: Sequence[str] = (), shot: Sequence[str] = ("shot",)) -> DataFrame:
    """Every candidate threshold (-inf, distinct scores, +inf) with the number of shots above it."""
    maxima = shot_maxima(scores, key, shot)
    tops = maxima.groupBy(*key, F.col("maximum").alias("candidate")).agg(F.count(F.lit(1)).alias("_n"))
    values = scores.select(*key, F.col("score").alias("candidate")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    cells = tops.unionByName(values).groupBy(*key, "candidate").agg(F.sum("_n").alias("_n"))
    cum = place(cells, key, [F.col("candidate").desc()], "_t").running(_c=("sum", F.col("_n"))).rows()
    inner = cum.select(*key, "candidate", (F.col("_c") - F.col("_n")).alias("alerts"))
    ends = maxima.groupBy(*key).agg(F.count(F.lit(1)).alias("_s"))
    both = F.array(
        F.struct(F.lit(-INF).alias("candidate"), F.col("_s").alias("alerts")),
        F.struct(F.lit(INF).alias("candidate"), F.lit(0).cast("bigint").alias("alerts")),
    )
    outer = ends.select(*key, F.explode(both).alias("_e")).select(*key, "_e.*")
    return inner.unionByName(outer)


def in_windows(shot: Column, windows: Mapping[str, tuple[int, int]]) -> dict[str, Column]:
    return {f"in_{n}": ((shot >= a) & (shot < b)).cast("int") for n, (a, b) in windows.items()}


def shot_report(
    scores: DataFrame, threshold: float | DataFrame, windows: Mapping[str, tuple[int, int]], key: Sequence[str] = (), shot: str = "shot"
) -> DataFrame:
    """Alerts with cumulative count by shot, rank by score (lower shot first) and window flags."""
    alerts = shot_alerts(scores, threshold, key, (shot,)).withColumn("_a", F.col("alert").cast("int"))
    counted = place(alerts, key, [shot], "_i").running(cumulative=("sum", F.col("_a"))).rows().drop("_i", "_a")
    ranked = place(counted, key, [F.col("shot_score").desc(), F.col(shot)], "rank").rows()
    return ranked.withColumns(in_windows(F.col(shot), windows))


def event_summary(alerts: DataFrame, windows: Mapping[str, tuple[int, int]], primary: str, key: Sequence[str] = (), shot: str = "shot") -> DataFrame:
    """Per key and window: detected, first alerting shot and role; alerts before the primary window.

    Windows are a short list in the plan, so one aggregation serves all of them.
    """
    for name, (a, b) in windows.items():
        check_intervals([(name, a, b)])
    s, alert = F.col(shot), F.col("alert")
    aggs = [F.count_if(alert & (s < windows[primary][0])).alias("pre_alerts")]
    cells = []
    for name, (a, b) in windows.items():
        first = F.min(F.when(alert & (s >= a) & (s < b), F.struct(s.alias("shot"), F.col("first_role").alias("role"))))
        aggs.append(first.alias(f"_w_{name}"))
        w = F.col(f"_w_{name}")
        cells.append(
            F.struct(
                F.lit(name).alias("window"), w.isNotNull().alias("detected"), w["shot"].alias("first_shot"), w["role"].alias("first_role")
            )
        )
    out = alerts.groupBy(*key).agg(*aggs)
    return out.select(*key, "pre_alerts", F.explode(F.array(*cells)).alias("_c")).select(*key, "pre_alerts", "_c.*")


def join_outcomes(scores: DataFrame, outcomes: DataFrame, shot: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Scores with ``mismatch`` = actual XOR predicted; every shot must have exactly one outcome."""
    single = outcomes.groupBy(*shot).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(actual).alias("_a"), F.any_value(predicted).alias("_p")
    )
    label = require(F.col("_n") == 1, F.col("_a").bitwiseXOR(F.col("_p")), "each shot needs exactly one outcome")
    return null_safe(scores, single.select(*shot, label.cast("int").alias("mismatch")), list(shot))


def frozen_rank(scores: DataFrame, key: Sequence[str], id: str, score: str = "score") -> DataFrame:
    """Rank by score descending, then lower id."""
    return place(scores, key, [F.col(score).desc(), F.col(id)], "rank").rows()


def risk_at_budget(
    scores: DataFrame, label: str, id: str, budgets: Sequence[int], key: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    """Top-budget capture: recall (NULL without positives), precision, retained rate, coverage, area.

    The area is the trapezoid of recall over the alert fraction between the given budgets.
    """
    ranked = frozen_rank(scores, key, id, score)
    y = F.col(label).cast("bigint")
    sums = [F.sum(F.when(F.col("rank") <= b, y).otherwise(0)).alias(f"_c{b}") for b in budgets]
    row = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"), *sums)
    positives = F.when(F.col("_pos") > 0, F.col("_pos"))
    area = F.lit(0.0)
    for a, b in zip(budgets, budgets[1:], strict=False):
        area = area + (F.col(f"_c{a}") + F.col(f"_c{b}")) / positives * 0.5 * (b - a) / F.col("_n")
    good = F.lit(min(budgets) > 0) & (F.col("_n") > max(budgets))
    cells = [
        F.struct(
            F.lit(b).alias("budget"),
            F.col(f"_c{b}").alias("captured"),
            F.col("_pos").alias("positives"),
            (F.col(f"_c{b}") / positives).alias("recall"),
            (F.col(f"_c{b}") / F.lit(b)).alias("precision"),
            ((F.col("_pos") - F.col(f"_c{b}")) / (F.col("_n") - b)).alias("retained_rate"),
            (1.0 - F.lit(b) / F.col("_n")).alias("coverage"),
            area.alias("area"),
        )
        for b in budgets
    ]
    checked = require(good, F.array(*cells), "budgets must lie strictly between 0 and the number of shots")
    return row.select(*key, F.explode(checked).alias("_r")).select(*key, "_r.*")


def stream_endpoint(trace: DataFrame, key: Sequence[str], t: str, value: str, threshold: float | DataFrame, boundary: int | Column, post: int | Column) -> DataFrame:
    """First crossing (value >= threshold, t counted from 0) and the restricted post-boundary delay.

    A crossing before the boundary or none at all has delay 1; otherwise (offset + 1) / post.
    """
    cut = F.lit(boundary) if isinstance(boundary, int) else boundary
    length = F.lit(post) if isinstance(post, int) else post
    rows = _threshold(trace, threshold, key).withColumns({"_cut": cut, "_len": length})
    bad = F.isnan(value) | F.isnan("_thr") | F.col(value).isNull()
    checked = rows.withColumn("_v", require(~bad, F.col(value), "trace and threshold must be numbers"))
    out = checked.groupBy(*key).agg(
        F.min(F.when(F.col("_v") >= F.col("_thr"), F.col(t))).alias("first_alarm"), F.any_value("_cut").alias("_cut"), F.any_value("_len").alias("_len")
    )
    at = F.col("first_alarm")
    early, miss = at.isNotNull() & (at < F.col("_cut")), at.isNull()
    offset = F.when(~early & ~miss, at - F.col("_cut"))
    return out.select(
        *key, "first_alarm", early.cast("int").alias("pre_alarm"), miss.cast("int").alias("miss"),
        offset.alias("post_alarm"), F.coalesce((offset + 1) / F.col("_len"), F.lit(1.0)).alias("delay"),
    )


def cohort_summary(rows: DataFrame, cohorts: Sequence, states: Sequence, methods: Sequence) -> tuple[DataFrame, DataFrame]:
    """Mean over states inside each cohort, then over cohorts; every combination must occur once.

    ``rows``: cohort, state, method, pre_alarm, miss, delay.
    """
    keys = ["cohort", "state", "method"]
    expected = len(cohorts) * len(states) * len(methods)
    known = F.col("cohort").isin(*cohorts) & F.col("state").isin(*states) & F.col("method").isin(*methods)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    seen = counts.agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("most"), F.count_if(~known).alias("other")).first()
    if seen["n"] != expected or seen["most"] != 1 or seen["other"]:
        raise ValueError("rows must cover every cohort, state and method exactly once")
    per = rows.groupBy("cohort", "method").agg(
        F.avg("pre_alarm").alias("pre_alarm"), F.avg("delay").alias("delay"), F.avg("miss").alias("miss"),
        F.sum("pre_alarm").alias("_pre"), F.sum("miss").alias("_miss"),
    )
    macro = per.groupBy("method").agg(
        F.sum("_pre").alias("pre_alarms"), F.sum("_miss").alias("misses"), F.avg("delay").alias("macro_delay")
    )
    return per.drop("_pre", "_miss"), macro


def retention(macro: DataFrame, target: str, comparators: Sequence[str]) -> DataFrame:
    """Target is kept only if, against each comparator, pre-alarms are no more and delay strictly less."""
    mine = macro.where(F.col("method") == target).select(F.col("pre_alarms").alias("_p"), F.col("macro_delay").alias("_d"))
    rows = macro.where(F.col("method").isin(*comparators)).crossJoin(F.broadcast(mine))  # one target row
    out = rows.select(
        F.col("method").alias("comparator"),
        (F.col("_d") - F.col("macro_delay")).alias("delay_difference"),
        (F.col("_p") <= F.col("pre_alarms")).alias("no_worse_pre_alarms"),
        (F.col("_d") < F.col("macro_delay")).alias("lower_delay"),
    ).withColumn("passes", F.col("no_worse_pre_alarms") & F.col("lower_delay"))
    verdict = out.agg(F.every("passes").alias("retained"))
    return out.crossJoin(F.broadcast(verdict))  # one verdict row


def predicates(facts: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Named atomic predicates over a one-row table of facts, and whether all hold."""
    cells = [F.struct(F.lit(n).alias("predicate"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in rules.items()]
    every = F.coalesce(cells[0]["holds"], F.lit(False))
    for c in cells[1:]:
        every = every & c["holds"]
    return facts.select(F.explode(F.array(*cells)).alias("_c"), every.alias("all_hold")).select("_c.*", "all_hold")


def resource_counts(pairs: DataFrame, pair: Sequence[str], checks: int, key: Sequence[str] = ()) -> DataFrame:
    """Paired and physical shots, role updates and event bits exposed; one row per (pair, role)."""
    shots = F.count_distinct(*[F.col(c) for c in pair])
    updates = F.count(F.lit(1))
    return pairs.groupBy(*key).agg(
        shots.alias("paired_shots"), (2 * shots).alias("physical_shots"), updates.alias("role_updates"),
        (2 * checks * updates).alias("bits_exposed"),
    )


