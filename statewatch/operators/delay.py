"""Detection delays: rows per stream and method, and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewatch.operators.inference import clopper_pearson
from statewatch.plans import quantiles, require
from statewatch.plans.guards import null_safe

KINDS = ("null_arl", "surveillance", "restart_at_change")
KEYS = ["family", "effect", "method"]


def delay_rows(alarms: DataFrame, horizon: int, unit: int = 1) -> DataFrame:
    """Turn alarm times into delays.

    ``alarms`` has ``evaluation`` (null_arl, surveillance, restart_at_change), ``change_time``
    (NULL exactly for null_arl) and ``alarm_time`` (NULL = none). An alarm at or before the change
    is a false alarm and has no delay; a miss has delay ``horizon``.
    """
    kind, change, alarm = F.col("evaluation"), F.col("change_time"), F.col("alarm_time")
    fits = kind.isin(*KINDS) & ((kind == "null_arl") == change.isNull())
    checked = alarms.withColumn("evaluation", require(fits, kind, "evaluation and change_time disagree"))
    null = change.isNull()
    early = F.when(null, alarm.isNotNull()).otherwise(alarm.isNotNull() & (alarm <= change))
    eligible = null | ~early
    detected = ~null & eligible & alarm.isNotNull() & (alarm > change)
    censored = F.when(null, alarm.isNull()).otherwise(eligible & ~detected)
    length = F.coalesce(alarm, F.when(null, F.lit(horizon)).otherwise(change + horizon))
    delay = F.when(null | ~eligible, F.lit(None)).when(detected, F.least(F.lit(horizon), alarm - change)).otherwise(horizon)
    return checked.withColumns(
        {
            "false_alarm": early, "eligible": eligible, "detected": detected, "censored": censored,
            "run_length": length * unit, "delay": delay * unit, "horizon": F.lit(horizon * unit), "unit": F.lit(unit),
        }
    )


def delay_summary(rows: DataFrame, key: Sequence[str] = KEYS) -> DataFrame:
    """Restart delays, surveillance rates and survivors, and null run lengths, side by side.

    The three evaluations are aggregated separately and left-joined to the restart rows.
    """
    key = list(key)
    restart = rows.where("evaluation = 'restart_at_change'")
    watch = rows.where("evaluation = 'surveillance'")
    null = rows.where("evaluation = 'null_arl'")
    share = lambda c: F.avg(c.cast("double"))
    main = restart.groupBy(*key).agg(
        F.avg("delay").alias("mean_delay"),
        share(F.coalesce(F.col("delay") <= 64, F.lit(False))).alias("within_64"),
        share(F.coalesce(F.col("delay") <= 128, F.lit(False))).alias("within_128"),
        share(F.col("censored")).alias("miss_share"),
        F.count(F.lit(1)).alias("replicates"),
        F.max("horizon").alias("restart_horizon"),
    )
    spread = quantiles(restart, key, "delay", {"median_delay": 0.5, "delay_q1": 0.25, "delay_q3": 0.75})
    rates = watch.groupBy(*key).agg(share(F.col("false_alarm")).alias("false_alarm_share"), F.count(F.lit(1)).alias("watched"))
    alive = watch.where("eligible")
    survivors = alive.groupBy(*key).agg(
        F.avg("delay").alias("survivor_mean_delay"), share(F.col("censored")).alias("survivor_miss_share"), F.count(F.lit(1)).alias("survivors")
    )
    middle = quantiles(alive, key, "delay", {"survivor_median_delay": 0.5})
    lengths = null.groupBy(*key).agg(
        F.avg("run_length").alias("mean_run_length"), share(F.col("censored")).alias("null_censored"), F.count(F.lit(1)).alias("null_replicates")
    )
    # alarm times of null streams, cut at the restart horizon of the same group
    cut = null_safe(null.select(*key, "alarm_time", "unit"), main.select(*key, "restart_horizon"), key)
    capped = F.least(F.col("restart_horizon").cast("double"), F.coalesce((F.col("alarm_time") * F.col("unit")).cast("double"), F.lit(float("inf"))))
    free = cut.groupBy(*key).agg(F.avg(capped).alias("no_change_length"))
    out = main
    for part in (spread, rates, survivors, middle, lengths, free):
        out = null_safe(out, part, key, "left")
    return out.withColumns(
        {
            "reduction": F.col("no_change_length") - F.col("mean_delay"),
            "ratio": F.when(F.col("no_change_length") > 0, F.col("mean_delay") / F.col("no_change_length")),
        }
    )


def alarm_summary(runs: DataFrame) -> DataFrame:
    """False alarms with a 97.5 % upper bound, detection rate and median delay of detected streams.

    An alarm of a change stream up to the change itself detects nothing; it counts in ``early_alarms``.

    ``runs``: regime ('null' or 'change'), alarm_time (NULL = none), change_time.
    """
    null, changed = F.col("regime") == "null", F.col("regime") == "change"
    alarm = F.col("alarm_time").isNotNull()
    early = changed & alarm & (F.col("alarm_time") <= F.col("change_time"))
    found = changed & alarm & ~early
    counts = runs.agg(
        F.count_if(null).alias("null_streams"), F.count_if(null & alarm).alias("false_alarms"),
        F.count_if(changed).alias("change_streams"), F.count_if(found).alias("detections"), F.count_if(early).alias("early_alarms"),
    )
    delays = runs.where(found).withColumn("_d", (F.col("alarm_time") - F.col("change_time")).cast("double"))
    middle = quantiles(delays, [], "_d", {"median_delay": 0.5})
    bound = clopper_pearson("false_alarms", "null_streams", 0.95)
    return counts.withColumn("_b", bound).crossJoin(F.broadcast(middle)).select(  # one row each
        "null_streams", "false_alarms", (F.col("false_alarms") / F.col("null_streams")).alias("false_alarm_rate"),
        F.col("_b.upper").alias("false_alarm_upper"), "change_streams", (F.col("detections") / F.col("change_streams")).alias("detection_rate"),
        "early_alarms", "median_delay",
    )
