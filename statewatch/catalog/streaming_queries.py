"""The detectors on a stream of the events table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.detector_queries import BOX_REF, FROZEN, HIGH, LOW, REF, SIGNED, SR_BETS, sr_sql
from statewatch.catalog.registry import ORACLES, query
from statewatch.functions.learners import smoothing
from statewatch.operators.adaptive import topk_step
from statewatch.operators.sequences import chain_step
from statewatch.plans.durable import shared_folder
from statewatch.streaming import (
    box_kernel, contrast_kernel, counted, cusum_kernel, eprocess_kernel, factor_kernel, held, run_to_table, run_to_tables, simplex_kernel, sliding_kernel, sr_kernel,
    stream_detector,
)


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    s = F.least(F.greatest((F.col("value") - 50) / 200, F.lit(-1.0)), F.lit(1.0))
    kind = F.array(*[(F.col("event_type") == c).cast("double") for c in V.EVENT_TYPES])
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 99.0
    return rows.select("user_id", "ts", "event_id", s.alias("_s"), kind.alias("_x"), F.array(s, k).alias("_box"))


@query(
    "t06_bounded_sr_stream",
    V.sql(V.SCORE, sr_sql(SR_BETS), FROZEN, body="SELECT user_id, t, round(v, 9) AS stat, alarm_time IS NOT NULL AS alarm, alarm_time FROM fz"),
)
def sr_stream(spark, sf):
    step, start = sr_kernel(["user_id"], SR_BETS, threshold=60.0)
    out = stream_detector(
        event_stream(spark, sf), ["user_id"], "ts", ["ts", "event_id"], ["_s"], step, start,
        "user_id bigint, t bigint, stat double, alarm boolean, alarm_time bigint",
    )
    rows = run_to_table(out)
    return rows.withColumn("stat", V.r6(F.col("stat"), 9))


@query(
    "t15_eprocess_stream",
    V.sql(
        V.SCORE, sr_sql(SIGNED, "1.0 / 120"),
        """ev AS (SELECT user_id, t, (120 - t) / 120.0 + v AS v FROM sm)""",
        """fa AS (SELECT user_id, min(t) AS alarm_at FROM ev WHERE v >= 5 GROUP BY 1)""",
        body="SELECT user_id, t, round(v, 6) AS stat, coalesce(t >= alarm_at, false) AS alarm FROM ev LEFT JOIN fa USING (user_id)",
    ),
)
def eprocess_stream(spark, sf):
    step, start = eprocess_kernel(["user_id"], SIGNED, [0.25] * 4, 120, alpha=0.2)
    out = stream_detector(
        event_stream(spark, sf), ["user_id"], "ts", ["ts", "event_id"], ["_s"], step, start,
        "user_id bigint, t bigint, stat double, alarm boolean",
    )
    return run_to_table(out).withColumn("stat", V.r6(F.col("stat")))


@query(
    "t07_ratio_sr_stream",
    V.sql(
        V.SCORE,
        """bt(b) AS (VALUES (0.5::DOUBLE), (1.0::DOUBLE))""",
        """lg AS (SELECT user_id, t, b, b * s - b * b / 8 AS l, sum(b * s - b * b / 8) OVER (PARTITION BY user_id, b ORDER BY t) AS c FROM score, bt)""",
        """ac AS (SELECT user_id, t, b, exp(c) * sum(exp(l - c)) OVER (PARTITION BY user_id, b ORDER BY t) AS a FROM lg)""",
        """sm AS (SELECT user_id, t, avg(a) AS v FROM ac GROUP BY ALL)""",
        FROZEN,
        body="SELECT user_id, t, round(v, 5) AS stat, alarm_time FROM fz",
    ),
)
def ratio_stream(spark, sf):
    rows = event_stream(spark, sf).withColumn("_f", F.array(*[F.exp(b * F.col("_s") - b * b / 8) for b in (0.5, 1.0)]))
    step, start = factor_kernel(["user_id"], [0.5, 0.5], 60.0, True)
    out = stream_detector(rows, ["user_id"], "ts", ["ts", "event_id"], ["_f"], step, start, "user_id bigint, t bigint, stat double, alarm boolean, alarm_time bigint")
    return run_to_table(out).select("user_id", "t", V.r6(F.col("stat"), 5).alias("stat"), "alarm_time")


@query(
    "t16_sr_bank_stream",
    V.sql(
        V.SCORE, sr_sql(SIGNED),
        """fa AS (SELECT user_id, min(t) AS alarm_at FROM sm WHERE v >= 60 GROUP BY 1)""",
        body="SELECT user_id, t, round(v, 4) AS stat, coalesce(t >= alarm_at, false) AS alarm, CASE WHEN t >= alarm_at THEN alarm_at END AS alarm_time FROM sm LEFT JOIN fa USING (user_id)",
    ),
)
def bank_stream(spark, sf):
    rows = event_stream(spark, sf).withColumn("_f", F.array(*[1.0 + F.lit(float(b)) * F.col("_s") for b in SIGNED]))
    step, start = factor_kernel(["user_id"], [0.25] * 4, 60.0, False)
    out = stream_detector(rows, ["user_id"], "ts", ["ts", "event_id"], ["_f"], step, start, "user_id bigint, t bigint, stat double, alarm boolean, alarm_time bigint")
    return run_to_table(out).withColumn("stat", V.r6(F.col("stat"), 4))


@query(
    "t17_page_cusum_stream",
    V.sql(
        V.SCORE,
        """kp(kp) AS (VALUES (0.01), (0.05), (0.1))""",
        """ps AS (SELECT user_id, t, kp, sum(s - kp) OVER w AS pp, sum(-s - kp) OVER w AS pn FROM score, kp WINDOW w AS (PARTITION BY user_id, kp ORDER BY t))""",
        """mn AS (SELECT *, pp - least(0, min(pp) OVER w) AS sp, pn - least(0, min(pn) OVER w) AS sn FROM ps WINDOW w AS (PARTITION BY user_id, kp ORDER BY t))""",
        body="SELECT user_id, t, round(max(sp), 6) + 0.0 AS positive, round(max(sn), 6) + 0.0 AS negative, round(greatest(max(sp), max(sn)), 6) + 0.0 AS cusum FROM mn GROUP BY ALL",
    ),
)
def cusum_stream(spark, sf):
    step, start = cusum_kernel(["user_id"], (0.01, 0.05, 0.1))
    out = stream_detector(
        event_stream(spark, sf), ["user_id"], "ts", ["ts", "event_id"], ["_s"], step, start,
        "user_id bigint, t bigint, positive double, negative double, cusum double",
    )
    return run_to_table(out).select("user_id", "t", *[V.r6(F.col(c)).alias(c) for c in ("positive", "negative", "cusum")])


# ---------------------------------------------------------------- learned witnesses: the last rows of a key are its state


def rolling(spark, sf, kernel, columns, schema):
    step, start = kernel
    return run_to_table(stream_detector(event_stream(spark, sf), ["user_id"], "ts", ["ts", "event_id"], columns, step, start, "user_id bigint, t bigint, " + schema))


@query("t01_contrast_eprocess_stream", ORACLES["t01_contrast_eprocess"])
def contrast_stream(spark, sf):
    schema = "score double, contrast double, e_value double, p double, alarm boolean, rank int"
    out = rolling(spark, sf, contrast_kernel(["user_id"], np.diag(REF)), ["_x"], schema)
    return out.select("user_id", "t", *[V.r6(F.col(c)).alias(c) for c in ("score", "e_value", "p")], "alarm")


@query("t02_simplex_witness_stream", ORACLES["t02_simplex_witness"])
def simplex_stream(spark, sf):
    out = rolling(spark, sf, simplex_kernel(["user_id"], REF, window=16, every=4), ["_x"], "score double")
    return out.withColumn("score", V.r6(F.col("score")))


@query("t04_box_witness_stream", ORACLES["t04_box_witness"])
def box_stream(spark, sf):
    out = rolling(spark, sf, box_kernel(["user_id"], BOX_REF, LOW, HIGH, window=16, column="_box"), ["_box"], "score double")
    return out.withColumn("score", V.r6(F.col("score")))


@query("a06_sliding_state_stream", ORACLES["a06_sliding_state"])
def sliding_stream(spark, sf):
    out = rolling(spark, sf, sliding_kernel(["user_id"], 5, 16), ["_x"], "mass double, full boolean, acc array<double>")
    share = [V.r6(F.get("acc", F.lit(6 * i)) / F.col("mass")).alias(f"p{i}") for i in range(5)]
    return out.select("user_id", "t", "mass", "full", *share)


# ---------------------------------------------------------------- the batch steps of average and chain


@query("t12_ewma_topk_stream", ORACLES["t12_ewma_topk"])
def topk_stream(spark, sf):
    rows = event_stream(spark, sf).withColumn("_x", F.transform("_x", lambda v: v - 0.2))
    step, start = counted(topk_step(["user_id", "t"], smoothing(16.0), [1, 3]), np.zeros(5))
    out = run_to_table(stream_detector(rows, ["user_id"], "ts", ["ts", "event_id"], ["_x"], step, start, "user_id bigint, t bigint, scores array<double>"))
    return out.select("user_id", "t", *[V.r6(F.get("scores", F.lit(i))).alias(n) for i, n in enumerate(("k1", "k3"))])


@query("t08_chain_sr_stream", ORACLES["t08_chain_sr"])
def chain_stream(spark, sf):
    s = F.col("_s")
    rows = event_stream(spark, sf).withColumns({"_a": F.array(1 - 0.2 * s, 1 + 0.5 * s), "_b": F.array(1 - 0.3 * s, 1 + 0.7 * s)})
    mats = np.array([[[k + (1 - k) * 0.7, (1 - k) * 0.3], [(1 - k) * 0.7, k + (1 - k) * 0.3]] for k in (0.2, 0.6)])
    step, _, _ = chain_step(["user_id", "t"], mats, np.array([0.7, 0.3]), np.array([0.5, 0.5]))
    step, start = held(*counted(step, np.zeros(5)), 60.0)
    schema = "user_id bigint, t bigint, log_stat double, stat double, alarm boolean, alarm_time bigint"
    out = run_to_table(stream_detector(rows, ["user_id"], "ts", ["ts", "event_id"], ["_a", "_b"], step, start, schema))
    return out.select("user_id", "t", V.r6(F.col("stat"), 5).alias("stat"), "alarm_time")


# ---------------------------------------------------------------- late rows


# three deliveries by the day of the month, with every seventh event in the one after its own
DELIVERY = "least(2, (day(ts) - 1) // 10 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)"
DUE = "epoch_us(ts) // 1000 <= mark"


@query(
    "t06_bounded_sr_stream_late",
    V.sql(
        f"""dl AS (SELECT *, {DELIVERY} AS p FROM events)""",
        """mk AS (SELECT q.p, max(epoch_us(dl.ts)) // 1000 - 172800000 AS mark FROM (SELECT DISTINCT p FROM dl UNION SELECT 3) q JOIN dl ON dl.p < q.p GROUP BY 1)""",
        f"""al AS (SELECT dl.*, coalesce({DUE}, false) AS late FROM dl LEFT JOIN mk ON mk.p = dl.p)""",
        f"""score AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, least(greatest((value - 50) / 200, -1.0), 1.0) AS s
          FROM al, mk WHERE mk.p = 3 AND NOT late AND {DUE})""",
        sr_sql(SR_BETS), FROZEN,
        body="""SELECT user_id, n_late, coalesce(n_time, 0) AS n_time, alarm_time, stat FROM (SELECT user_id, count(*) FILTER (late) AS n_late FROM al GROUP BY 1)
        LEFT JOIN (SELECT user_id, max(t) AS n_time, max(alarm_time) AS alarm_time, round(arg_max(v, t), 9) AS stat FROM fz GROUP BY 1) USING (user_id)""",
    ),
)
def late_stream(spark, sf):
    """Deliveries two days out of order at most; what comes later is counted, and left out of the statistic."""
    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    events = V.events(spark, sf)
    delivery = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    step, start = sr_kernel(["user_id"], SR_BETS, threshold=60.0)
    for p in range(3):  # each delivery is a run of its own that goes on where the last one stopped
        events.where(delivery == p).write.parquet(f"{base}/in/events-{p}.parquet")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in/events-*.parquet")
        s = F.least(F.greatest((F.col("value") - 50) / 200, F.lit(-1.0)), F.lit(1.0))
        out = stream_detector(
            source.withColumn("_s", s), ["user_id"], "ts", ["ts", "event_id"], ["_s"], step, start,
            "user_id bigint, t bigint, stat double, alarm boolean, alarm_time bigint", delay="2 days", late=True,
        )
        timely, late = run_to_tables(out, f"{base}/out", f"{base}/checkpoint")
    last = timely.groupBy("user_id").agg(F.max("t").alias("n_time"), F.max("alarm_time").alias("alarm_time"), F.max_by("stat", "t").alias("stat"))
    n = events.select("user_id").distinct().join(late.groupBy("user_id").agg(F.count("*").alias("n_late")), "user_id", "left").join(last, "user_id", "left")
    zero = F.lit(0).cast("bigint")
    return n.select("user_id", F.coalesce("n_late", zero).alias("n_late"), F.coalesce("n_time", zero).alias("n_time"), "alarm_time", V.r6(F.col("stat"), 9).alias("stat"))


# ---------------------------------------------------------------- event-time windows in front of a detector


def window_sql(*views: str, body: str) -> str:
    """A detector over each user's mean scores by window, in the order of the windows' ends, of those that the last event closes."""
    last = next(i for i, v in enumerate(views) if v.startswith("wn AS")) + 1
    return V.sql(
        V.SCORE.replace("AS s FROM events", "AS s, ts FROM events"), *views[:last],
        """closed AS (SELECT user_id, e, avg(s) AS s FROM wn GROUP BY user_id, b, e HAVING e <= (SELECT max(ts) FROM events))""",
        """win AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY e) AS t, s FROM closed)""",
        *views[last:], body=body,
    )


WIN_SR = "SELECT user_id, t, round(v, 10) AS stat, alarm_time IS NOT NULL AS alarm, alarm_time FROM fz"
SR_SCHEMA = "user_id bigint, t bigint, stat double, alarm boolean, alarm_time bigint"


def windowed(spark, sf, window, step, start, schema):
    """Means by event-time window, then a detector: two stateful operators in one stream, the second on the time of the windows."""
    rows = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    means = rows.groupBy("user_id", window.alias("w")).agg(F.avg("_s").alias("_s"))
    # a new expression for the key, so that rows are exchanged again: a session store and the detector's cannot share a task
    user = F.col("user_id").cast("string").cast("bigint").alias("user_id")
    timed = means.select(user, F.window_time("w").alias("at"), "_s")
    return run_to_table(stream_detector(timed, ["user_id"], "at", ["at"], ["_s"], step, start, schema, delay=None))


@query(
    "t06_tumbling_window_stream",
    window_sql(
        """wn AS (SELECT user_id, s, date_trunc('day', ts) AS b, date_trunc('day', ts) + INTERVAL 1 DAY AS e FROM score)""",
        sr_sql(SR_BETS, source="win"), FROZEN, body=WIN_SR,
    ),
)
def tumbling_stream(spark, sf):
    step, start = sr_kernel(["user_id"], SR_BETS, threshold=60.0)
    return windowed(spark, sf, F.window("ts", "1 day"), step, start, SR_SCHEMA).withColumn("stat", V.r6(F.col("stat"), 10))


@query(
    "t06_sliding_window_stream",
    window_sql(
        """wn AS (SELECT user_id, s, date_trunc('day', ts) - to_days(CAST(i AS INT)) AS b, date_trunc('day', ts) - to_days(CAST(i AS INT)) + INTERVAL 3 DAY AS e FROM score, range(3) r(i))""",
        sr_sql(SR_BETS, source="win"), FROZEN, body=WIN_SR,
    ),
)
def sliding_window_stream(spark, sf):
    step, start = sr_kernel(["user_id"], SR_BETS, threshold=60.0)
    return windowed(spark, sf, F.window("ts", "3 days", "1 day"), step, start, SR_SCHEMA).withColumn("stat", V.r6(F.col("stat"), 10))


@query(
    "t17_session_window_stream",
    window_sql(
        """gp AS (SELECT user_id, s, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR AS apart FROM score)""",
        """ss AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM gp)""",
        """wn AS (SELECT user_id, s, b, max(ts) OVER (PARTITION BY user_id, b) + INTERVAL 12 HOUR AS e FROM ss)""",
        """kp(kp) AS (VALUES (0.01), (0.05), (0.1))""",
        """ps AS (SELECT user_id, t, kp, sum(s - kp) OVER w AS pp, sum(-s - kp) OVER w AS pn FROM win, kp WINDOW w AS (PARTITION BY user_id, kp ORDER BY t))""",
        """mn AS (SELECT *, pp - least(0, min(pp) OVER w) AS sp, pn - least(0, min(pn) OVER w) AS sn FROM ps WINDOW w AS (PARTITION BY user_id, kp ORDER BY t))""",
        body="SELECT user_id, t, round(max(sp), 10) + 0.0 AS positive, round(max(sn), 10) + 0.0 AS negative, round(greatest(max(sp), max(sn)), 10) + 0.0 AS cusum FROM mn GROUP BY ALL",
    ),
)
def session_stream(spark, sf):
    step, start = cusum_kernel(["user_id"], (0.01, 0.05, 0.1))
    out = windowed(spark, sf, F.session_window("ts", "12 hours"), step, start, "user_id bigint, t bigint, positive double, negative double, cusum double")
    return out.select("user_id", "t", *[V.r6(F.col(c), 10).alias(c) for c in ("positive", "negative", "cusum")])
