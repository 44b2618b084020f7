"""Alerts, thresholds, triage, delays and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.registry import query
from statewatch.operators import alerts as A
from statewatch.operators import delay as D
from statewatch.operators import evaluation as E

# role scores of a shot: events above the code's middle, scaled; method = a third of the users, whose shots are numbered through
SCORES = V.BITS + """, sc AS (SELECT CAST(user_id % 3 AS INT) AS method, dense_rank() OVER (PARTITION BY user_id % 3 ORDER BY user_id, shot) - 1 AS shot, role, (k * 37 % 100) / 100.0 AS score FROM bits)"""
MAXIMA = """mx AS (SELECT method, shot, max(score) AS maximum FROM sc GROUP BY ALL)"""
ALERTS = """al AS (SELECT method, shot, max(score) AS shot_score, arg_max(role, (score, -role)) AS score_role,
  coalesce(min(role) FILTER (WHERE score > 0.9), -1) AS first_role, max(score) > 0.9 AS alert FROM sc GROUP BY ALL)"""


def scores(spark, sf):
    s = F.pmod(F.col("k") * 37, F.lit(100)) / 100.0
    rows = V.bits(spark, sf).select(F.pmod("user_id", F.lit(3)).cast("int").alias("method"), "user_id", "shot", "role", s.alias("score"))
    return V.numbered_shots(rows, ["method"]).select("method", "shot", "role", "score")


@query(
    "r01_shot_alerts",
    V.sql(SCORES, ALERTS, body="SELECT method, shot, shot_score, CAST(score_role AS INT) AS score_role, CAST(first_role AS INT) AS first_role, alert FROM al"),
)
def shot_alerts(spark, sf):
    return A.shot_alerts(scores(spark, sf), 0.9, ["method"])


@query(
    "r02_select_threshold",
    V.sql(
        SCORES, MAXIMA,
        """t AS (SELECT method, maximum AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY maximum DESC) AS r FROM mx) WHERE r = 26)""",
        body="SELECT method, threshold, count(*) FILTER (WHERE maximum > threshold) AS alert_count FROM t JOIN mx USING (method) GROUP BY ALL",
    ),
)
def select_threshold(spark, sf):
    return A.select_threshold(scores(spark, sf), 25, ["method"])


@query(
    "r03_frontier",
    V.sql(
        SCORES, MAXIMA,
        """cd AS (SELECT DISTINCT method, score AS candidate FROM sc UNION SELECT DISTINCT method, CAST('-inf' AS DOUBLE) FROM sc UNION SELECT DISTINCT method, CAST('inf' AS DOUBLE) FROM sc)""",
        body="""SELECT cd.method, CASE WHEN candidate = 'inf'::DOUBLE THEN 2.0 WHEN candidate = '-inf'::DOUBLE THEN -2.0 ELSE candidate END AS candidate,
        count(*) FILTER (WHERE maximum > candidate) AS alerts FROM cd JOIN mx USING (method) GROUP BY ALL""",
    ),
)
def frontier(spark, sf):
    out = A.frontier(scores(spark, sf), ["method"])
    inf = float("inf")
    c = F.when(F.col("candidate") == inf, 2.0).when(F.col("candidate") == -inf, -2.0).otherwise(F.col("candidate"))
    return out.withColumn("candidate", c)


@query(
    "r04_shot_report",
    V.sql(
        SCORES, ALERTS,
        body="""SELECT method, shot, shot_score, alert, CAST(sum(CAST(alert AS INT)) OVER (PARTITION BY method ORDER BY shot) AS BIGINT) AS cumulative,
        row_number() OVER (PARTITION BY method ORDER BY shot_score DESC, shot) AS rank,
        CAST(shot >= 200 AND shot < 600 AS INT) AS in_primary, CAST(shot >= 300 AND shot < 400 AS INT) AS in_narrow FROM al""",
    ),
)
def shot_report(spark, sf):
    out = A.shot_report(scores(spark, sf), 0.9, {"primary": (200, 600), "narrow": (300, 400)}, ["method"])
    return out.select("method", "shot", "shot_score", "alert", "cumulative", "rank", "in_primary", "in_narrow")


@query(
    "r05_event_summary",
    V.sql(
        SCORES, ALERTS,
        """w("window", a, b) AS (VALUES ('primary', 200, 600), ('narrow', 300, 310), ('empty', 1000000000000, 1000000000001))""",
        body="""SELECT method, "window", (SELECT count(*) FROM al x WHERE x.method = al.method AND x.alert AND x.shot < 200) AS pre_alerts,
        count(*) FILTER (WHERE alert AND shot >= a AND shot < b) > 0 AS detected, min(shot) FILTER (WHERE alert AND shot >= a AND shot < b) AS first_shot,
        CAST(arg_min(first_role, shot) FILTER (WHERE alert AND shot >= a AND shot < b) AS INT) AS first_role FROM al CROSS JOIN w GROUP BY ALL""",
    ),
)
def event_summary(spark, sf):
    alerts = A.shot_alerts(scores(spark, sf), 0.9, ["method"])
    return A.event_summary(alerts, {"primary": (200, 600), "narrow": (300, 310), "empty": (10**12, 10**12 + 1)}, "primary", ["method"])


@query(
    "r06_join_outcomes",
    V.sql(V.OUTCOMES, body="SELECT doc_id, score, CAST(xor(quality, toxic) AS INT) AS mismatch FROM outcomes"),
)
def join_outcomes(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return A.join_outcomes(docs, V.table(spark, sf, "labels"), ["doc_id"], "quality", "toxic")


@query(
    "r07_risk_at_budget",
    V.sql(
        V.OUTCOMES,
        """rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM outcomes)""",
        """b(budget) AS (VALUES (5), (10), (20), (40))""",
        """c AS (SELECT CAST(budget AS INT) AS budget, CAST(sum(toxic) FILTER (WHERE r <= budget) AS BIGINT) AS captured, CAST(sum(toxic) AS BIGINT) AS positives, count(*) AS n FROM rk, b GROUP BY budget)""",
        """ar AS (SELECT sum((c2.captured + c1.captured) * 0.5 / c1.positives * (c2.budget - c1.budget) * 1.0 / c1.n) AS area FROM c c1 JOIN c c2 ON c2.budget = 2 * c1.budget)""",
        body="""SELECT budget, captured, positives, round(captured * 1.0 / positives, 6) AS recall, round(captured * 1.0 / budget, 6) AS "precision",
        round((positives - captured) * 1.0 / (n - budget), 6) AS retained_rate, round(1 - budget * 1.0 / n, 6) AS coverage, round(area, 8) AS area FROM c, ar""",
    ),
)
def risk(spark, sf):
    out = A.risk_at_budget(V.outcomes(spark, sf), "toxic", "doc_id", [5, 10, 20, 40])
    rounded = [V.r6(F.col(c)).alias(c) for c in ("recall", "precision", "retained_rate", "coverage")]
    return out.select("budget", "captured", "positives", *rounded, V.r6(F.col("area"), 8).alias("area"))


# one simulated-free alarm table from orders: alarm = days into the year scaled, change at 60
ALARMS = """alm AS (SELECT c_mktsegment AS family, 0.5 AS effect, o_orderpriority AS method, o_orderkey AS replicate, o_orderkey AS seed,
  CASE o_orderkey % 3 WHEN 0 THEN 'null_arl' WHEN 1 THEN 'surveillance' ELSE 'restart_at_change' END AS evaluation,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 60 ELSE 0 END AS change_time,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(dayofyear(o_orderdate) AS INT) END AS alarm_time
  FROM orders JOIN customer ON o_custkey = c_custkey),
dr AS (SELECT *, CASE WHEN change_time IS NULL THEN alarm_time IS NOT NULL ELSE coalesce(alarm_time <= change_time, false) END AS false_alarm FROM alm),
d2 AS (SELECT *, change_time IS NULL OR NOT false_alarm AS eligible FROM dr),
d3 AS (SELECT *, change_time IS NOT NULL AND eligible AND alarm_time IS NOT NULL AS detected FROM d2),
rows_ AS (SELECT *, CASE WHEN change_time IS NULL THEN alarm_time IS NULL ELSE eligible AND NOT detected END AS censored,
  2 * coalesce(alarm_time, CASE WHEN change_time IS NULL THEN 256 ELSE change_time + 256 END) AS run_length,
  2 * CASE WHEN change_time IS NULL OR NOT eligible THEN NULL WHEN detected THEN least(256, alarm_time - change_time) ELSE 256 END AS delay FROM d3)"""


def alarms(spark, sf):
    orders = V.table(spark, sf, "orders").join(
        V.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    m = F.pmod("o_orderkey", F.lit(3))
    return orders.select(
        F.col("c_mktsegment").alias("family"), F.lit(0.5).alias("effect"), F.col("o_orderpriority").alias("method"),
        F.col("o_orderkey").alias("replicate"), F.col("o_orderkey").alias("seed"),
        F.when(m == 0, "null_arl").when(m == 1, "surveillance").otherwise("restart_at_change").alias("evaluation"),
        F.when(m == 1, 60).when(m == 2, 0).alias("change_time"),
        F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.dayofyear("o_orderdate")).alias("alarm_time"),
    )


@query(
    "r08_delay_rows",
    V.sql(
        ALARMS,
        body="""SELECT replicate, evaluation, false_alarm, eligible, detected, censored, CAST(run_length AS INT) AS run_length, CAST(delay AS INT) AS delay FROM rows_""",
    ),
)
def delay_rows(spark, sf):
    out = D.delay_rows(alarms(spark, sf), 256, 2)
    return out.select("replicate", "evaluation", "false_alarm", "eligible", "detected", "censored", "run_length", "delay")


@query(
    "r09_delay_summary",
    V.sql(
        ALARMS,
        """re AS (SELECT family, method, avg(delay) AS mean_delay, quantile_cont(delay, 0.5) AS median_delay, quantile_cont(delay, 0.25) AS delay_q1,
          quantile_cont(delay, 0.75) AS delay_q3, avg(CAST(coalesce(delay <= 64, false) AS INT)) AS within_64, avg(CAST(coalesce(delay <= 128, false) AS INT)) AS within_128,
          avg(CAST(censored AS INT)) AS miss_share, count(*) AS replicates FROM rows_ WHERE evaluation = 'restart_at_change' GROUP BY ALL)""",
        """su AS (SELECT family, method, avg(CAST(false_alarm AS INT)) AS false_alarm_share, avg(delay) FILTER (WHERE eligible) AS survivor_mean_delay,
          quantile_cont(delay, 0.5) FILTER (WHERE eligible) AS survivor_median_delay, count(*) FILTER (WHERE eligible) AS survivors FROM rows_ WHERE evaluation = 'surveillance' GROUP BY ALL)""",
        """nu AS (SELECT family, method, avg(run_length) AS mean_run_length, avg(least(512.0, coalesce(alarm_time * 2.0, 512.0))) AS no_change_length FROM rows_ WHERE evaluation = 'null_arl' GROUP BY ALL)""",
        body="""SELECT family, method, replicates, survivors, round(mean_delay, 4) AS mean_delay, median_delay, delay_q1, delay_q3, round(within_64, 6) AS within_64,
        round(within_128, 6) AS within_128, round(miss_share, 6) AS miss_share, round(false_alarm_share, 6) AS false_alarm_share, round(survivor_mean_delay, 4) AS survivor_mean_delay,
        survivor_median_delay, round(mean_run_length, 4) AS mean_run_length, round(no_change_length - mean_delay, 4) AS reduction, round(mean_delay / no_change_length, 6) AS ratio
        FROM re LEFT JOIN su USING (family, method) LEFT JOIN nu USING (family, method)""",
    ),
)
def delay_summary(spark, sf):
    out = D.delay_summary(D.delay_rows(alarms(spark, sf), 256, 2))
    four = [V.r6(F.col(c), 4).alias(c) for c in ("mean_delay", "survivor_mean_delay", "mean_run_length", "reduction")]
    six = [V.r6(F.col(c)).alias(c) for c in ("within_64", "within_128", "miss_share", "false_alarm_share", "ratio")]
    return out.select("family", "method", "replicates", "survivors", "median_delay", "delay_q1", "delay_q3", "survivor_median_delay", *four, *six)


@query(
    "r10_stream_endpoint",
    V.sql(
        V.SCORE,
        """e AS (SELECT user_id, min(t - 1) FILTER (WHERE s >= 0.9) AS first_alarm FROM score GROUP BY 1)""",
        body="""SELECT user_id, first_alarm, CAST(coalesce(first_alarm < 20, false) AS INT) AS pre_alarm, CAST(first_alarm IS NULL AS INT) AS miss,
        CASE WHEN first_alarm >= 20 THEN first_alarm - 20 END AS post_alarm, CASE WHEN first_alarm >= 20 THEN round((first_alarm - 19) / 50.0, 6) ELSE 1.0 END AS delay FROM e""",
    ),
)
def endpoint(spark, sf):
    from statewatch.plans import place

    rows = place(V.score(spark, sf), ["user_id"], ["ts", "event_id"]).rows().withColumn("t", F.col("t") - 1)
    out = A.stream_endpoint(rows, ["user_id"], "t", "s", 0.9, 20, 50)
    return out.withColumn("delay", V.r6(F.col("delay")))


# cohorts x states x methods from orders: averages play the role of endpoints
COHORT = """co AS (SELECT c_mktsegment AS cohort, o_orderstatus AS state, o_orderpriority AS method, CAST(count(*) % 2 AS INT) AS pre_alarm,
  CAST(count(*) % 5 = 0 AS INT) AS miss, avg(o_totalprice) / 1e6 AS delay FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
pc AS (SELECT cohort, method, avg(delay) AS d, sum(pre_alarm) AS p, sum(miss) AS m FROM co GROUP BY ALL),
ma AS (SELECT method, CAST(sum(p) AS BIGINT) AS pre_alarms, CAST(sum(m) AS BIGINT) AS misses, avg(d) AS macro_delay FROM pc GROUP BY ALL)"""


def cohort_rows(spark, sf):
    orders = V.table(spark, sf, "orders").join(
        V.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    n = F.count(F.lit(1))
    return orders.groupBy(F.col("c_mktsegment").alias("cohort"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("method")).agg(
        F.pmod(n, F.lit(2)).cast("int").alias("pre_alarm"), (F.pmod(n, F.lit(5)) == 0).cast("int").alias("miss"), (F.avg("o_totalprice") / 1e6).alias("delay")
    )


def macro(spark, sf):
    rows = cohort_rows(spark, sf)
    names = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in ("cohort", "state", "method")}
    return A.cohort_summary(rows, names["cohort"], names["state"], names["method"])[1]


@query("r11_cohort_summary", V.sql(COHORT, body="SELECT method, pre_alarms, misses, round(macro_delay, 7) AS macro_delay FROM ma"))
def cohorts(spark, sf):
    return macro(spark, sf).withColumn("macro_delay", V.r6(F.col("macro_delay"), 7))


@query(
    "r12_retention",
    V.sql(
        COHORT,
        """cmp AS (SELECT o.method AS comparator, t.macro_delay - o.macro_delay AS dd, t.pre_alarms <= o.pre_alarms AS no_worse, t.macro_delay < o.macro_delay AS lower
          FROM ma t, ma o WHERE t.method = '1-URGENT' AND o.method IN ('2-HIGH', '5-LOW'))""",
        body="""SELECT comparator, round(dd, 7) AS delay_difference, no_worse AS no_worse_pre_alarms, lower AS lower_delay, no_worse AND lower AS passes,
        bool_and(no_worse AND lower) OVER () AS retained FROM cmp""",
    ),
)
def retained(spark, sf):
    out = A.retention(macro(spark, sf), "1-URGENT", ["2-HIGH", "5-LOW"])
    return out.withColumn("delay_difference", V.r6(F.col("delay_difference"), 7))


@query(
    "r12_predicates",
    """WITH f AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS bad, max(quality) AS top FROM labels),
    p AS (SELECT unnest(['enough_rows', 'few_toxic', 'some_good', 'none_missing']) AS predicate, unnest([n >= 100, bad * 2 < n, top = 1, n < 0]) AS holds FROM f)
    SELECT predicate, holds, bool_and(holds) OVER () AS all_hold FROM p""",
)
def predicates(spark, sf):
    """Facts of the labelled rows; the last rule fails, so not all hold."""
    facts = V.table(spark, sf, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"), F.max("quality").alias("top"))
    n = F.col("n")
    return A.predicates(facts, {"enough_rows": n >= 100, "few_toxic": F.col("bad") * 2 < n, "some_good": F.col("top") == 1, "none_missing": n < 0})


@query(
    "r13_select_best",
    """WITH g AS (SELECT c_mktsegment AS segment, c_nationkey AS parameter, round(avg(c_acctbal), 4) AS metric FROM customer GROUP BY ALL)
    SELECT segment, parameter, metric FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY metric, parameter) AS r FROM g) WHERE r = 1""",
)
def best(spark, sf):
    rows = V.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("parameter"))
    return E.select_best(rows.agg(V.r6(F.avg("c_acctbal"), 4).alias("metric")), ["segment"], "metric", "parameter")


@query(
    "r14_best_threshold",
    V.sql(
        V.OUTCOMES,
        """th AS (SELECT DISTINCT score AS threshold FROM outcomes)""",
        """ba AS (SELECT threshold, 0.5 * (count(*) FILTER (WHERE quality = 1 AND score >= threshold) * 1.0 / count(*) FILTER (WHERE quality = 1) + 1
          - count(*) FILTER (WHERE quality = 0 AND score >= threshold) * 1.0 / count(*) FILTER (WHERE quality = 0)) AS b FROM th, outcomes GROUP BY 1)""",
        body="""SELECT threshold, round(b, 8) AS balanced_accuracy FROM ba WHERE round(b, 12) = (SELECT max(round(b, 12)) FROM ba) ORDER BY threshold DESC LIMIT 1""",
    ),
)
def threshold(spark, sf):
    out = E.best_threshold(V.outcomes(spark, sf), "quality", "score")
    return out.withColumn("balanced_accuracy", V.r6(F.col("balanced_accuracy"), 8))


@query(
    "r15_evaluate",
    V.sql(
        V.OUTCOMES,
        """pr AS (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM outcomes a, outcomes b WHERE a.toxic = 1 AND b.toxic = 0)""",
        """c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND score >= 1500) AS tp, count(*) FILTER (WHERE toxic = 1 AND score < 1500) AS fn,
          count(*) FILTER (WHERE toxic = 0 AND score >= 1500) AS fp, count(*) FILTER (WHERE toxic = 0 AND score < 1500) AS tn FROM outcomes)""",
        body="""SELECT tp, fn, fp, tn, round(tp * 1.0 / (tp + fn), 6) AS tpr, round(tn * 1.0 / (tn + fp), 6) AS tnr, round(0.5 * (tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)), 6) AS balanced_accuracy,
        round(auc, 8) AS auc FROM c, pr""",
    ),
)
def evaluate(spark, sf):
    out = E.evaluate(V.outcomes(spark, sf), "toxic", "score", 1500)
    return out.select("tp", "fn", "fp", "tn", *[V.r6(F.col(c)).alias(c) for c in ("tpr", "tnr", "balanced_accuracy")], V.r6(F.col("auc"), 8).alias("auc"))


@query(
    "r16_evaluate_multiclass",
    """WITH t AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 15 THEN 'N' ELSE 'R' END AS p FROM lineitem),
    c AS (SELECT y AS k, count(*) AS n, count(*) FILTER (WHERE y = p) AS h FROM t GROUP BY y), s AS (SELECT p AS k, count(*) AS m FROM t GROUP BY p)
    SELECT round(sum(h) * 1.0 / sum(n), 8) AS accuracy, round(avg(h * 1.0 / n), 8) AS balanced_accuracy, round(avg(2.0 * h / (n + m)), 8) AS macro_f1 FROM c JOIN s USING (k)""",
)
def multiclass(spark, sf):
    said = F.when(F.col("l_quantity") > 30, "A").when(F.col("l_quantity") > 15, "N").otherwise("R")
    out = E.evaluate_multiclass(V.table(spark, sf, "lineitem").withColumn("p", said), "l_returnflag", "p")
    return out.select(*[V.r6(F.col(c), 8).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


# fold records: segment = dataset, year = repeat, quarter = fold, priority = method
FOLDS = """fo AS (SELECT c_mktsegment AS dataset, CAST(year(o_orderdate) AS INT) AS repeat, CAST(quarter(o_orderdate) AS INT) AS fold, o_orderpriority AS method,
  round(avg(o_totalprice) / 1e6, 3) AS accuracy FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def fold_records(spark, sf):
    orders = V.table(spark, sf, "orders").join(
        V.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    return orders.groupBy(
        F.col("c_mktsegment").alias("dataset"), F.year("o_orderdate").alias("repeat"), F.quarter("o_orderdate").alias("fold"), F.col("o_orderpriority").alias("method")
    ).agg(V.r6(F.avg("o_totalprice") / 1e6, 3).alias("accuracy"))


@query(
    "r17_fold_summary",
    V.sql(FOLDS, body="""SELECT dataset, method, round(avg(accuracy), 7) AS mean, round(stddev_samp(accuracy), 7) AS std, round(median(accuracy), 7) AS median, count(*) AS folds FROM fo GROUP BY ALL"""),
)
def fold_summary(spark, sf):
    out = E.summarize_folds(fold_records(spark, sf))[0]
    return out.select("dataset", "method", "folds", *[V.r6(F.col(c), 7).alias(c) for c in ("mean", "std", "median")])


@query(
    "r17_method_ranks",
    V.sql(
        FOLDS,
        """rk AS (SELECT *, rank() OVER (PARTITION BY dataset, repeat, fold ORDER BY accuracy DESC) + (count(*) OVER (PARTITION BY dataset, repeat, fold, accuracy) - 1) / 2.0 AS r FROM fo)""",
        body="SELECT method, round(avg(r), 7) AS mean_rank, round(avg(accuracy), 7) AS mean FROM rk GROUP BY method",
    ),
)
def method_ranks(spark, sf):
    out = E.summarize_folds(fold_records(spark, sf))[1]
    return out.select("method", V.r6(F.col("mean_rank"), 7).alias("mean_rank"), V.r6(F.col("mean"), 7).alias("mean"))


@query(
    "r18_pivot_metric",
    V.sql(
        FOLDS,
        body="""SELECT dataset, round(avg(accuracy) FILTER (WHERE method = '1-URGENT'), 7) AS urgent, round(avg(accuracy) FILTER (WHERE method = '5-LOW'), 7) AS low FROM fo GROUP BY dataset""",
    ),
)
def pivoted(spark, sf):
    out = E.pivot_metric(fold_records(spark, sf), "dataset", "method", ["1-URGENT", "5-LOW"], "accuracy")
    return out.select("dataset", V.r6(F.col("1-URGENT"), 7).alias("urgent"), V.r6(F.col("5-LOW"), 7).alias("low"))


@query(
    "r19_estimator_errors",
    V.sql(
        V.BITS_LONG,
        """o AS (SELECT user_id % 2 AS g, user_id, chk, bit, row_number() OVER (PARTITION BY user_id, chk ORDER BY shot, role) AS t FROM bits_long)""",
        """b(budget) AS (VALUES (10), (40))""",
        """m AS (SELECT g, user_id, chk, budget, avg(bit) - 0.5 AS e FROM o, b WHERE t <= budget GROUP BY ALL HAVING count(*) = budget)""",
        """r AS (SELECT g, user_id, budget, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e) AS bias, max(abs(e)) AS mx FROM m GROUP BY ALL)""",
        body="""SELECT CAST(g AS INT) AS g, CAST(budget AS INT) AS budget, round(avg(rmse), 8) AS mean_rmse, round(stddev_samp(rmse), 8) AS std_rmse, round(avg(mae), 8) AS mean_mae, round(avg(mx), 8) AS mean_max_error,
        round(avg(bias), 8) + 0.0 AS mean_bias, round(1.96 * stddev_samp(rmse) / sqrt(count(*)), 8) AS half_width FROM r GROUP BY ALL""",
    ),
)
def errors(spark, sf):
    rows = V.bits_long(spark, sf).select(
        F.pmod("user_id", F.lit(2)).cast("int").alias("g"), "user_id", "chk", (F.col("shot") * 5 + F.col("role")).alias("i"), "bit"
    )
    expected = spark.createDataFrame([(c, 0.5) for c in range(7)], "chk int, p double")
    _, rolled = E.estimator_errors(rows, expected, [10, 40], ["g"], "user_id", "i", "chk", "bit")
    return rolled.select("g", "budget", *[V.r6(F.col(c), 8).alias(c) for c in rolled.columns if c not in ("g", "budget")])


@query(
    "r20_resource_counts",
    V.sql(
        V.PAIRS,
        body="""SELECT user_id, count(DISTINCT pair) AS paired_shots, 2 * count(DISTINCT pair) AS physical_shots, count(*) AS role_updates, 14 * count(*) AS bits_exposed FROM pairs GROUP BY user_id""",
    ),
)
def resources(spark, sf):
    return A.resource_counts(V.pairs(spark, sf), ["pair"], 7, ["user_id"])


@query(
    "r21_alarm_summary",
    V.sql(
        ALARMS,
        """ag AS (SELECT count(*) FILTER (WHERE change_time IS NULL) AS n0, count(*) FILTER (WHERE change_time IS NULL AND alarm_time IS NOT NULL) AS k0,
          count(*) FILTER (WHERE change_time IS NOT NULL) AS n1, count(*) FILTER (WHERE alarm_time > change_time) AS k1, count(*) FILTER (WHERE alarm_time <= change_time) AS early,
          CAST(median(alarm_time - change_time) FILTER (WHERE alarm_time > change_time) AS DOUBLE) AS middle FROM alm)""",
        V.clopper_sql("ag", "k0", "n0", "n1, k1, early, middle"),
        body="""SELECT n AS null_streams, k AS false_alarms, round(k * 1.0 / n, 8) AS false_alarm_rate, round(high, 7) AS false_alarm_upper, n1 AS change_streams,
        round(k1 * 1.0 / n1, 8) AS detection_rate, early AS early_alarms, middle AS median_delay FROM bi""",
    ),
)
def alarm_summary(spark, sf):
    regime = F.when(F.col("evaluation") == "null_arl", "null").otherwise("change").alias("regime")
    runs = alarms(spark, sf).select(regime, "change_time", "alarm_time")
    out = D.alarm_summary(runs)
    rounded = {"false_alarm_rate": 8, "false_alarm_upper": 7, "detection_rate": 8}
    return out.withColumns({n: V.r6(F.col(n), d) for n, d in rounded.items()})


