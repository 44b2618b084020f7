"""Intervals, tests and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.alert_queries import ALARMS, FOLDS, alarms, fold_records
from statewatch.catalog.registry import query
from statewatch.operators import bootstrap as R
from statewatch.operators import inference as I
from statewatch.operators.delay import delay_rows
from statewatch.plans import place


@query(
    "i01_wilson_interval",
    """WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS k FROM events GROUP BY 1),
    w AS (SELECT *, 1.959963984540054 AS z, k * 1.0 / n AS p FROM c)
    SELECT event_type, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 8) AS lower,
      round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 8) AS upper FROM w""",
)
def wilson(spark, sf):
    out = counts(spark, sf).withColumn("i", I.wilson("k", "n"))
    return out.select("event_type", "k", "n", V.r6(F.col("i.lower"), 8).alias("lower"), V.r6(F.col("i.upper"), 8).alias("upper"))


def counts(spark, sf):
    return V.events(spark, sf).groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count(F.lit(1)).alias("n"))


@query(
    "i01_clopper_pearson",
    f"""WITH RECURSIVE c AS (SELECT event_type, count(*) FILTER (WHERE value > 100) AS k, count(*) AS n FROM events GROUP BY 1),
    {V.clopper_sql("c", "k", "n", "event_type")} SELECT event_type, k, n, round(low, 7) AS lower, round(high, 7) AS upper FROM bi""",
)
def clopper(spark, sf):
    out = counts(spark, sf).withColumn("i", I.clopper_pearson("k", "n"))
    return out.select("event_type", "k", "n", V.r6(F.col("i.lower"), 7).alias("lower"), V.r6(F.col("i.upper"), 7).alias("upper"))


N_DOCS = "(SELECT count(*) FROM outcomes)"
INDEX = f"""ix AS (SELECT r AS replicate, b * 16 + o AS position, ((r * 7919 + b * 104729) % {N_DOCS} + o) % {N_DOCS} AS "index"
  FROM range(40) q(r), range(CAST(ceil({N_DOCS} / 16.0) AS BIGINT)) w(b), range(16) z(o) WHERE b * 16 + o < {N_DOCS})"""
NUMBERED = """nd AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS "index" FROM outcomes)"""


def numbered(spark, sf):
    placed = place(V.outcomes(spark, sf), [], ["doc_id"], "_i").rows()
    return placed.withColumn("index", F.col("_i") - 1).drop("_i")


def doc_indices(spark, n):
    return R.circular_blocks(spark, n, n, 16, 40, start=lambda r, b: F.pmod(r * 7919 + b.cast("bigint") * 104729, F.lit(n)))


@query(
    "i02_circular_blocks",
    V.sql(V.OUTCOMES, INDEX, body="""SELECT replicate, "index", count(*) AS copies FROM ix GROUP BY ALL"""),
)
def blocks(spark, sf):
    return R.draw_counts(doc_indices(spark, V.outcomes(spark, sf).count()))


@query("i02_hashed_blocks")
def hashed_blocks(spark, sf):
    n = V.outcomes(spark, sf).count()
    return R.draw_counts(R.circular_blocks(spark, n, n, 16, 20, seed=5))


# two methods rank the same documents; a replicate repeats documents, ties keep frozen rank
RISK = """ms AS (SELECT 'length' AS method, doc_id, "index", score, toxic FROM nd UNION ALL SELECT 'mixed', doc_id, "index", (doc_id * 7919) % 1009, toxic FROM nd),
rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, doc_id) AS rnk FROM ms),
ex AS (SELECT method, replicate, toxic, row_number() OVER (PARTITION BY method, replicate ORDER BY rnk, position) AS r FROM rk JOIN ix USING ("index")),
est AS (SELECT method, replicate, budget, sum(toxic) FILTER (WHERE r <= budget) AS captured, sum(toxic) AS positives, count(*) AS n FROM ex, (VALUES (10), (25)) b(budget) GROUP BY ALL)"""


def risk_estimates(spark, sf):
    docs = numbered(spark, sf)
    first = docs.select(F.lit("length").alias("method"), F.col("doc_id").alias("id"), "index", "score", F.col("toxic").alias("label"))
    mixed = F.pmod(F.col("doc_id") * 7919, F.lit(1009)).cast("double")
    second = docs.select(F.lit("mixed").alias("method"), F.col("doc_id").alias("id"), "index", mixed.alias("score"), F.col("toxic").alias("label"))
    return R.bootstrap_risk(first.unionByName(second), doc_indices(spark, docs.count()), [10, 25])


@query(
    "i03_bootstrap_risk",
    V.sql(
        V.OUTCOMES, NUMBERED, INDEX, RISK,
        body="""SELECT method, replicate, CAST(budget AS INT) AS budget, CAST(captured AS BIGINT) AS captured, round(captured * 1.0 / positives, 6) AS recall,
        round((positives - captured) * 1.0 / (n - budget), 6) AS retained_rate FROM est""",
    ),
)
def bootstrap_risk(spark, sf):
    out = risk_estimates(spark, sf)
    return out.select("method", "replicate", "budget", "captured", V.r6(F.col("recall")).alias("recall"), V.r6(F.col("retained_rate")).alias("retained_rate"))


@query(
    "i03_risk_intervals",
    V.sql(
        V.OUTCOMES, NUMBERED, INDEX, RISK,
        body="""SELECT method, CAST(budget AS INT) AS budget, round(quantile_cont(captured * 1.0 / positives, 0.025), 6) AS lower, round(quantile_cont(captured * 1.0 / positives, 0.975), 6) AS upper, count(*) AS "valid" FROM est GROUP BY ALL""",
    ),
)
def risk_intervals(spark, sf):
    out = R.risk_intervals(risk_estimates(spark, sf), "recall")
    return out.select("method", "budget", "valid", V.r6(F.col("lower")).alias("lower"), V.r6(F.col("upper")).alias("upper"))


@query(
    "i03_risk_differences",
    V.sql(
        V.OUTCOMES, NUMBERED, INDEX, RISK,
        body="""SELECT 'length' AS method, CAST(a.budget AS INT) AS budget, round(quantile_cont(CAST(a.captured - b.captured AS DOUBLE), 0.025), 6) AS lower,
        round(quantile_cont(CAST(a.captured - b.captured AS DOUBLE), 0.975), 6) AS upper FROM est a JOIN est b USING (replicate, budget) WHERE a.method = 'mixed' AND b.method = 'length' GROUP BY a.budget""",
    ),
)
def risk_differences(spark, sf):
    out = R.risk_differences(risk_estimates(spark, sf), "captured", "mixed", ["length"])
    return out.select("method", "budget", V.r6(F.col("lower")).alias("lower"), V.r6(F.col("upper")).alias("upper"))


@query(
    "i04_bootstrap_threshold",
    V.sql(
        V.OUTCOMES, NUMBERED, INDEX,
        """mv AS (SELECT replicate, score FROM nd JOIN ix USING ("index"))""",
        """th AS (SELECT replicate, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY score DESC) AS r FROM mv) WHERE r = 8)""",
        body="""SELECT replicate, threshold, count(*) FILTER (WHERE score > threshold) AS alert_count, count(*) FILTER (WHERE score > 3000) AS frozen_count, max(score) AS zero_alert_threshold
        FROM mv JOIN th USING (replicate) GROUP BY replicate, threshold""",
    ),
)
def bootstrap_threshold(spark, sf):
    docs = numbered(spark, sf)
    maxima = docs.select(F.lit("length").alias("method"), "index", F.col("score").alias("maximum"))
    return R.bootstrap_threshold(maxima, doc_indices(spark, docs.count()), 7, {"length": 3000.0}).drop("method")


@query(
    "i05_order_threshold",
    V.sql(
        V.SCORE,
        """mx AS (SELECT user_id, max(s) AS m FROM score GROUP BY 1)""",
        """rk AS (SELECT m, row_number() OVER (ORDER BY m) AS r, count(*) OVER () AS n FROM mx)""",
        body="""SELECT n AS replicates, m AS threshold FROM rk WHERE r = least(CAST(ceil((n + 1) * 0.9) AS BIGINT), n)""",
    ),
)
def order_threshold(spark, sf):
    maxima = V.score(spark, sf).groupBy("user_id").agg(F.max("s").alias("m"))
    return R.order_threshold(maxima, "m", 0.1)


SPEND = """od AS (SELECT o_orderstatus AS k, o_totalprice / 1e6 - 0.25 AS d, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS "index" FROM orders)"""


def spend(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("k"), (F.col("o_totalprice") / 1e6 - 0.25).alias("d"), "o_custkey", "o_orderkey"
    )
    placed = place(rows, ["k"], ["o_orderkey"], "_i").rows()
    return placed.withColumn("index", F.col("_i") - 1).drop("_i")


@query(
    "i07_paired_bootstrap",
    V.sql(
        SPEND,
        """cn AS (SELECT k, count(*) AS n FROM od GROUP BY k)""",
        """dr AS (SELECT k, r AS replicate, (r * 7919 + "index" * "index" * 31 + "index" * r * 13) % n AS "index" FROM od JOIN cn USING (k), range(50) q(r))""",
        """me AS (SELECT k, replicate, avg(d) AS m FROM od JOIN dr USING (k, "index") GROUP BY ALL)""",
        """ob AS (SELECT k, avg(d) AS mean, count(*) AS n FROM od GROUP BY k)""",
        body="""SELECT k, n, round(mean, 7) + 0.0 AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS lower, round(quantile_cont(m, 0.975), 6) + 0.0 AS upper FROM me JOIN ob USING (k) GROUP BY ALL""",
    ),
)
def paired_bootstrap(spark, sf):
    rows = spend(spark, sf)
    draws = R.draws_per_row(rows, ["k"], 50, draw=lambda r, p, n: F.pmod(r * 7919 + p * p * 31 + p * r * 13, n))
    out = R.paired_bootstrap(rows, "d", draws, ["k"])
    return out.select("k", "n", V.r6(F.col("mean"), 7).alias("mean"), V.r6(F.col("lower")).alias("lower"), V.r6(F.col("upper")).alias("upper"))


@query(
    "i08_discordance",
    """SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS both_right, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_b,
      count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both_wrong,
      count(*) AS n, round((count(*) FILTER (WHERE quality = 1 AND toxic = 0) - count(*) FILTER (WHERE quality = 0 AND toxic = 1)) * 1.0 / count(*), 8) AS difference FROM labels""",
)
def discordance(spark, sf):
    out = R.discordance(V.table(spark, sf, "labels"), "quality", "toxic")
    return out.withColumn("difference", V.r6(F.col("difference"), 8))


@query("i08_discordance_interval")
def discordance_interval(spark, sf):
    return R.discordance(V.table(spark, sf, "labels"), "quality", "toxic", resamples=500, seed=9)


@query(
    "i09_hoeffding",
    V.sql(
        SPEND,
        """m AS (SELECT k, avg(d) AS mean, count(*) AS n FROM od GROUP BY k)""",
        body="""SELECT k, n, round(mean, 8) + 0.0 AS mean, round(least(1, exp(-n * greatest(0, -mean) ^ 2 / 2)), 8) AS p, round(mean + sqrt(2 * ln(20) / n), 8) + 0.0 AS upper FROM m""",
    ),
)
def hoeffding(spark, sf):
    out = I.hoeffding(spend(spark, sf), "d", 1.0, 0.05, ["k"])
    return out.select("k", "n", *[V.r6(F.col(c), 8).alias(c) for c in ("mean", "p", "upper")])


@query(
    "i10_holm",
    """WITH p AS (SELECT c_mktsegment AS g, c_custkey, ((c_custkey * 7919) % 10007) / 10007.0 / 1000 AS p FROM customer),
    k AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY g) AS m FROM p WINDOW w AS (PARTITION BY g ORDER BY p, c_custkey))
    SELECT c_custkey, round(p, 10) AS p, round(max(least(1, (m - r + 1) * p)) OVER (PARTITION BY g ORDER BY r), 9) AS holm FROM k""",
)
def holm(spark, sf):
    rows = V.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("g"), "c_custkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(10007)) / 10007.0 / 1000).alias("p")
    )
    out = I.holm(rows, "p", ["g"], ["c_custkey"])
    return out.select("c_custkey", V.r6(F.col("p"), 10).alias("p"), V.r6(F.col("holm"), 9).alias("holm"))


@query(
    "i11_sign_flip",
    """WITH d AS (SELECT r_name AS k, n_nationkey, avg(c_acctbal) - 4500 AS d FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
    o AS (SELECT k, n_nationkey, d, row_number() OVER (PARTITION BY k ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, abs(avg(d) OVER (PARTITION BY k)) AS obs FROM d),
    f AS (SELECT k, s, n, obs, abs(avg(CASE WHEN (s >> i) & 1 = 1 THEN -d ELSE d END)) AS m FROM o, range(4096) q(s) WHERE s < (1 << n) GROUP BY ALL)
    SELECT k, CAST(any_value(n) AS INT) AS n, round(avg(CASE WHEN m >= obs - 1e-9 THEN 1.0 ELSE 0 END), 8) AS p FROM f GROUP BY k""",
)
def sign_flip(spark, sf):
    nation = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = V.table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    means = rows.groupBy(F.col("r_name").alias("k"), "n_nationkey").agg((F.avg("c_acctbal") - 4500).alias("d"))
    return I.sign_flip(means, "d", ["k"]).select("k", "n", V.r6(F.col("p"), 8).alias("p"))


@query(
    "i12_cluster_bootstrap",
    V.sql(
        SPEND,
        """cl AS (SELECT o_custkey, sum(d) AS s, count(*) AS k, row_number() OVER (ORDER BY o_custkey) - 1 AS "index" FROM od GROUP BY 1)""",
        """dr AS (SELECT r AS replicate, (r * 7919 + "index" * "index" * 31 + "index" * r * 13) % (SELECT count(*) FROM cl) AS "index" FROM cl, range(50) q(r))""",
        """me AS (SELECT replicate, sum(s) / sum(k) AS m FROM cl JOIN dr USING ("index") GROUP BY 1)""",
        body="""SELECT (SELECT round(avg(d), 7) + 0.0 FROM od) AS mean, round(quantile_cont(m, 0.025), 6) + 0.0 AS lower, round(quantile_cont(m, 0.975), 6) + 0.0 AS upper FROM me""",
    ),
)
def cluster_bootstrap(spark, sf):
    rows = spend(spark, sf)
    clusters = R.numbered_clusters(rows, "d", "o_custkey")
    draws = R.draws_per_row(clusters, [], 50, draw=lambda r, p, n: F.pmod(r * 7919 + p * p * 31 + p * r * 13, n))
    out = R.cluster_bootstrap(rows, "d", "o_custkey", draws)
    return out.select(V.r6(F.col("mean"), 7).alias("mean"), V.r6(F.col("lower")).alias("lower"), V.r6(F.col("upper")).alias("upper"))


MEANS = FOLDS + """, mn AS (SELECT dataset AS block, method, round(avg(accuracy), 7) AS v FROM fo GROUP BY ALL)"""


def block_means(spark, sf):
    return fold_records(spark, sf).groupBy(F.col("dataset").alias("block"), "method").agg(V.r6(F.avg("accuracy"), 7).alias("v"))


@query(
    "i13_friedman",
    V.sql(
        MEANS,
        """rk AS (SELECT block, method, rank() OVER (PARTITION BY block ORDER BY v) + (count(*) OVER (PARTITION BY block, v) - 1) / 2.0 AS r FROM mn)""",
        """sm AS (SELECT method, sum(r) AS s, count(*) AS n FROM rk GROUP BY 1)""",
        """ti AS (SELECT sum(c * (c * c - 1)) AS t FROM (SELECT count(*) AS c FROM mn GROUP BY block, v))""",
        body="""SELECT max(n) AS n, count(*) AS k, round((12.0 / (count(*) * max(n) * (count(*) + 1)) * sum(s * s) - 3.0 * max(n) * (count(*) + 1)) / (1 - max(t) / (count(*) * (count(*) ^ 2 - 1) * max(n))), 6) AS statistic FROM sm, ti""",
    ),
)
def friedman(spark, sf):
    out = I.friedman(block_means(spark, sf), "block", "method", "v")
    return out.select("n", "k", V.r6(F.col("statistic")).alias("statistic"))


@query(
    "i13_wilcoxon",
    V.sql(
        MEANS,
        """df AS (SELECT o.method, round(a.v - o.v, 6) AS d FROM mn a JOIN mn o USING (block) WHERE a.method = '1-URGENT' AND o.method <> '1-URGENT')""",
        """rk AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS r FROM df WHERE d <> 0)""",
        """st AS (SELECT method, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS statistic FROM rk GROUP BY 1)""",
        body="""SELECT method, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS draws, count(*) FILTER (WHERE d < 0) AS losses, round(any_value(statistic), 6) AS statistic FROM df LEFT JOIN st USING (method) GROUP BY method""",
    ),
)
def wilcoxon(spark, sf):
    means = block_means(spark, sf)
    mine = means.where("method = '1-URGENT'").select("block", F.col("v").alias("a"))
    gaps = means.where("method <> '1-URGENT'").join(mine, "block").select("method", V.r6(F.col("a") - F.col("v"), 6).alias("d"))
    out = I.wilcoxon(gaps, "d", ["method"])
    return out.select("method", "wins", "draws", "losses", V.r6(F.col("statistic")).alias("statistic"))


@query(
    "i14_primary_audit",
    V.sql(
        ALARMS.replace("o_orderpriority AS method, o_orderkey AS replicate", "CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS method, o_orderkey // 2 AS replicate")
        .replace("CASE o_orderkey % 3 WHEN 0 THEN 'null_arl' WHEN 1 THEN 'surveillance' ELSE 'restart_at_change' END", "'restart_at_change'")
        .replace("CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 60 ELSE 0 END", "0")
        .replace("c_mktsegment AS family", "CASE WHEN (o_orderkey // 2) % 2 = 0 THEN 'even' ELSE 'odd' END AS family"),
        """pv AS (SELECT family, replicate, max(delay) FILTER (WHERE method = 'new') AS a, max(delay) FILTER (WHERE method = 'old') AS b FROM rows_ GROUP BY ALL)""",
        """m AS (SELECT family, avg(a - b) AS mean, count(*) AS n FROM pv GROUP BY 1)""",
        """h AS (SELECT *, least(1, exp(-n * greatest(0, -mean) ^ 2 / (2 * 512.0 ^ 2))) AS p, mean + 512 * sqrt(2 * ln(40) / n) AS upper FROM m)""",
        """r AS (SELECT *, row_number() OVER (ORDER BY p, family) AS k FROM h)""",
        """ad AS (SELECT *, max(least(1, (3 - k) * p)) OVER (ORDER BY k) AS holm FROM r)""",
        body="""SELECT family, n, round(mean, 6) AS mean, round(p, 6) AS p, round(upper, 6) AS upper, round(holm, 6) AS holm, upper < 0 AND holm < 0.05 AS passes FROM ad""",
    ),
)
def primary_audit(spark, sf):
    base = alarms(spark, sf)
    k = F.col("replicate")
    half = F.floor(k / 2).cast("bigint")
    rows = base.select(
        F.when(F.pmod(half, F.lit(2)) == 0, "even").otherwise("odd").alias("family"), "effect",
        F.when(F.pmod(k, F.lit(2)) == 0, "new").otherwise("old").alias("method"), half.alias("replicate"), half.alias("seed"),
        F.lit("restart_at_change").alias("evaluation"), F.lit(0).alias("change_time"), "alarm_time",
    )
    out = I.primary_audit(delay_rows(rows, 256, 2), "new", "old", 0.05, 512.0, 2)
    return out.select("family", "n", *[V.r6(F.col(c)).alias(c) for c in ("mean", "p", "upper", "holm")], "passes")


# ---------------------------------------------------------------- the same resamples, drawn where the rows are

IN_PLACE = 400


@query(
    "i07_paired_bootstrap_in_place",
    V.sql(SPEND, body="SELECT k, count(*) AS n, round(avg(d), 7) + 0.0 AS mean, true AS around_mean, true AS near_normal FROM od GROUP BY k"),
)
def paired_in_place(spark, sf):
    """The interval has to hold the mean and to be as wide as the normal one, within a quarter."""
    rows = spend(spark, sf)
    out = R.paired_resample(rows, "d", IN_PLACE, ["k"], seed=11)
    width = rows.groupBy("k").agg((2 * 1.96 * F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("_w"))
    near = F.abs((F.col("upper") - F.col("lower")) / F.col("_w") - 1) < 0.25
    around = (F.col("lower") <= F.col("mean")) & (F.col("mean") <= F.col("upper"))
    return out.join(width, "k").select("k", "n", V.r6(F.col("mean"), 7).alias("mean"), around.alias("around_mean"), near.alias("near_normal"))


@query(
    "i12_cluster_bootstrap_in_place",
    V.sql(SPEND, body="SELECT round(avg(d), 7) + 0.0 AS mean, true AS around_mean, true AS near_normal FROM od"),
)
def cluster_in_place(spark, sf):
    rows = spend(spark, sf)
    out = R.cluster_resample(rows, "d", "o_custkey", IN_PLACE, seed=11)
    sums = R.numbered_clusters(rows, "d", "o_custkey").crossJoin(F.broadcast(rows.agg(F.avg("d").alias("_mean"))))  # one row
    width = sums.agg((2 * 1.96 * F.sqrt(F.sum(F.pow(F.col("_s") - F.col("_mean") * F.col("_k"), 2))) / F.sum("_k")).alias("_w"))
    near = F.abs((F.col("upper") - F.col("lower")) / F.col("_w") - 1) < 0.25
    around = (F.col("lower") <= F.col("mean")) & (F.col("mean") <= F.col("upper"))
    return out.crossJoin(F.broadcast(width)).select(V.r6(F.col("mean"), 7).alias("mean"), around.alias("around_mean"), near.alias("near_normal"))  # one row


@query(
    "i03_bootstrap_risk_in_place",
    V.sql(
        V.OUTCOMES, NUMBERED,
        """ms AS (SELECT 'length' AS method, doc_id, score, toxic FROM nd UNION ALL SELECT 'mixed', doc_id, (doc_id * 7919) % 1009, toxic FROM nd)""",
        """rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, doc_id) AS r FROM ms)""",
        body="""SELECT method, CAST(budget AS INT) AS budget, CAST(sum(toxic) FILTER (WHERE r <= budget) AS BIGINT) AS observed, 400::BIGINT AS replicates, true AS within, true AS centred, true AS positives
        FROM rk, (VALUES (10), (25)) b(budget) GROUP BY ALL""",
    ),
)
def risk_in_place(spark, sf):
    """Captures of all replicates lie in 0 .. budget, centre on the observed one, and stand against positives that centre on all of them."""
    docs = numbered(spark, sf)
    mixed = F.pmod(F.col("doc_id") * 7919, F.lit(1009)).cast("double")
    of = lambda name, score: docs.select(F.lit(name).alias("method"), F.col("doc_id").alias("id"), "index", score.alias("score"), F.col("toxic").alias("label"))
    scores = of("length", F.col("score")).unionByName(of("mixed", mixed))
    found = R.risk_resample(scores, [10, 25], IN_PLACE, seed=11)
    ranked = place(scores, ["method"], [F.col("score").desc(), F.col("id")], "rank").rows()
    sums = [F.sum(F.when(F.col("rank") <= b, F.col("label")).otherwise(0)).alias(f"_o{b}") for b in (10, 25)]
    seen = ranked.groupBy("method").agg(F.sum("label").alias("_all"), F.count("*").alias("_n"), *sums)
    c, b = F.col("captured"), F.col("budget")
    observed = F.when(b == 10, F.col("_o10")).otherwise(F.col("_o25"))
    positives = c + F.col("retained_rate") * (F.col("_n") - b)
    return found.join(seen, "method").groupBy("method", "budget").agg(
        F.first(observed).alias("observed"), F.count("*").alias("replicates"), F.bool_and((c >= 0) & (c <= b)).alias("within"),
        (F.abs(F.avg(c) - F.first(observed)) <= 0.2 * F.first(b)).alias("centred"),
        (F.abs(F.avg(positives) - F.first("_all")) <= F.sqrt(F.first("_all").cast("double"))).alias("positives"),
    )


@query(
    "i04_bootstrap_threshold_in_place",
    V.sql(
        V.OUTCOMES, NUMBERED,
        body="""SELECT 400::BIGINT AS replicates, true AS within_budget, true AS at_most_largest, count(*) FILTER (score > 3000) AS frozen, true AS centred FROM nd""",
    ),
)
def threshold_in_place(spark, sf):
    docs = numbered(spark, sf)
    maxima = docs.select(F.lit("length").alias("method"), "index", F.col("score").alias("maximum"))
    found = R.threshold_resample(maxima, 7, {"length": 3000.0}, IN_PLACE, seed=11)
    times = R.count_frequencies(found, ["method"], "threshold").agg(F.sum("replicates").alias("replicates"))
    frozen = docs.agg(F.count_if(F.col("score") > 3000).alias("frozen"), F.max("score").alias("_top"))
    one = found.crossJoin(F.broadcast(frozen)).agg(  # one row
        F.bool_and(F.col("alert_count") <= 7).alias("within_budget"),
        F.bool_and((F.col("threshold") <= F.col("zero_alert_threshold")) & (F.col("zero_alert_threshold") <= F.col("_top"))).alias("at_most_largest"),
        F.first("frozen").alias("frozen"),
        (F.abs(F.avg("frozen_count") - F.first("frozen")) <= F.sqrt(F.first("frozen").cast("double")) + 1).alias("centred"),
    )
    return times.crossJoin(F.broadcast(one)).select("replicates", "within_budget", "at_most_largest", "frozen", "centred")  # one row
