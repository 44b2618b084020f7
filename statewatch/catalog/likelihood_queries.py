"""Likelihood scores of observed grid rows and paired event rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.registry import query
from statewatch.catalog.state_queries import pair_bits
from statewatch.functions.likelihood import TemplateModel
from statewatch.operators import bank as K
from statewatch.operators import marginals as M
from statewatch.operators import states as S
from statewatch.operators.sequences import hmm_increments
from statewatch.operators.windows import window_id
from statewatch.plans import place
from statewatch.plans.ordering import shuffle_tasks

MODEL = TemplateModel(3, event=0.6, eps=0.05)
Q = 0.3

# every translated template written out: 18 endpoint pairs per length
TEMPLATES = """tp AS (SELECT CAST(l AS INT) AS l, v AS a, (v // 3) * 3 + (v % 3 + l) % 3 AS b FROM range(9) r(v), range(1, 3) q(l)
  UNION ALL SELECT CAST(l AS INT), v, (v // 3 + l) % 3 * 3 + v % 3 FROM range(9) r(v), range(1, 3) q(l)),
ds AS (SELECT p_partkey, l, bit_count(xor(code, ((1 << CAST(a AS INT)) | (1 << CAST(b AS INT))))) AS d FROM grid, tp),
em AS (SELECT p_partkey, l, avg(pow(0.05, d) * pow(0.95, 9 - d)) AS pt FROM ds GROUP BY ALL),
cl AS (SELECT g.p_partkey, g.p_brand, ln(0.4 * pow(0.05, bit_count(code)) * pow(0.95, 9 - bit_count(code)) + 0.6 * e1.pt) AS c1,
  ln(0.4 * pow(0.05, bit_count(code)) * pow(0.95, 9 - bit_count(code)) + 0.6 * e2.pt) AS c2
  FROM grid g JOIN em e1 ON e1.p_partkey = g.p_partkey AND e1.l = 1 JOIN em e2 ON e2.p_partkey = g.p_partkey AND e2.l = 2)"""
LL = "ln((1 - {q}) * exp(c1) + {q} * exp(c2))"


def counted(spark, sf):
    rows = V.grid(spark, sf)
    # short rows with much work on each: file splits by bytes would leave it to few tasks
    return rows.repartition(shuffle_tasks(rows)).withColumn("g", MODEL.counts("bits"))


@query("l01_template_loglik", V.sql(V.GRID, TEMPLATES, body=f"SELECT p_partkey, round({LL.format(q=0.3)}, 6) AS ll FROM cl"))
def loglik(spark, sf):
    return counted(spark, sf).select("p_partkey", V.r6(MODEL.loglik(F.col("g"), Q)).alias("ll"))


@query(
    "l02_likelihood_grid",
    V.sql(
        V.GRID, TEMPLATES, """gv(q) AS (VALUES (0.1), (0.5), (0.9))""",
        body=f"""SELECT p_partkey, CAST(q AS DOUBLE) AS q, round(exp(least(greatest({LL.format(q="q")} - {LL.format(q=0.3)}, -700), 700)), 6) AS ratio FROM cl, gv""",
    ),
)
def grid_ratios(spark, sf):
    cells = MODEL.ratios(F.col("g"), (0.1, 0.5, 0.9), Q)
    out = counted(spark, sf).select("p_partkey", F.explode(cells).alias("c")).select("p_partkey", "c.*")
    return out.withColumn("ratio", V.r6(F.col("ratio")))


PAIRED = """od AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM cl),
pr AS (SELECT a.p_brand, (a.t - 1) // 2 AS pair, a.c1 AS a1, a.c2 AS a2, b.c1 AS b1, b.c2 AS b2 FROM od a JOIN od b ON a.p_brand = b.p_brand AND a.t % 2 = 1 AND b.t = a.t + 1)"""
# kappa = 0.4, q = 0.3: repeat 0.4, else a fresh length
PAIR_LL = """ln(0.7 * exp(a1) * ((0.4 + 0.6 * 0.7) * exp(b1) + 0.6 * 0.3 * exp(b2)) + 0.3 * exp(a2) * (0.6 * 0.7 * exp(b1) + (0.4 + 0.6 * 0.3) * exp(b2)))"""


def adjacent(spark, sf):
    placed = place(counted(spark, sf).select("p_brand", "p_partkey", "g"), ["p_brand"], ["p_partkey"])
    rows = placed.look_back(1, lambda w: {"before": F.lag("g").over(w)}).rows().where(F.pmod("t", F.lit(2)) == 0)
    return rows.withColumn("pair", (F.col("t") / 2).cast("bigint") - 1)


@query("l03_pair_loglik", V.sql(V.GRID, TEMPLATES, PAIRED, body=f"SELECT p_brand, pair, round({PAIR_LL}, 6) AS ll FROM pr"))
def pair_loglik(spark, sf):
    return adjacent(spark, sf).select("p_brand", "pair", V.r6(MODEL.pair_loglik(F.col("before"), F.col("g"), Q, 0.4)).alias("ll"))


@query(
    "l04_chain_increments",
    V.sql(
        V.GRID, TEMPLATES,
        """od AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM cl)""",
        """ft AS (SELECT p_brand, t, 0.7 * exp(c1) / (0.7 * exp(c1) + 0.3 * exp(c2)) AS f1, 0.3 * exp(c2) / (0.7 * exp(c1) + 0.3 * exp(c2)) AS f2,
            ln(0.7 * exp(c1) + 0.3 * exp(c2)) AS ll FROM od WHERE t = 1
          UNION ALL SELECT p_brand, t, j1 / (j1 + j2), j2 / (j1 + j2), ln(j1 + j2) FROM (SELECT o.p_brand, o.t,
            (f.f1 * (0.4 + 0.6 * 0.7) + f.f2 * 0.6 * 0.7) * exp(o.c1) AS j1, (f.f1 * 0.6 * 0.3 + f.f2 * (0.4 + 0.6 * 0.3)) * exp(o.c2) AS j2
            FROM ft f JOIN od o ON o.p_brand = f.p_brand AND o.t = f.t + 1))""",
        body=f"""SELECT p_brand, CAST((t - 1) // 2 AS BIGINT) AS block, round(sum(ft.ll - {LL.format(q=0.3)}), 6) + 0.0 AS increment FROM ft JOIN od USING (p_brand, t) GROUP BY ALL HAVING count(*) = 2""",
    ),
)
def increments(spark, sf):
    out = hmm_increments(V.grid(spark, sf), ["p_brand"], ["p_partkey"], "bits", MODEL, Q, 0.4, check=False)
    return out.withColumn("increment", V.r6(F.col("increment")))


@query(
    "l05_statistic_ratio",
    V.sql(V.GRID, TEMPLATES, body=f"SELECT p_partkey, round({LL.format(q=0.8)} - {LL.format(q=0.3)}, 6) + 0.0 AS llr FROM cl"),
)
def statistic_ratio(spark, sf):
    return V.grid(spark, sf).select("p_partkey", V.r6(MODEL.statistic_ratio("bits", Q, 0.8)).alias("llr"))


@query(
    "l06_length_score",
    V.sql(V.GRID, TEMPLATES, body=f"SELECT p_partkey, round((0.3 * exp(c2) / exp({LL.format(q=0.3)}) - 0.3) / sqrt(0.21), 6) + 0.0 AS score FROM cl"),
)
def length_score(spark, sf):
    return counted(spark, sf).select("p_partkey", V.r6(MODEL.length_score(F.col("g"), Q)).alias("score"))


@query(
    "l07_window_ratio",
    V.sql(
        V.GRID, TEMPLATES,
        """od AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM cl)""",
        body=f"""SELECT p_brand, CAST((t - 1) // 4 AS BIGINT) AS "window", round(sum({LL.format(q=0.8)} - {LL.format(q=0.3)}), 6) + 0.0 AS llr FROM od GROUP BY ALL HAVING count(*) = 4""",
    ),
)
def window_ratio(spark, sf):
    gap = MODEL.loglik(F.col("g"), 0.8) - MODEL.loglik(F.col("g"), Q)
    rows = counted(spark, sf).select("p_brand", "p_partkey", gap.alias("llr"))
    placed = place(rows, ["p_brand"], ["p_partkey"]).rows().withColumn("window", window_id(F.col("t"), 4))
    out = placed.groupBy("p_brand", "window").agg(F.count(F.lit(1)).alias("n"), V.r6(F.sum("llr")).alias("llr"))
    return out.where("n = 4").drop("n")


NLL = """pf AS (SELECT role, chk, least(greatest((sum(r + m) + 0.5) / (2 * count(*) + 1), 1e-4), 1 - 1e-4) AS p FROM pairs_long GROUP BY ALL)"""


@query(
    "l08_bernoulli_score",
    V.sql(
        V.PAIRS_LONG, NLL,
        body="""SELECT user_id, pair, role, round(avg((m - r) * (ln(1 - p) - ln(p))) / ln((1 - 1e-4) / 1e-4), 6) + 0.0 AS nll FROM pairs_long JOIN pf USING (role, chk) GROUP BY ALL""",
    ),
)
def bernoulli_score(spark, sf):
    pairs = pair_bits(spark, sf)
    out = K.nll_score(pairs, M.bernoulli_profile(pairs, ["role"], "r", "m"), ["role"], "r", "m")
    return out.select("user_id", "pair", "role", V.r6(F.col("nll")).alias("nll"))


@query(
    "l09_hotelling_score",
    V.sql(
        V.VEC2,
        """mn AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM vec2 GROUP BY 1)""",
        body="""SELECT label, count(*) AS n, round(avg(0.01 * (x - mx) ^ 2 + 2 * 0.002 * (x - mx) * (y - my) + 0.1 * (y - my) ^ 2), 6) AS mean_score,
        round(max(0.01 * (x - mx) ^ 2 + 2 * 0.002 * (x - mx) * (y - my) + 0.1 * (y - my) ^ 2), 6) AS max_score FROM vec2 JOIN mn USING (label) GROUP BY label""",
    ),
)
def hotelling(spark, sf):
    rows = V.vec2(spark, sf)
    means = S.moments(rows, ["label"], "x", 2)
    out = K.hotelling_score(rows, "x", means, np.array([[0.01, 0.002], [0.002, 0.1]]), ["label"])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), V.r6(F.avg("hotelling")).alias("mean_score"), V.r6(F.max("hotelling")).alias("max_score"))


