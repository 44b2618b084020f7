"""Contrast fitting, scoring and classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.registry import query
from statewatch.catalog.state_queries import VEC2_STATE, pick
from statewatch.functions import encode as E
from statewatch.functions.bets import effect_from_direction
from statewatch.operators import contrast as C
from statewatch.operators import states as S
from statewatch.operators.baselines import baseline_suite
from statewatch.operators.classifier import DensityClassifier
from statewatch.operators.evaluation import evaluate_multiclass
from statewatch.operators.windows import window_density

# delta = rho_F - rho_O, a 2x2 matrix [[p, q], [q, r]] with eigenvalues m +- h
DELTA = """dl AS (SELECT f.a - o.a AS p, f.b - o.b AS q, f.c - o.c AS r FROM st2 f, st2 o WHERE f.label = 'F' AND o.label = 'O'),
eg AS (SELECT *, (p + r) / 2 + sqrt((p - r) ^ 2 / 4 + q ^ 2) AS hi, (p + r) / 2 - sqrt((p - r) ^ 2 / 4 + q ^ 2) AS lo FROM dl)"""
# projector on the leading eigenvector: (delta - lo I) / (hi - lo)
EFFECT = """ef AS (SELECT (p - lo) / (hi - lo) AS e0, q / (hi - lo) AS e1, (r - lo) / (hi - lo) AS e2, hi, lo FROM eg)"""


def fit2(spark, sf, **options):
    dens = S.class_densities(V.vec2(spark, sf), "label", "x", 2)
    return C.fit_contrast(dens, "label", "F", "O", **options)


@query(
    "c01_class_contrast",
    V.sql(
        V.VEC2, VEC2_STATE, DELTA, EFFECT,
        body="""SELECT round(hi, 8) AS positive_gap, round(lo, 8) AS negative_gap, round(hi - lo, 8) AS trace_norm, CAST(1 AS INT) AS rank,
        round(e0, 4) AS e00, round(e1, 4) + 0.0 AS e01 FROM ef""",
    ),
)
def class_contrast(spark, sf):
    out = fit2(spark, sf)
    e00, e01 = pick("effect", 0, 1, digits=4)
    gaps = [V.r6(F.col(c), 8).alias(c) for c in ("positive_gap", "negative_gap", "trace_norm")]
    return out.select(*gaps, "rank", e00.alias("e00"), e01.alias("e01"))


@query("c01_keyed_contrast")
def keyed_contrast(spark, sf):
    """64-dimensional contrast of each class against class 0; many groups solve in parallel."""
    dens = S.class_densities(V.vec(spark, sf), "label", "x", 64)
    base = dens.where("label = 0").select(F.col("rho").alias("_base"))
    sides = dens.where("label <> 0").crossJoin(F.broadcast(base))  # one row
    out = sides.select("label", C.contrast_of("rho", "_base", rank=8).alias("c"))
    return out.select("label", V.r6(F.col("c.trace_norm"), 5).alias("trace_norm"), "c.rank")


@query(
    "c02_score_effect",
    V.sql(
        V.VEC2, VEC2_STATE, DELTA, EFFECT,
        body="""SELECT label, count(*) AS n, round(avg((e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y)), 6) AS mean_score,
        round(max((e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y)), 5) AS max_score FROM vec2, ef GROUP BY label""",
    ),
)
def score_effect(spark, sf):
    effect = C.effect_matrix(fit2(spark, sf))
    scored = V.vec2(spark, sf).withColumn("s", C.score_effect(effect, "x"))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), V.r6(F.avg("s")).alias("mean_score"), V.r6(F.max("s"), 5).alias("max_score")
    )


@query("c02_score_effect_wide")
def score_wide(spark, sf):
    """64 dimensions: the effect is shipped to the tasks and applied batch by batch."""
    dens = S.class_densities(V.vec(spark, sf), "label", "x", 64)
    effect = C.effect_matrix(C.fit_contrast(dens, "label", 0, 1))
    scored = V.vec(spark, sf).withColumn("s", C.score_effect(effect, "x"))
    return scored.select("vec_id", "label", V.r6(F.col("s"), 5).alias("score"))


@query(
    "c03_modes",
    V.sql(
        V.VEC2, VEC2_STATE, DELTA, EFFECT,
        body="""SELECT CAST(0 AS INT) AS k, round(hi, 8) AS eigenvalue, 'gained' AS kind, round(e0, 4) AS overlap FROM ef
        UNION ALL SELECT 1, round(lo, 8), 'lost', round(1 - e0, 4) FROM ef""",
    ),
)
def modes(spark, sf):
    table = C.modes(fit2(spark, sf))
    kinds = table.select("k", "kind").distinct()
    out = C.mode_overlap(table, [2.0, 0.0]).join(kinds, "k")
    return out.select("k", V.r6(F.col("eigenvalue"), 8).alias("eigenvalue"), "kind", V.r6(F.col("overlap"), 4).alias("overlap"))


@query(
    "c04_invariant_contrast",
    V.sql(
        V.VEC2, VEC2_STATE, DELTA,
        body="""SELECT round(greatest(p, 0) + greatest(r, 0), 8) AS positive_gap, round(abs(p) + abs(r), 8) AS trace_norm, 0.0 AS commutator FROM dl""",
    ),
)
def invariant(spark, sf):
    """Invariance under flipping the sign of y leaves the diagonal contrast."""
    dens = S.class_densities(V.vec2(spark, sf), "label", "x", 2)
    out = C.fit_invariant_contrast(dens, "label", "F", "O", [np.eye(2), np.diag([1.0, -1.0])])
    return out.select(*[V.r6(F.col(c), 8).alias(c) for c in ("positive_gap", "trace_norm", "commutator")])


@query(
    "c05_shift_invariant_bins",
    V.sql(
        V.VEC_LONG,
        """dft AS (SELECT a.vec_id, a.label, f.f, sum(a.v * cos(2 * pi() * f.f * a.i / 64)) AS re, sum(a.v * sin(2 * pi() * f.f * a.i / 64)) AS im
          FROM vlong a, (SELECT CAST(f AS INT) AS f FROM range(64) r(f)) f WHERE a.label IN (0, 1) GROUP BY ALL)""",
        """pw AS (SELECT vec_id, label, f, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY vec_id) AS v FROM dft)""",
        body="""SELECT f AS bin, round(avg(v) FILTER (WHERE label = 1) - avg(v) FILTER (WHERE label = 0), 8) + 0.0 AS gain FROM pw GROUP BY f""",
    ),
)
def shift_invariant(spark, sf):
    table, _ = C.invariant_classifier(V.vec(spark, sf), "label", "x", 64, 1, 0)
    return table.select("bin", V.r6(F.col("gain"), 8).alias("gain"))


@query("c05_shift_invariant_score")
def shift_invariant_score(spark, sf):
    rows = V.vec(spark, sf)
    _, score = C.invariant_classifier(rows, "label", "x", 64, 1, 0)
    return rows.where("label IN (0, 1)").select("vec_id", "label", V.r6(score, 7).alias("score"))


@query(
    "c06_sector_contrast",
    V.sql(
        V.VEC2, VEC2_STATE, DELTA,
        body="""SELECT 'first' AS sector, 1 AS dimension, round(p, 8) AS trace, round(abs(p), 8) AS trace_norm, round(greatest(p, 0), 8) + 0.0 AS positive_gap FROM dl
        UNION ALL SELECT 'second', 1, round(r, 8), round(abs(r), 8), round(greatest(r, 0), 8) + 0.0 FROM dl""",
    ),
)
def sectors(spark, sf):
    dens = S.class_densities(V.vec2(spark, sf), "label", "x", 2)
    fitted = C.fit_invariant_contrast(dens, "label", "F", "O", [np.eye(2), np.diag([1.0, -1.0])])
    out = C.sector_contrast(fitted, {"first": [0], "second": [1]})
    return out.select("sector", "dimension", *[V.r6(F.col(c), 8).alias(c) for c in ("trace", "trace_norm", "positive_gap")])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "c07_regime_response",
    V.sql(
        """yc AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY ALL), y AS (SELECT yr, pr, n * 1.0 / sum(n) OVER (PARTITION BY yr) AS p FROM yc)""",
        """ys AS (SELECT DISTINCT yr FROM y), ps AS (SELECT DISTINCT pr FROM y)""",
        """full_y AS (SELECT ys.yr, ps.pr, coalesce(p, 0) AS p FROM ys CROSS JOIN ps LEFT JOIN y USING (yr, pr))""",
        """d AS (SELECT a.yr, sum(abs(b.p - a.p)) / 2 AS dist FROM full_y a JOIN full_y b ON a.pr = b.pr AND b.yr = a.yr + 1 GROUP BY a.yr)""",
        body="""SELECT yr + 0.5 AS midpoint, round(dist, 8) AS distance, round(dist, 8) AS response, dist = max(dist) OVER () AS peak FROM d""",
    ),
)
def response(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("yr"), E.one_hot("o_orderpriority", PRIORITIES).alias("x")
    )
    out = C.regime_response(rows, "yr", "x", 5)
    return out.select("midpoint", V.r6(F.col("distance"), 8).alias("distance"), V.r6(F.col("response"), 8).alias("response"), "peak")


@query(
    "c08_score_scan",
    V.sql(V.SCORE, body="""SELECT user_id, count(*) AS n, round(avg(s), 11) + 0.0 AS mean, round(stddev_samp(s) / sqrt(count(*)), 8) AS stderr FROM score GROUP BY 1"""),
)
def scan(spark, sf):
    out = C.score_scan(V.score(spark, sf), ["user_id"], "s")
    return out.select("user_id", "n", V.r6(F.col("mean"), 11).alias("mean"), V.r6(F.col("stderr"), 8).alias("stderr"))


# simplex rows: quantity, discount and tax shares of a line item; class 1 = open
SHARES = """sh AS (SELECT CAST(l_linestatus = 'O' AS INT) AS cls, l_quantity / t AS s0, 100 * l_discount / t AS s1, 100 * l_tax / t AS s2
  FROM (SELECT *, l_quantity + 100 * l_discount + 100 * l_tax AS t FROM lineitem)),
mn AS (SELECT avg(s0) FILTER (WHERE cls = 1) - avg(s0) FILTER (WHERE cls = 0) AS d0, avg(s1) FILTER (WHERE cls = 1) - avg(s1) FILTER (WHERE cls = 0) AS d1,
  avg(s2) FILTER (WHERE cls = 1) - avg(s2) FILTER (WHERE cls = 0) AS d2 FROM sh)"""


def shares(spark, sf):
    parts = F.array("l_quantity", 100 * F.col("l_discount"), 100 * F.col("l_tax"))
    mass = F.col("l_quantity") + 100 * F.col("l_discount") + 100 * F.col("l_tax")
    return V.table(spark, sf, "lineitem").select(
        (F.col("l_linestatus") == "O").cast("int").alias("cls"), F.transform(parts, lambda v: v / mass).alias("x")
    )


@query(
    "c09_positive_support",
    V.sql(SHARES, body="SELECT CAST(d0 > 1e-12 AS INT)::DOUBLE AS e0, CAST(d1 > 1e-12 AS INT)::DOUBLE AS e1, CAST(d2 > 1e-12 AS INT)::DOUBLE AS e2 FROM mn"),
)
def support(spark, sf):
    out = C.positive_support(shares(spark, sf), "cls", "x", 3)
    return out.select(*[F.get("effect", F.lit(i)).alias(f"e{i}") for i in range(3)])


@query(
    "c10_positive_part",
    V.sql(
        SHARES,
        """g AS (SELECT greatest(d0, 0) AS g0, greatest(d1, 0) AS g1, greatest(d2, 0) AS g2 FROM mn)""",
        body="SELECT round(g0 / (g0 + g1 + g2), 5) AS w0, round(g1 / (g0 + g1 + g2), 5) AS w1, round(g2 / (g0 + g1 + g2), 5) AS w2 FROM g",
    ),
)
def positive_part(spark, sf):
    out = C.positive_part_direction(shares(spark, sf), "cls", "x", 3)
    return out.select(*[V.r6(F.get("direction", F.lit(i)), 5).alias(f"w{i}") for i in range(3)])


@query(
    "c11_hotelling_direction",
    """WITH t AS (SELECT l_linestatus = 'O' AS one, l_quantity AS x, 100 * l_discount AS y FROM lineitem),
    m AS (SELECT avg(x) FILTER (WHERE one) - avg(x) FILTER (WHERE NOT one) AS dx, avg(y) FILTER (WHERE one) - avg(y) FILTER (WHERE NOT one) AS dy FROM t),
    r AS (SELECT x - avg(x) OVER (PARTITION BY one) AS x, y - avg(y) OVER (PARTITION BY one) AS y FROM t),
    c AS (SELECT sum(x * x) / (count(*) - 2) AS a, sum(x * y) / (count(*) - 2) AS b, sum(y * y) / (count(*) - 2) AS c FROM r),
    g AS (SELECT a + greatest(1e-6, 0.1 * (a + c) / 2) AS a, b, c + greatest(1e-6, 0.1 * (a + c) / 2) AS c, greatest(1e-6, 0.1 * (a + c) / 2) AS ridge FROM c),
    w AS (SELECT ridge, (c * dx - b * dy) AS w0, (a * dy - b * dx) AS w1 FROM g, m)
    SELECT round(ridge, 6) AS ridge, round(w0 / sqrt(w0 * w0 + w1 * w1), 5) AS w0, round(w1 / sqrt(w0 * w0 + w1 * w1), 5) AS w1 FROM w""",
)
def hotelling(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        (F.col("l_linestatus") == "O").cast("int").alias("cls"), F.array("l_quantity", 100 * F.col("l_discount")).alias("x")
    )
    out = C.hotelling_direction(rows, "cls", "x", 2, 0.1, 1e-6)
    return out.select(V.r6(F.col("ridge")).alias("ridge"), *[V.r6(F.get("direction", F.lit(i)), 5).alias(f"w{i}") for i in range(2)])


@query(
    "c12_effect_from_direction",
    V.sql(
        V.VEC_LONG,
        body="""SELECT vec_id, i, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM vlong WINDOW w AS (PARTITION BY vec_id)""",
    ),
)
def from_direction(spark, sf):
    out = V.vec(spark, sf).select("vec_id", F.posexplode(effect_from_direction("x")).alias("i", "v"))
    return out.withColumn("v", V.r6(F.col("v")))


@query("c13_logistic_effect")
def logistic_effect(spark, sf):
    rows = shares(spark, sf)
    fitted = C.fit_logistic_effect(rows, "cls", "x", c=1.0)
    score = C.dot(C.vector(fitted["effect"]), "x")
    return rows.groupBy("cls").agg(V.r6(F.avg(score), 4).alias("mean_score"), F.count(F.lit(1)).alias("n"))


# operators A = prior * rho of each class; the Helstrom split of A_F - A_O in closed form
WEIGHTED = """wt AS (SELECT label, n * 1.0 / sum(n) OVER () AS pr, a, b, c FROM st2),
dw AS (SELECT f.pr * f.a - o.pr * o.a AS p, f.pr * f.b - o.pr * o.b AS q, f.pr * f.c - o.pr * o.c AS r FROM wt f, wt o WHERE f.label = 'F' AND o.label = 'O'),
ew AS (SELECT *, (p + r) / 2 + sqrt((p - r) ^ 2 / 4 + q ^ 2) AS hi, (p + r) / 2 - sqrt((p - r) ^ 2 / 4 + q ^ 2) AS lo FROM dw)"""
# effect of class F: projector on nonnegative eigenvalues
HELSTROM = WEIGHTED + """, hs AS (SELECT CASE WHEN lo >= 0 THEN 1 WHEN hi < 0 THEN 0 ELSE (p - lo) / (hi - lo) END AS e0,
  CASE WHEN lo >= 0 OR hi < 0 THEN 0 ELSE q / (hi - lo) END AS e1, CASE WHEN lo >= 0 THEN 1 WHEN hi < 0 THEN 0 ELSE (r - lo) / (hi - lo) END AS e2,
  0.5 * (1 + abs(hi) + abs(lo)) AS success FROM ew)"""


def even(spark, sf, **options):
    rows = V.vec2(spark, sf)
    return rows, DensityClassifier(2, priors="balanced", **options).fit(rows)


BALANCED = WEIGHTED.replace("n * 1.0 / sum(n) OVER ()", "0.5")
HELSTROM_EVEN = HELSTROM.replace("n * 1.0 / sum(n) OVER ()", "0.5")


@query(
    "c14_classifier_summary",
    V.sql(
        V.VEC2, VEC2_STATE, HELSTROM_EVEN,
        body="""SELECT 'helstrom' AS rule, round(success, 7) AS success, true AS "valid", 0.0 AS completeness_error FROM hs""",
    ),
)
def classifier_summary(spark, sf):
    _, model = even(spark, sf)
    return model.summary(spark).select("rule", V.r6(F.col("success"), 7).alias("success"), "valid", V.r6(F.col("completeness_error")).alias("completeness_error"))


@query(
    "c15_helstrom_rule",
    V.sql(
        V.VEC2, VEC2_STATE, HELSTROM_EVEN,
        """sc AS (SELECT label, (e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y) AS f FROM vec2, hs)""",
        body="""SELECT label, count(*) AS n, round(avg(f), 6) AS mean_f FROM sc GROUP BY label""",
    ),
)
def helstrom_rule(spark, sf):
    rows, model = even(spark, sf, measurement="helstrom")
    out = rows.withColumn("p", model.probability())
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), V.r6(F.avg(F.get("p", F.lit(0)))).alias("mean_f"))


@query(
    "c16_pretty_good_rule",
    """WITH p AS (SELECT o_orderstatus AS label, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY ALL),
    s AS (SELECT pr, sum(n) AS t FROM p GROUP BY pr)
    SELECT label, pr, round(n * 1.0 / t, 6) AS p FROM p JOIN s USING (pr)""",
)
def pretty_good_rule(spark, sf):
    """Commuting states: the outcome probability is the posterior of the class given the category."""
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("pr"), E.one_hot("o_orderpriority", PRIORITIES).alias("x")
    )
    model = DensityClassifier(5, measurement="pretty_good").fit(rows)
    out = rows.select("pr", "x").distinct().withColumn("p", model.probability())
    names = F.array(*[F.lit(c) for c in model.classes])
    return out.select("pr", F.explode(F.arrays_zip(names.alias("label"), F.col("p").alias("p"))).alias("c")).select(
        "pr", F.col("c.label").alias("label"), V.r6(F.col("c.p")).alias("p")
    )


@query("c17_jacobi_rule")
def jacobi_rule(spark, sf):
    """Ten classes in 64 dimensions; every start is a task."""
    model = DensityClassifier(64, random_starts=4, max_sweeps=20).fit(V.vec(spark, sf))
    return model.summary(spark).select("rule", V.r6(F.col("success"), 3).alias("success"), "valid", V.r6(F.col("gap_bound"), 2).alias("gap_bound"))


@query(
    "c18_measurement_probabilities",
    V.sql(
        V.VEC2, VEC2_STATE, HELSTROM_EVEN,
        """sc AS (SELECT label, (e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y) AS f FROM vec2, hs)""",
        body="""SELECT label, round(avg(f), 6) AS p_f, round(avg(1 - f), 6) AS p_o, 1.0 AS mass FROM sc GROUP BY label""",
    ),
)
def probabilities(spark, sf):
    rows, model = even(spark, sf)
    out = rows.withColumn("p", model.probability())
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return out.groupBy("label").agg(
        V.r6(F.avg(first)).alias("p_f"), V.r6(F.avg(second)).alias("p_o"), V.r6(F.avg(first + second)).alias("mass")
    )


@query("c19_spectral_rule")
def spectral_rule(spark, sf):
    rows = V.vec(spark, sf)
    model = DensityClassifier(64, decision_rule="spectral", random_starts=0, max_sweeps=10).fit(rows)
    return model.transform(rows).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c20_component_energies",
    V.sql(
        V.VEC2, VEC2_STATE, BALANCED,
        """hh AS (SELECT (p - lo) / (hi - lo) AS e0, q / (hi - lo) AS e1, (r - lo) / (hi - lo) AS e2, abs(hi) >= abs(lo) AS hi_first FROM ew)""",
        """sc AS (SELECT label, hi_first, (e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y) AS f FROM vec2, hh)""",
        body="""SELECT label, round(avg(CASE WHEN hi_first THEN f ELSE 1 - f END), 6) AS energy0, round(avg(CASE WHEN hi_first THEN 1 - f ELSE f END), 6) AS energy1 FROM sc GROUP BY label""",
    ),
)
def components(spark, sf):
    rows, model = even(spark, sf)
    out = rows.withColumn("c", model.components())
    return out.groupBy("label").agg(*[V.r6(F.avg(F.get("c", F.lit(i)))).alias(f"energy{i}") for i in range(2)])


@query(
    "c21_expected_accuracy",
    V.sql(
        V.VEC2, VEC2_STATE, HELSTROM_EVEN,
        """sc AS (SELECT label, (e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y) AS f FROM vec2, hs)""",
        body="""SELECT round(avg(CASE label WHEN 'F' THEN f ELSE 1 - f END), 6) AS accuracy FROM sc""",
    ),
)
def expected_accuracy(spark, sf):
    rows, model = even(spark, sf)
    return model.expected_accuracy(rows).select(V.r6(F.col("accuracy")).alias("accuracy"))


@query(
    "c22_binary_success",
    V.sql(
        V.VEC2, VEC2_STATE, DELTA, EFFECT,
        """sc AS (SELECT label, (e0 * x * x + 2 * e1 * x * y + e2 * y * y) / (x * x + y * y) AS f FROM vec2, ef)""",
        body="""SELECT round(0.5 * (avg(f) FILTER (WHERE label = 'F') + 1 - avg(f) FILTER (WHERE label = 'O')), 6) AS success FROM sc""",
    ),
)
def success(spark, sf):
    effect = C.effect_matrix(fit2(spark, sf))
    scored = V.vec2(spark, sf).withColumn("s", C.score_effect(effect, "x"))
    return C.binary_success(scored, "label", "s", "F", "O").select(V.r6(F.col("success")).alias("success"))


REF, ALT = [0.4, 0.1, 0.2, 0.1, 0.2], [0.2, 0.2, 0.2, 0.2, 0.2]


@query(
    "c23_nearest_state",
    V.sql(
        V.CAT,
        "c(event_type, r, a) AS (VALUES " + ", ".join(f"('{c}', {r}, {a})" for c, r, a in zip(V.EVENT_TYPES, REF, ALT)) + ")",
        """w AS (SELECT user_id, (t - 1) // 8 AS "window", event_type FROM cat)""",
        """fw AS (SELECT user_id, "window" FROM w GROUP BY ALL HAVING count(*) = 8)""",
        """p AS (SELECT f.user_id, f."window", c.event_type, any_value(r) AS r, any_value(a) AS a, count(w.event_type) / 8.0 AS p FROM fw f CROSS JOIN c
          LEFT JOIN w ON w.user_id = f.user_id AND w."window" = f."window" AND w.event_type = c.event_type GROUP BY ALL)""",
        body="""SELECT user_id, "window", round(sqrt(sum((p - r) ^ 2)) - sqrt(sum((p - a) ^ 2)), 6) + 0.0 AS score FROM p GROUP BY ALL""",
    ),
)
def nearest_state(spark, sf):
    rows = V.cat(spark, sf).withColumn("x", E.one_hot("event_type", V.EVENT_TYPES))
    dens = window_density(rows, ["user_id"], ["ts", "event_id"], "x", 5, 8)
    out = C.nearest_state_score(dens, np.diag(REF).ravel(), np.diag(ALT).ravel())
    return out.select("user_id", "window", V.r6(F.col("score")).alias("score"))


@query("c24_scalar_readout")
def scalar_readout(spark, sf):
    out = C.scalar_classifier(V.outcomes(spark, sf), "quality", "score")
    return evaluate_multiclass(out.withColumn("prediction", F.col("prediction").cast("int")), "quality", "prediction")


@query("c25_baseline_suite")
def suite(spark, sf):
    rows = V.vec2(spark, sf).select((F.col("label") == "O").cast("int").alias("cls"), "x")
    out = baseline_suite(rows, rows, "x", "cls", 2)
    return out.groupBy("method", "cls", "prediction").agg(F.count(F.lit(1)).alias("n"))


