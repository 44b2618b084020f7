"""Ordered detectors, adaptive witnesses and the scorer bank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.likelihood_queries import NLL
from statewatch.catalog.registry import query
from statewatch.catalog.state_queries import hot, pair_bits
from statewatch.functions import bets as T
from statewatch.functions import bits as B
from statewatch.operators import adaptive as A
from statewatch.operators import bank as K
from statewatch.operators import bootstrap as R
from statewatch.operators import marginals as M
from statewatch.operators import replays as P
from statewatch.operators import sequences as Q
from statewatch.operators.monitor import run_detectors, run_detectors_once
from statewatch.plans import longest_group, place

ORDER = ["ts", "event_id"]
REF = [0.3, 0.1, 0.2, 0.15, 0.25]
CATS = "c(i, event_type, rf) AS (VALUES " + ", ".join(f"({i}, '{c}', {REF[i]}::DOUBLE)" for i, c in enumerate(V.EVENT_TYPES)) + ")"
HOTS = V.CAT + ", " + CATS + """, h AS (SELECT user_id, t, i, rf, CAST(cat.event_type = c.event_type AS INT)::DOUBLE AS x FROM cat CROSS JOIN c)"""


def trailing_sql(window: int) -> str:
    return f"""tr AS (SELECT *, avg(x) OVER (PARTITION BY user_id, i ORDER BY t ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS m FROM h)"""


RAW = """sc AS (SELECT user_id, t, sum(CASE WHEN m - rf > 1e-12 THEN x - rf ELSE 0 END) AS s FROM tr GROUP BY ALL)"""


@query(
    "t01_contrast_eprocess",
    V.sql(
        HOTS, trailing_sql(64), RAW,
        """bt AS (SELECT 0.01 * pow(99, i / 19.0) AS b FROM range(20) r(i))""",
        """lg AS (SELECT user_id, t, b, ln(1 + b * s) AS l, sum(ln(1 + b * s)) OVER (PARTITION BY user_id, b ORDER BY t) AS c FROM sc, bt)""",
        """ac AS (SELECT user_id, t, b, exp(c) * sum(6 / (pi() * pi() * t * t) * exp(l - c)) OVER (PARTITION BY user_id, b ORDER BY t) AS a FROM lg)""",
        """ev AS (SELECT user_id, t, avg(a) + 1 - sum(6 / (pi() * pi() * t * t)) OVER (PARTITION BY user_id ORDER BY t) AS e FROM ac GROUP BY user_id, t)""",
        body="""SELECT user_id, t, round(s, 6) + 0.0 AS score, round(e, 6) AS e_value, round(least(1, 1 / max(e) OVER (PARTITION BY user_id ORDER BY t)), 6) AS p,
        max(e) OVER (PARTITION BY user_id ORDER BY t) >= 100 AS alarm FROM ev JOIN sc USING (user_id, t)""",
    ),
)
def contrast_eprocess(spark, sf):
    out = A.contrast_eprocess(hot(spark, sf), ["user_id"], ORDER, "x", np.diag(REF))
    return out.select("user_id", "t", *[V.r6(F.col(c)).alias(c) for c in ("score", "e_value", "p")], "alarm")


@query(
    "t02_simplex_witness",
    V.sql(
        HOTS,
        """rf_ AS (SELECT a.user_id, a.t, a.i, a.rf, a.x, avg(b.x) AS m FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND a.i = b.i
          AND b.t <= 4 * ((a.t - 1) // 4) AND b.t > 4 * ((a.t - 1) // 4) - 16 GROUP BY ALL)""",
        body="""SELECT user_id, t, round(sum(CASE WHEN m - rf > 1e-12 THEN x - rf ELSE 0 END), 6) + 0.0 AS score FROM rf_ GROUP BY ALL""",
    ),
)
def simplex_witness(spark, sf):
    """Refit every 4 rows from the last 16."""
    out = Q.simplex_witness(hot(spark, sf), ["user_id"], ORDER, "x", REF, window=16, every=4)
    return out.select("user_id", "t", V.r6(F.col("score")).alias("score"))


def whitened_sql(covariance: np.ndarray, ridge: float) -> str:
    """``pc(i, j, v)``: the inverse of the covariance with its ridge."""
    inverse = np.linalg.inv(covariance + ridge * np.eye(len(covariance)))
    return "pc(i, j, v) AS (VALUES " + ", ".join(f"({i}, {j}, {float(inverse[i, j])!r}::DOUBLE)" for i in range(len(inverse)) for j in range(len(inverse))) + ")"


SIMPLEX_COV = np.diag(REF) - np.outer(REF, REF)


@query(
    "t02_simplex_witness_variance",
    V.sql(
        HOTS, whitened_sql(SIMPLEX_COV, 1e-3),
        """rf_ AS (SELECT a.user_id, a.t, a.i, a.rf, a.x, avg(b.x) AS m FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND a.i = b.i
          AND b.t <= 2 * ((a.t - 1) // 2) AND b.t > 2 * ((a.t - 1) // 2) - 32 GROUP BY ALL)""",
        """dw AS (SELECT r.user_id, r.t, pc.i, sum(pc.v * (r.m - r.rf)) AS w FROM rf_ r JOIN pc ON pc.j = r.i GROUP BY ALL)""",
        """ef AS (SELECT user_id, t, i, CASE WHEN max(w) OVER p - min(w) OVER p <= 1e-12 THEN 0 ELSE (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) END AS e FROM dw WINDOW p AS (PARTITION BY user_id, t))""",
        body="""SELECT user_id, t, round(coalesce(sum(e * (x - rf)), 0), 6) + 0.0 AS score FROM rf_ JOIN ef USING (user_id, t, i) GROUP BY ALL""",
    ),
)
def simplex_variance(spark, sf):
    cov = SIMPLEX_COV
    out = Q.simplex_witness(hot(spark, sf), ["user_id"], ORDER, "x", REF, "variance", cov, 1e-3, 32, 2)
    return out.select("user_id", "t", V.r6(F.col("score")).alias("score"))


@query(
    "t03_static_simplex",
    V.sql(HOTS, body="""SELECT user_id, t, round(sum(i / 4.0 * (x - rf)), 6) + 0.0 AS score FROM h GROUP BY ALL"""),
)
def static_simplex(spark, sf):
    rows = place(hot(spark, sf), ["user_id"], ORDER).rows()
    score = Q.static_simplex_score("x", REF, [i / 4 for i in range(5)])
    return rows.select("user_id", "t", V.r6(score).alias("score"))


BOX_REF, LOW, HIGH = [0.0, 0.5], [-1.0, 0.0], [1.0, 1.0]
BOX = V.SCORE.replace("AS s FROM events", "AS s, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 99.0 AS k FROM events")


def box(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 99.0
    s = F.least(F.greatest((F.col("value") - 50) / 200, F.lit(-1.0)), F.lit(1.0))
    return V.events(spark, sf).select("user_id", "ts", "event_id", F.array(s, k).alias("x"))


@query(
    "t04_box_witness",
    V.sql(
        BOX,
        """tr AS (SELECT *, avg(s) OVER w AS ms, avg(k) OVER w - 0.5 AS mk FROM score WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))""",
        body="""SELECT user_id, t, CASE WHEN t = 1 THEN 0.0 ELSE round((ms * s + mk * (k - 0.5)) / (2 * abs(ms) + abs(mk)), 6) + 0.0 END AS score FROM tr""",
    ),
)
def box_witness(spark, sf):
    out = Q.box_witness(box(spark, sf), ["user_id"], ORDER, "x", BOX_REF, LOW, HIGH, window=16)
    return out.select("user_id", "t", V.r6(F.col("score")).alias("score"))


@query(
    "t04_box_witness_variance",
    V.sql(
        BOX,
        """tr AS (SELECT *, avg(s) OVER w / 0.26 AS ms, (avg(k) OVER w - 0.5) / 0.11 AS mk FROM score WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))""",
        body="""SELECT user_id, t, CASE WHEN t = 1 THEN 0.0 ELSE round((ms * s + mk * (k - 0.5)) / (2 * abs(ms) + abs(mk)), 6) + 0.0 END AS score FROM tr""",
    ),
)
def box_variance(spark, sf):
    """Variances 0.25 and 0.1 with a ridge of 0.01."""
    out = Q.box_witness(box(spark, sf), ["user_id"], ORDER, "x", BOX_REF, LOW, HIGH, "variance", np.diag([0.25, 0.1]), 0.01, window=16)
    return out.select("user_id", "t", V.r6(F.col("score")).alias("score"))


@query("t05_static_box", V.sql(BOX, body="SELECT user_id, t, round((3 * s - (k - 0.5)) / 7, 6) + 0.0 AS score FROM score"))
def static_box(spark, sf):
    rows = place(box(spark, sf), ["user_id"], ORDER).rows()
    return rows.select("user_id", "t", V.r6(Q.static_box_score("x", BOX_REF, [3.0, -1.0], LOW, HIGH)).alias("score"))


def sr_sql(bets, inject="1.0", weight=None, source="score"):
    values = ", ".join(f"({b}::DOUBLE)" for b in bets)
    w = weight or 1.0 / len(bets)
    return f"""bt(b) AS (VALUES {values}),
    lg AS (SELECT user_id, t, b, ln(1 + b * s) AS l, sum(ln(1 + b * s)) OVER (PARTITION BY user_id, b ORDER BY t) AS c FROM {source}, bt),
    ac AS (SELECT user_id, t, b, exp(c) * sum({inject} * exp(l - c)) OVER (PARTITION BY user_id, b ORDER BY t) AS a FROM lg),
    sm AS (SELECT user_id, t, {w} * sum(a) AS v FROM ac GROUP BY ALL)"""


SR_BETS = [0.02, 0.05, 0.1, 0.2, 0.4, 0.8]
FROZEN = """fa AS (SELECT user_id, min(t) AS alarm_at FROM sm WHERE v >= 60 * (1 - 1e-12) GROUP BY 1),
fz AS (SELECT sm.user_id, sm.t, CASE WHEN sm.t >= alarm_at THEN (SELECT v FROM sm z WHERE z.user_id = sm.user_id AND z.t = alarm_at) ELSE v END AS v, CASE WHEN sm.t >= alarm_at THEN alarm_at END AS alarm_time FROM sm LEFT JOIN fa USING (user_id))"""


@query(
    "t06_bounded_sr",
    V.sql(V.SCORE, sr_sql(SR_BETS), FROZEN, body="SELECT user_id, t, round(v, 9) AS stat, alarm_time IS NOT NULL AS alarm, alarm_time FROM fz"),
)
def bounded_sr(spark, sf):
    out = Q.bounded_sr(V.score(spark, sf), ["user_id"], ORDER, "s", threshold=60.0)
    return out.select("user_id", "t", V.r6(F.col("stat"), 9).alias("stat"), "alarm", "alarm_time")


@query(
    "t07_ratio_sr",
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
def ratio_sr(spark, sf):
    ratios = F.array(*[F.exp(b * F.col("s") - b * b / 8) for b in (0.5, 1.0)])
    out = Q.lr_sr(V.score(spark, sf).withColumn("r", ratios), ["user_id"], ORDER, "r", 2, threshold=60.0)
    return out.select("user_id", "t", V.r6(F.col("stat"), 5).alias("stat"), "alarm_time")


@query(
    "t08_chain_sr",
    V.sql(
        V.SCORE,
        """st AS (SELECT user_id, 0 AS t, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2 FROM score WHERE t = 1
          UNION ALL SELECT user_id, t, (a1 * (k1 + (1 - k1) * 0.7) + a2 * (1 - k1) * 0.7) * (1 - 0.3 * s), (a1 * (1 - k1) * 0.3 + a2 * (k1 + (1 - k1) * 0.3)) * (1 + 0.7 * s),
            (b1 * (k2 + (1 - k2) * 0.7) + b2 * (1 - k2) * 0.7) * (1 - 0.3 * s), (b1 * (1 - k2) * 0.3 + b2 * (k2 + (1 - k2) * 0.3)) * (1 + 0.7 * s)
          FROM (SELECT s.user_id, s.t, s.s, 0.2 AS k1, 0.6 AS k2,
            (st.p1 * (0.2 + 0.8 * 0.7) + st.p2 * 0.8 * 0.7 + 0.7) * (1 - 0.2 * s.s) AS a1, (st.p1 * 0.8 * 0.3 + st.p2 * (0.2 + 0.8 * 0.3) + 0.3) * (1 + 0.5 * s.s) AS a2,
            (st.r1 * (0.6 + 0.4 * 0.7) + st.r2 * 0.4 * 0.7 + 0.7) * (1 - 0.2 * s.s) AS b1, (st.r1 * 0.4 * 0.3 + st.r2 * (0.6 + 0.4 * 0.3) + 0.3) * (1 + 0.5 * s.s) AS b2
            FROM st JOIN score s ON s.user_id = st.user_id AND s.t = st.t + 1))""",
        """sm AS (SELECT user_id, CAST(t AS BIGINT) AS t, 0.5 * (p1 + p2 + r1 + r2) AS v FROM st WHERE t > 0)""",
        FROZEN,
        body="SELECT user_id, t, round(v, 5) AS stat, alarm_time FROM fz",
    ),
)
def chain_sr(spark, sf):
    s = F.col("s")
    rows = V.score(spark, sf).withColumns({"a": F.array(1 - 0.2 * s, 1 + 0.5 * s), "b": F.array(1 - 0.3 * s, 1 + 0.7 * s)})
    step = lambda k: [[k + (1 - k) * 0.7, (1 - k) * 0.3], [(1 - k) * 0.7, k + (1 - k) * 0.3]]
    out = Q.hmm_sr(rows, ["user_id"], ORDER, "a", "b", [step(0.2), step(0.6)], [0.7, 0.3], threshold=60.0)
    return out.select("user_id", "t", V.r6(F.col("stat"), 5).alias("stat"), "alarm_time")


TOPK = """rk AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS r FROM vlong)"""


@query(
    "t09_top_k_signed",
    V.sql(V.VEC_LONG, TOPK, body="SELECT vec_id, i, CAST(CASE WHEN r > 5 THEN 0.0 WHEN v < 0 THEN -0.2 ELSE 0.2 END AS DOUBLE) AS w FROM rk"),
)
def top_k(spark, sf):
    return V.vec(spark, sf).select("vec_id", F.posexplode(T.top_k_signed("x", 5)).alias("i", "w")).withColumn("w", V.r6(F.col("w")))


@query(
    "t09_capped_simplex",
    V.sql(
        V.VEC_LONG, TOPK,
        body="""SELECT vec_id, i, CAST(CASE WHEN r <= 5 AND v >= 0 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS w FROM rk UNION ALL SELECT vec_id, i + 64, CAST(CASE WHEN r <= 5 AND v < 0 THEN 0.2 ELSE 0.0 END AS DOUBLE) FROM rk""",
    ),
)
def capped(spark, sf):
    return V.vec(spark, sf).select("vec_id", F.posexplode(T.capped_simplex_top_k("x", 5)).alias("i", "w")).withColumn("w", V.r6(F.col("w")))


@query(
    "t10_bet_factors",
    V.sql(V.SCORE, """b(i, b) AS (VALUES (0, 0.1), (1, -0.1), (2, 0.9), (3, -0.9))""", body="SELECT user_id, t, i, round(greatest(1 + b * s, 0), 6) AS f FROM score, b"),
)
def factors(spark, sf):
    rows = place(V.score(spark, sf), ["user_id"], ORDER).rows()
    out = rows.select("user_id", "t", F.posexplode(T.bet_factors("s", [0.1, 0.9], True)).alias("i", "f"))
    return out.withColumn("f", V.r6(F.col("f")))


@query(
    "t11_bounded_score",
    V.sql(V.SCORE, body="SELECT user_id, t, round(s, 8) + 0.0 AS s FROM score"),
)
def bounded(spark, sf):
    rows = place(V.score(spark, sf), ["user_id"], ORDER).rows()
    return rows.select("user_id", "t", V.r6(T.bounded_score(F.col("s") * (1 + 1e-13)), 8).alias("s"))


@query(
    "t12_ewma_topk",
    V.sql(
        HOTS,
        """ew AS (SELECT user_id, t, i, x - 0.2 AS x, coalesce((1 - pow(2, -1 / 16.0)) * pow(2, -(t - 1) / 16.0) * sum((x - 0.2) * pow(2, t / 16.0)) OVER (PARTITION BY user_id, i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM h)""",
        """rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY round(abs(e), 10) DESC, i) AS r FROM ew)""",
        body="""SELECT user_id, t, CASE WHEN t = 1 THEN 0.0 ELSE round(sum(CASE WHEN r <= 1 THEN CASE WHEN e < 0 THEN -x ELSE x END ELSE 0 END), 6) + 0.0 END AS k1,
        CASE WHEN t = 1 THEN 0.0 ELSE round(sum(CASE WHEN r <= 3 THEN CASE WHEN e < 0 THEN -x ELSE x END ELSE 0 END) / 3, 6) + 0.0 END AS k3 FROM rk GROUP BY user_id, t""",
    ),
)
def ewma_topk(spark, sf):
    rows = hot(spark, sf).withColumn("d", F.transform("x", lambda v: v - 0.2))
    out = A.ewma_topk(rows, ["user_id"], ORDER, "d", 5, 16.0, [1, 3])
    return out.select("user_id", "t", *[V.r6(F.get("scores", F.lit(i))).alias(n) for i, n in enumerate(("k1", "k3"))])


def paired_streams(spark, sf):
    """Streams of paired shots of sixteen users each, long enough to refit; they grow in number with the users, not in length."""
    return pair_bits(spark, sf).withColumn("stream", F.floor(F.col("user_id") / 16).cast("int"))


@query("t13_ewma_spectral")
def ewma_spectral(spark, sf):
    rows = paired_streams(spark, sf).withColumn("d", B.paired_contrast("r", "m")["density"])
    out = A.ewma_spectral(rows, ["stream", "role"], ["user_id", "pair"], "d", 7, 16.0, 8)
    return out.select("stream", "role", "t", V.r6(F.col("rank_one")).alias("rank_one"), V.r6(F.col("positive")).alias("positive"))


@query(
    "t14_online_logistic",
    V.sql(
        V.PAIRS,
        """df AS (SELECT user_id, role, row_number() OVER (PARTITION BY user_id, role ORDER BY pair) AS t,
          list_transform(range(7), lambda i: (((mon_k >> CAST(i AS INT)) & 1) - ((ref_k >> CAST(i AS INT)) & 1))::DOUBLE) AS d FROM pairs)""",
        """lr AS (SELECT user_id, role, 0::BIGINT AS t, list_transform(range(7), lambda i: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS n1, 0.0::DOUBLE AS n2 FROM df WHERE t = 1
          UNION ALL SELECT user_id, role, t, list_transform(range(7), lambda i: w[i + 1] + 0.5 * (d[i + 1] / (1 + exp(m)) - 0.01 * w[i + 1])), m,
            list_sum(list_transform(w, lambda v: abs(v))), list_sum(list_transform(w, lambda v: v * v))
          FROM (SELECT df.user_id, df.role, df.t, df.d, lr.w, list_inner_product(lr.w, df.d) AS m FROM lr JOIN df ON df.user_id = lr.user_id AND df.role = lr.role AND df.t = lr.t + 1))""",
        body="""SELECT user_id, role, t, round(tanh(m / greatest(1, n1)), 6) + 0.0 AS score, round(m, 10) + 0.0 AS margin, round(ln(1 + exp(-m)) + 0.005 * n2, 6) AS loss FROM lr WHERE t > 0""",
    ),
)
def online_logistic(spark, sf):
    rows, _ = A.online_logistic(pair_bits(spark, sf), ["user_id", "role"], ["pair"], "r", "m", 7, 0.5, 0.01)
    return rows.select("user_id", "role", "t", V.r6(F.col("score")).alias("score"), V.r6(F.col("margin"), 10).alias("margin"), V.r6(F.col("loss")).alias("loss"))


SIGNED = [0.1, -0.1, 0.3, -0.3]


def signed_factors(spark, sf):
    return V.score(spark, sf).withColumn("f", T.bet_factors("s", [0.1, 0.3], True))


@query(
    "t15_eprocess_bank",
    V.sql(
        V.SCORE, sr_sql(SIGNED, "1.0 / 120"),
        """ev AS (SELECT user_id, t, (120 - t) / 120.0 + v AS v FROM sm)""",
        """fa AS (SELECT user_id, min(t) AS alarm_at FROM ev WHERE v >= 5 GROUP BY 1)""",
        body="SELECT user_id, t, round(v, 6) AS stat, coalesce(t >= alarm_at, false) AS alarm FROM ev LEFT JOIN fa USING (user_id)",
    ),
)
def eprocess_bank(spark, sf):
    out = Q.eprocess_bank(signed_factors(spark, sf), ["user_id"], ORDER, "f", [0.25] * 4, 120, alpha=0.2, log_range=0.36)
    return out.select("user_id", "t", V.r6(F.col("stat")).alias("stat"), "alarm")


@query(
    "t16_sr_bank",
    V.sql(
        V.SCORE, sr_sql(SIGNED),
        """fa AS (SELECT user_id, min(t) AS alarm_at FROM sm WHERE v >= 60 GROUP BY 1)""",
        body="SELECT user_id, t, round(v, 5) AS stat, coalesce(t >= alarm_at, false) AS alarm, CASE WHEN t >= alarm_at THEN alarm_at END AS alarm_time FROM sm LEFT JOIN fa USING (user_id)",
    ),
)
def sr_bank(spark, sf):
    out = Q.sr_bank(signed_factors(spark, sf), ["user_id"], ORDER, "f", [0.25] * 4, 60.0)
    return out.select("user_id", "t", V.r6(F.col("stat"), 5).alias("stat"), "alarm", "alarm_time")


@query(
    "t17_page_cusum",
    V.sql(
        V.PAIRS_LONG,
        """ch AS (SELECT user_id, pair, role, chk AS c, CAST(m - r AS DOUBLE) AS x FROM pairs_long UNION ALL SELECT user_id, pair, role, -1, avg(m - r) FROM pairs_long GROUP BY ALL)""",
        """kp(kp) AS (VALUES (0.01), (0.05), (0.1))""",
        """ps AS (SELECT user_id, pair, role, c, kp, sum(x - kp) OVER w AS pp, sum(-x - kp) OVER w AS pn FROM ch, kp WINDOW w AS (PARTITION BY user_id, pair, c, kp ORDER BY role))""",
        """mn AS (SELECT *, pp - least(0, min(pp) OVER w) AS sp, pn - least(0, min(pn) OVER w) AS sn FROM ps WINDOW w AS (PARTITION BY user_id, pair, c, kp ORDER BY role))""",
        body="SELECT user_id, pair, role, round(max(sp), 6) + 0.0 AS positive, round(max(sn), 6) + 0.0 AS negative, round(greatest(max(sp), max(sn)), 6) + 0.0 AS cusum FROM mn GROUP BY ALL",
    ),
)
def page_cusum(spark, sf):
    rows = pair_bits(spark, sf)
    gap = [(F.get("m", F.lit(i)) - F.get("r", F.lit(i))).cast("double").alias(f"x{i}") for i in range(7)]
    rows = rows.select("user_id", "pair", "role", *gap, (B.firing_rate("m") - B.firing_rate("r")).alias("mean"))
    out = Q.page_cusum(rows, ["user_id", "pair"], ["role"], ["mean", *[f"x{i}" for i in range(7)]], longest=5)
    return out.select("user_id", "pair", "role", *[V.r6(F.col(c)).alias(c) for c in ("positive", "negative", "cusum")])


DETECTORS = V.sql(
    HOTS, whitened_sql(SIMPLEX_COV, 1e-3),
    """tm AS (SELECT a.user_id, a.t, a.i, a.rf, a.x, avg(b.x) AS m FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND a.i = b.i
      AND b.t <= 2 * ((a.t - 1) // 2) AND b.t > 2 * ((a.t - 1) // 2) - 16 GROUP BY ALL)""",
    """dw AS (SELECT r.user_id, r.t, pc.i, sum(pc.v * (r.m - r.rf)) AS w FROM tm r JOIN pc ON pc.j = r.i GROUP BY ALL)""",
    """ef AS (SELECT user_id, t, i, CASE WHEN max(w) OVER p - min(w) OVER p <= 1e-12 THEN 0 ELSE (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) END AS e FROM dw WINDOW p AS (PARTITION BY user_id, t))""",
    """ms AS (SELECT 'raw' AS method, user_id, t, sum(CASE WHEN m - rf > 1e-12 THEN x - rf ELSE 0 END) AS s FROM tm GROUP BY ALL
      UNION ALL SELECT 'variance', user_id, t, coalesce(sum(e * (x - rf)), 0) FROM tm JOIN ef USING (user_id, t, i) GROUP BY ALL
      UNION ALL SELECT 'matched', user_id, t, sum(CASE i WHEN 0 THEN 1.0 WHEN 4 THEN 0.5 ELSE 0.0 END * (x - rf)) FROM h GROUP BY ALL
      UNION ALL SELECT 'blind', user_id, t, 0.0 FROM h WHERE i = 0)""",
    "bt(b) AS (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in SR_BETS) + ")",
    """al AS (SELECT method, user_id, t, b, ln(1 + b * s) AS l FROM ms, bt UNION ALL SELECT 'likelihood', user_id, t, i, ln(1 + 0.3 * (x - rf)) FROM h WHERE i < 2)""",
    """cu AS (SELECT *, sum(l) OVER (PARTITION BY method, user_id, b ORDER BY t) AS c FROM al)""",
    """ac AS (SELECT method, user_id, t, exp(c) * sum(exp(l - c)) OVER (PARTITION BY method, user_id, b ORDER BY t) AS a FROM cu)""",
    """sm AS (SELECT method, user_id, t, avg(a) AS v FROM ac GROUP BY ALL)""",
    body="SELECT user_id, method, min(t) FILTER (v >= 20 * (1 - 1e-12)) AS alarm_time FROM sm GROUP BY ALL",
)


@query("t18_run_detectors_once", DETECTORS)
def detectors_once(spark, sf):
    rows = hot(spark, sf).withColumn("lr", F.array(*[1 + 0.3 * (F.get("x", F.lit(i)) - REF[i]) for i in range(2)]))
    return run_detectors_once(rows, ["user_id"], ORDER, "x", REF, [1.0, 0.0, 0.0, 0.0, 0.5], SIMPLEX_COV, 1e-3, 16, 2, 20.0, ratios="lr", alternatives=2)


@query("t18_run_detectors", DETECTORS.replace(">= 20 *", ">= 100 *"))
def detectors(spark, sf):
    cov = np.diag(REF) - np.outer(REF, REF)
    rows = hot(spark, sf).withColumn("lr", F.array(*[1 + 0.3 * (F.get("x", F.lit(i)) - REF[i]) for i in range(2)]))
    return run_detectors(rows, ["user_id"], ORDER, "x", REF, [1.0, 0.0, 0.0, 0.0, 0.5], cov, 1e-3, 16, 2, 100.0, ratios="lr", alternatives=2)


@query(
    "t19_fixed_scores",
    V.sql(
        V.PAIRS_LONG, NLL,
        body="""SELECT user_id, pair, role, round(abs(sum(m - r) / 7.0), 6) AS rate, round(abs(avg((m - r) * (ln(1 - p) - ln(p))) / ln((1 - 1e-4) / 1e-4)), 6) AS likelihood
        FROM pairs_long JOIN pf USING (role, chk) GROUP BY ALL""",
    ),
)
def fixed_scores(spark, sf):
    pairs = pair_bits(spark, sf)
    out = K.nll_score(pairs, M.bernoulli_profile(pairs, ["role"], "r", "m"), ["role"], "r", "m")
    return out.select("user_id", "pair", "role", V.r6(F.abs(K.rate_score("r", "m"))).alias("rate"), V.r6(F.abs("nll")).alias("likelihood"))


@query("t19_score_bank")
def score_bank(spark, sf):
    bank, _ = K.score_bank(paired_streams(spark, sf), ["stream", "role"], ["user_id", "pair"], "r", "m", 7, keep=["user_id", "pair"])
    out = K.empirical_scores(bank, 7)
    names = ("logistic_score", "sparse_score", "spectral_score", "composite_score")
    return out.select("stream", "role", "user_id", "pair", *[V.r6(F.col(c)).alias(c) for c in names], "sparse_winner", "composite_winner")


@query(
    "t20_shot_eprocess",
    V.sql(
        V.PAIRS,
        """sc AS (SELECT user_id, role, pair, row_number() OVER (PARTITION BY user_id, role ORDER BY pair) AS t, (bit_count(mon_k) - bit_count(ref_k)) / 7.0 AS s FROM pairs)""",
        """hz AS (SELECT user_id, count(DISTINCT pair) AS h FROM pairs GROUP BY 1)""",
        """bt(b) AS (VALUES (0.1), (-0.1), (0.3), (-0.3), (0.6), (-0.6), (0.9), (-0.9))""",
        """lg AS (SELECT user_id, role, t, b, h, ln(1 + b * s) AS l, sum(ln(1 + b * s)) OVER (PARTITION BY user_id, role, b ORDER BY t) AS c FROM sc JOIN hz USING (user_id), bt)""",
        """ac AS (SELECT user_id, role, t, b, h, exp(c) * sum(exp(l - c) / h) OVER (PARTITION BY user_id, role, b ORDER BY t) AS a FROM lg)""",
        body="SELECT user_id, t AS shot_index, round(any_value((h - t) * 1.0 / h) + sum(a) / 40, 6) AS stat FROM ac GROUP BY user_id, t",
    ),
)
def shot_eprocess(spark, sf):
    rows = pair_bits(spark, sf).withColumn("rate", K.rate_score("r", "m"))
    out = K.shot_process(K.method_factors(rows, "rate"), ["user_id"], "role", ["pair"], [0.125] * 8, 5)
    return out.select("user_id", "shot_index", V.r6(F.col("stat")).alias("stat"))


@query("t20_shot_sr_composite")
def shot_sr(spark, sf):
    rows = paired_streams(spark, sf)
    longest = longest_group(rows, ["stream", "role"])
    bank, _ = K.score_bank(rows, ["stream", "role"], ["user_id", "pair"], "r", "m", 7, keep=["user_id", "pair"], longest=longest)
    weights = [w for _, w in K.component_priors(7)["composite"]]
    out = K.shot_process(K.method_factors(bank, "composite"), ["stream"], "role", ["user_id", "pair"], weights, 5, "sr", longest=longest)
    return out.select("stream", "shot_index", V.r6(F.col("log_stat"), 5).alias("log_stat"), "alarm")


@query("t21_warm_replay")
def warm_replay(spark, sf):
    """Warm on the first pairs of a user, replay the rest from a copy of that state."""
    rows = paired_streams(spark, sf)
    _, states = K.score_bank(rows.where("pair < 2"), ["stream", "role"], ["user_id", "pair"], "r", "m", 7)
    held, _ = K.score_bank(rows.where("pair >= 2"), ["stream", "role"], ["user_id", "pair"], "r", "m", 7, states, ["user_id", "pair"])
    out = K.empirical_scores(held, 7)
    return out.select("stream", "role", "user_id", "pair", V.r6(F.col("composite_score")).alias("composite_score"))


#: The fewest maxima that have a 1 % threshold.
REPLICATES = 99


@query("i05_bootstrap_max_e")
def bootstrap_max(spark, sf):
    rows = pair_bits(spark, sf)
    sizes = rows.groupBy("user_id").agg((F.max("pair") + 1).alias("n"))
    indices = R.keyed_blocks(sizes, ["user_id"], "n", 32, REPLICATES, seed=11)
    maxima, threshold = K.bootstrap_max_e(rows, ["user_id"], "role", "pair", "r", "m", 7, 5, "composite", indices, REPLICATES, None)
    found = maxima.join(threshold.select("user_id", "threshold"), "user_id")
    return found.select("user_id", "replicate", V.r6(F.col("max_log_e"), 5).alias("max_log_e"), V.r6(F.col("threshold"), 5).alias("threshold"))


@query("i06_swap_audit")
def swap_audit(spark, sf):
    methods = ("rate", "logistic", "sparse", "spectral", "composite")
    out = P.swap_audit_lockstep(pair_bits(spark, sf), ["user_id"], "role", ["pair"], "r", "m", 7, 5, REPLICATES, seed=12, methods=methods)
    values = [V.r6(F.col(c), 5).alias(c) for c in ("max_log_e", "final_log_e")]
    return out.select("user_id", "replicate", "method", "crossed", *values, "shots")


# supplied bits: replicate r swaps the shots whose number has bit r set; the rate method in plain SQL
@query(
    "i06_swap_audit_supplied",
    V.sql(
        V.PAIRS,
        """hz AS (SELECT user_id, count(DISTINCT pair) AS n FROM pairs GROUP BY 1)""",
        """sc AS (SELECT user_id, role, pair, q.r AS replicate, CASE WHEN (pair >> CAST(q.r AS INT)) & 1 = 1 THEN -1 ELSE 1 END * (bit_count(mon_k) - bit_count(ref_k)) / 7.0 AS s FROM pairs, range(4) q(r))""",
        """bt(b) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE), (0.9::DOUBLE), (-0.1::DOUBLE), (-0.3::DOUBLE), (-0.6::DOUBLE), (-0.9::DOUBLE))""",
        """lg AS (SELECT user_id, role, pair, replicate, b, row_number() OVER w AS t, ln(1 + b * s) AS l, sum(ln(1 + b * s)) OVER w AS c FROM sc, bt WINDOW w AS (PARTITION BY user_id, role, replicate, b ORDER BY pair))""",
        """ac AS (SELECT *, exp(c) * sum(exp(l - c)) OVER (PARTITION BY user_id, role, replicate, b ORDER BY pair) / n AS a FROM lg JOIN hz USING (user_id))""",
        """ev AS (SELECT user_id, replicate, t, ln(sum(a) / 40 + (any_value(n) - t) * 1.0 / any_value(n)) AS e FROM ac GROUP BY user_id, replicate, t)""",
        body="""SELECT user_id, replicate, 'rate' AS method, max(e) >= ln(1.5) AS crossed, min(t) FILTER (e >= ln(1.5)) AS first_crossing, round(greatest(0, max(e)), 6) + 0.0 AS max_log_e,
        round(arg_max(e, t), 6) + 0.0 AS final_log_e, count(*) AS shots FROM ev GROUP BY ALL""",
    ),
)
def swap_supplied(spark, sf):
    bits = lambda r: F.getbit("pair", r.cast("int")) == 1
    out = P.swap_audit_lockstep(pair_bits(spark, sf), ["user_id"], "role", ["pair"], "r", "m", 7, 5, 4, 0, ("rate",), alpha=1 / 1.5, bits=bits)
    values = [V.r6(F.col(c)).alias(c) for c in ("max_log_e", "final_log_e")]
    return out.select("user_id", "replicate", "method", "crossed", "first_crossing", *values, "shots")
