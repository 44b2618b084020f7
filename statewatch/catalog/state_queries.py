"""Additive states and group statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.registry import query
from statewatch.functions import bits as B
from statewatch.functions import encode as E
from statewatch.operators import marginals as M
from statewatch.operators import states as S

VEC2_STATE = """st2 AS (SELECT label, count(*) AS n, avg(x * x / (x * x + y * y)) AS a, avg(x * y / (x * x + y * y)) AS b,
  avg(y * y / (x * x + y * y)) AS c FROM vec2 GROUP BY label)"""


def pick(flat, *spots, digits=6):
    return [V.r6(F.get(flat, F.lit(i)), digits) for i in spots]


@query(
    "a01_additive_state",
    V.sql(
        V.UNIT_LONG,
        body="""SELECT a.label, a.i, b.i AS j, count(*) AS n, CAST(sum(a.vec_id % 3 + 1) AS DOUBLE) AS mass,
        round(sum((a.vec_id % 3 + 1) * a.v * b.v), 6) + 0.0 AS v FROM ulong a JOIN ulong b USING (vec_id) GROUP BY ALL""",
    ),
)
def additive(spark, sf):
    """Weighted state per class; 64 dimensions take the Arrow path."""
    rows = V.vec(spark, sf).withColumn("w", F.pmod("vec_id", F.lit(3)) + 1)
    state = S.additive_state(rows, ["label"], "x", 64, "w")
    out = S.entries(state, ["label", "n", "mass"], "acc", 64)
    return out.select("label", "i", "j", "n", "mass", V.r6(F.col("value")).alias("v"))


@query(
    "a01_additive_state_narrow",
    V.sql(V.VEC2, VEC2_STATE, body="""SELECT label, n, round(a, 6) AS a, round(b, 6) + 0.0 AS b, round(c, 6) AS c FROM st2"""),
)
def additive_narrow(spark, sf):
    """Two dimensions: plain sums over every line item."""
    state = S.additive_state(V.vec2(spark, sf), ["label"], "x", 2).withColumn("rho", S.density())
    a, b, c = pick("rho", 0, 1, 3)
    return state.select("label", "n", a.alias("a"), b.alias("b"), c.alias("c"))


@query(
    "a02_merge_states",
    V.sql(V.VEC2, VEC2_STATE, body="""SELECT label, n, CAST(n AS DOUBLE) AS mass, round(n * a, 4) AS a, round(n * b, 4) + 0.0 AS b FROM st2"""),
)
def merge(spark, sf):
    rows = V.vec2(spark, sf).withColumn("part", F.pmod(F.xxhash64("x"), F.lit(3)))
    parts = [S.additive_state(rows.where(F.col("part") == i), ["label"], "x", 2) for i in range(3)]
    a, b = pick("acc", 0, 1, digits=4)
    return S.merge_states(["label"], *parts).select("label", "n", "mass", a.alias("a"), b.alias("b"))


@query(
    "a03_remove_rows",
    """SELECT l_linestatus AS label, CAST(count(*) AS DOUBLE) AS mass,
      round(sum(x * x / (x * x + y * y)), 4) AS a, round(sum(x * y / (x * x + y * y)), 4) + 0.0 AS b
    FROM (SELECT l_linestatus, l_quantity - 25.5 AS x, (l_discount - 0.05) * 100 AS y FROM lineitem WHERE l_returnflag <> 'R')
    GROUP BY 1""",
)
def remove(spark, sf):
    items = V.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("label"), "l_returnflag",
        F.array(F.col("l_quantity") - 25.5, (F.col("l_discount") - 0.05) * 100).alias("x"),
    )
    everything = S.additive_state(items, ["label"], "x", 2)
    gone = S.additive_state(items.where("l_returnflag = 'R'"), ["label"], "x", 2)
    a, b = pick("acc", 0, 1, digits=4)
    return S.remove_from_state(everything, gone, ["label"]).select("label", "mass", a.alias("a"), b.alias("b"))


def hot(spark, sf):
    return V.cat(spark, sf).withColumn("x", E.one_hot("event_type", V.EVENT_TYPES))


CATS = "c(i, event_type) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(V.EVENT_TYPES)) + ")"


@query(
    "a04_decayed_state",
    V.sql(
        V.CAT, CATS,
        """age AS (SELECT user_id, event_type, pow(0.9, count(*) OVER (PARTITION BY user_id) - t) AS w FROM cat)""",
        body="""SELECT user_id, i, round(coalesce(sum(w) FILTER (WHERE age.event_type = c.event_type), 0), 6) AS v,
        round(sum(w), 6) AS mass FROM age CROSS JOIN c GROUP BY ALL""",
    ),
)
def decayed(spark, sf):
    state = S.decayed_state(hot(spark, sf), ["user_id"], ["ts", "event_id"], "x", 5, 0.9)
    diag = F.array(*[F.get("acc", F.lit(6 * i)) for i in range(5)])
    return state.select("user_id", V.r6(F.col("mass")).alias("mass"), F.posexplode(diag).alias("i", "v")).withColumn("v", V.r6(F.col("v")))


@query(
    "a05_class_densities",
    V.sql(
        V.VEC2, VEC2_STATE,
        body="""SELECT label, n, round(n * 1.0 / sum(n) OVER (), 6) AS prior, round(a, 6) AS a, round(b, 6) + 0.0 AS b, 0.5 AS balanced,
        CASE label WHEN 'F' THEN 0.25 ELSE 0.75 END AS given FROM st2""",
    ),
)
def densities(spark, sf):
    rows = V.vec2(spark, sf)
    found = S.class_densities(rows, "label", "x", 2)
    even = S.class_densities(rows, "label", "x", 2, "balanced").select("label", F.col("prior").alias("balanced"))
    given = S.class_densities(rows, "label", "x", 2, {"F": 1.0, "O": 3.0}).select("label", F.col("prior").alias("given"))
    a, b = pick("rho", 0, 1)
    out = found.select("label", "n", V.r6(F.col("prior")).alias("prior"), a.alias("a"), b.alias("b"))
    return out.join(even, "label").join(given, "label")


@query(
    "a06_sliding_state",
    V.sql(
        V.CAT,
        body="SELECT user_id, t, CAST(count(*) OVER w AS DOUBLE) AS mass, count(*) OVER w = 16 AS \"full\", "
        + ", ".join(f"round(sum(CAST(event_type = '{c}' AS INT)) OVER w * 1.0 / count(*) OVER w, 6) AS p{i}" for i, c in enumerate(V.EVENT_TYPES))
        + " FROM cat WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS 15 PRECEDING)",
    ),
)
def sliding(spark, sf):
    out = S.sliding_state(hot(spark, sf), ["user_id"], ["ts", "event_id"], "x", 5, 16)
    share = [V.r6(F.get("acc", F.lit(6 * i)) / F.col("mass")).alias(f"p{i}") for i in range(5)]
    return out.select("user_id", "t", "mass", "full", *share)


@query(
    "a07_check_density",
    V.sql(
        V.VEC2, VEC2_STATE,
        body="""SELECT label, round(a + c, 6) AS trace, round((a + c - sqrt((a - c) ^ 2 + 4 * b ^ 2)) / 2, 6) AS smallest, true AS "valid" FROM st2""",
    ),
)
def check(spark, sf):
    state = S.additive_state(V.vec2(spark, sf), ["label"], "x", 2).withColumn("rho", S.density())
    out = S.check_density(state, ["label"], "rho")
    return out.select("label", V.r6(F.col("trace")).alias("trace"), V.r6(F.col("smallest")).alias("smallest"), "valid")


@query(
    "a08_permutation_twirl",
    V.sql(V.VEC2, VEC2_STATE, body="SELECT label, round((a + c) / 2, 6) AS d, round(b, 6) + 0.0 AS o FROM st2"),
)
def permutation_twirl(spark, sf):
    state = S.additive_state(V.vec2(spark, sf), ["label"], "x", 2).withColumn("rho", S.density())
    d, o = pick("rho", 0, 1)
    return S.permutation_twirl(state, "rho", [[0, 1], [1, 0]]).select("label", d.alias("d"), o.alias("o"))


@query(
    "a08_group_twirl",
    V.sql(V.VEC2, VEC2_STATE, body="SELECT label, round(a, 6) AS d, 0.0 AS o, round(c, 6) AS e FROM st2"),
)
def group_twirl(spark, sf):
    """Sign flips of one coordinate remove the off-diagonal entry."""
    state = S.additive_state(V.vec2(spark, sf), ["label"], "x", 2).withColumn("rho", S.density())
    out = S.twirl(state, "rho", [np.eye(2), np.diag([1.0, -1.0])])
    d, o, e = pick("rho", 0, 1, 3)
    return out.select("label", d.alias("d"), o.alias("o"), e.alias("e"))


@query(
    "a09_cyclic_twirl",
    V.sql(
        V.UNIT_LONG,
        """rho AS (SELECT a.label, a.i, b.i AS j, sum(a.v * b.v) / count(*) AS v FROM ulong a JOIN ulong b USING (vec_id) GROUP BY ALL)""",
        body="""SELECT label, CAST((i - j + 64) % 64 AS INT) AS "offset", round(avg(v), 7) + 0.0 AS v FROM rho GROUP BY ALL""",
    ),
)
def cyclic(spark, sf):
    state = S.additive_state(V.vec(spark, sf), ["label"], "x", 64).withColumn("rho", S.density())
    out = S.cyclic_twirl(state, "rho", 64)
    column = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda o: F.get("rho", o * 64))
    return out.select("label", F.posexplode(column).alias("offset", "v")).withColumn("v", V.r6(F.col("v"), 7))


@query(
    "a10_moments",
    """SELECT l_returnflag AS label, count(*) AS n, round(avg(l_quantity), 6) AS m0, round(avg(l_discount), 6) AS m1,
      round(covar_samp(l_quantity, l_quantity), 4) AS c00, round(covar_samp(l_quantity, l_discount), 6) + 0.0 AS c01,
      round(covar_samp(l_discount, l_discount), 6) AS c11 FROM lineitem GROUP BY 1""",
)
def moment_rows(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.array("l_quantity", "l_discount").alias("x")
    )
    out = S.moments(rows, ["label"], "x", 2)
    m0, m1 = pick("mean", 0, 1)
    c01, c11 = pick("cov", 1, 3)
    c00 = V.r6(F.get("cov", F.lit(0)), 4)
    return out.select("label", "n", m0.alias("m0"), m1.alias("m1"), c00.alias("c00"), c01.alias("c01"), c11.alias("c11"))


@query(
    "a11_ledoit_wolf",
    V.sql(
        V.VEC2,
        """res AS (SELECT x - avg(x) OVER (PARTITION BY label) AS x, y - avg(y) OVER (PARTITION BY label) AS y FROM vec2)""",
        """s AS (SELECT count(*) AS n, avg(x * x) AS a, avg(x * y) AS b, avg(y * y) AS c, avg((x * x + y * y) ^ 2) AS q FROM res)""",
        """k AS (SELECT *, (a + c) / 2 AS mu, (a * a + 2 * b * b + c * c - 2 * ((a + c) / 2) ^ 2) / 2 AS delta,
          (q - (a * a + 2 * b * b + c * c)) / (2 * n) AS beta FROM s)""",
        """r AS (SELECT *, CASE WHEN delta <= 0 THEN 0 ELSE least(greatest(beta, 0), delta) / delta END AS rate FROM k)""",
        """m AS (SELECT n, rate, (1 - rate) * a + rate * mu AS a, (1 - rate) * b AS b, (1 - rate) * c + rate * mu AS c FROM r)""",
        body="""SELECT n, round(rate, 8) AS shrinkage, round(c / (a * c - b * b), 8) AS p00, round(-b / (a * c - b * b), 8) + 0.0 AS p01 FROM m""",
    ),
)
def shrinkage(spark, sf):
    out = S.ledoit_wolf(V.vec2(spark, sf), ["label"], "x", 2)
    p00, p01 = pick("precision", 0, 1, digits=8)
    return out.select("n", V.r6(F.col("shrinkage"), 8).alias("shrinkage"), p00.alias("p00"), p01.alias("p01"))


@query(
    "a12_bernoulli_profile",
    V.sql(
        V.PAIRS_LONG,
        body="""SELECT role, chk, round(least(greatest((sum(r + m) + 0.5) / (2 * count(*) + 1), 1e-4), 1 - 1e-4), 8) AS p
        FROM pairs_long GROUP BY ALL""",
    ),
)
def profile(spark, sf):
    out = M.bernoulli_profile(pair_bits(spark, sf), ["role"], "r", "m")
    return out.withColumn("p", V.r6(F.col("p"), 8))


def pair_bits(spark, sf):
    return V.pairs(spark, sf).select("user_id", "pair", "role", B.unpack("ref_k", 7).alias("r"), B.unpack("mon_k", 7).alias("m"))


@query(
    "a13_mmd2",
    V.sql(
        V.UNIT_LONG,
        """g AS (SELECT a.label AS la, b.label AS lb, sum(a.v * b.v) ^ 2 AS k FROM ulong a JOIN ulong b ON a.i = b.i
          WHERE a.label IN (0, 1) AND b.label IN (0, 1) GROUP BY a.vec_id, b.vec_id, a.label, b.label)""",
        body="""SELECT round(avg(k) FILTER (WHERE la = 0 AND lb = 0) + avg(k) FILTER (WHERE la = 1 AND lb = 1)
        - 2 * avg(k) FILTER (WHERE la = 0 AND lb = 1), 8) AS mmd2 FROM g""",
    ),
)
def mmd(spark, sf):
    """The SQL side compares all pairs of rows; Spark compares two 64 x 64 states."""
    return S.mmd2(V.vec(spark, sf), "label", "x", 64, 0, 1).select(V.r6(F.col("mmd2"), 8).alias("mmd2"))


@query(
    "a14_hamming_witness",
    V.sql(
        V.GRID,
        """c AS (SELECT p_partkey, code, CAST(p_partkey % 2 AS INT) AS cls FROM grid)""",
        """p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY (code * 7919) % 1009, p_partkey) AS r FROM c) WHERE r <= 12)""",
        """d AS (SELECT bit_count(xor(a.code, b.code)) / 9.0 AS g FROM p a JOIN p b ON a.p_partkey < b.p_partkey)""",
        """w AS (SELECT ln(2) / median(g) AS gamma FROM d WHERE g > 0)""",
        body="""SELECT c.p_partkey, round(avg(exp(-gamma * bit_count(xor(c.code, p.code)) / 9.0)) FILTER (WHERE p.cls = 1)
        - avg(exp(-gamma * bit_count(xor(c.code, p.code)) / 9.0)) FILTER (WHERE p.cls = 0), 6) + 0.0 AS score
        FROM c CROSS JOIN p CROSS JOIN w GROUP BY c.p_partkey""",
    ),
)
def hamming(spark, sf):
    from statewatch.plans import place

    rows = V.grid(spark, sf).select(
        "p_partkey", "code", F.array(F.col("code").cast("bigint")).alias("words"), F.pmod("p_partkey", F.lit(2)).cast("int").alias("cls")
    )
    ranked = place(rows, ["cls"], [F.pmod(F.col("code") * 7919, F.lit(1009)), "p_partkey"], "r").rows()
    witness = M.fit_hamming(ranked.where("r <= 12"), "cls", "words", 9)
    return rows.select("p_partkey", V.r6(witness.score("words")).alias("score"))


def _gap_sql(columns):
    return f"""SELECT '{"+".join(columns)}' AS columns, {len(columns)} AS k, round(0.5 * sum(abs(a * 1.0 / na - b * 1.0 / nb)), 8) AS distance FROM
      (SELECT {", ".join(columns)}, count(*) FILTER (WHERE cls = 1) AS a, count(*) FILTER (WHERE cls = 0) AS b FROM t GROUP BY ALL),
      (SELECT count(*) FILTER (WHERE cls = 1) AS na, count(*) FILTER (WHERE cls = 0) AS nb FROM t)"""


GAP_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "a15_marginal_gap",
    V.sql(
        """t AS (SELECT l_returnflag, l_linestatus, l_linenumber, CAST(l_tax > 0.04 AS INT) AS cls FROM lineitem)""",
        body=" UNION ALL ".join(
            _gap_sql(c) for c in [[a] for a in GAP_COLUMNS] + [[a, b] for i, a in enumerate(GAP_COLUMNS) for b in GAP_COLUMNS[i + 1 :]]
        ),
    ),
)
def marginal_gap(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(*GAP_COLUMNS, (F.col("l_tax") > 0.04).cast("int").alias("cls"))
    out = M.marginal_gap(rows, "cls", GAP_COLUMNS, 2, 1, 0)
    return out.withColumn("distance", V.r6(F.col("distance"), 8))


@query(
    "a15_count_gap",
    V.sql(
        V.BITS,
        """c AS (SELECT bit_count(k) AS e, count(*) FILTER (shot % 2 = 1) AS a, count(*) FILTER (shot % 2 = 0) AS b FROM bits GROUP BY 1)""",
        body="""SELECT 'events' AS columns, 1 AS k, round(0.5 * sum(abs(a * 1.0 / (SELECT sum(a) FROM c) - b * 1.0 / (SELECT sum(b) FROM c))), 8) + 0.0 AS distance FROM c""",
    ),
)
def count_gap(spark, sf):
    """Event counts of odd and even shots."""
    rows = V.bits(spark, sf).select(B.unpack("k", 7).alias("bits"), F.pmod("shot", F.lit(2)).cast("int").alias("cls"))
    return M.count_gap(rows, "cls", "bits", 1, 0).withColumn("distance", V.r6(F.col("distance"), 8))


@query(
    "a16_parity_scan",
    V.sql(
        V.BITS,
        """masks AS (SELECT m, bit_count(m) AS k FROM (SELECT CAST(m AS INT) AS m FROM range(1, 128) r(m)) WHERE bit_count(m) <= 3)""",
        """g AS (SELECT m, k, abs(avg(1 - 2 * (bit_count(kk & m) % 2)) FILTER (WHERE shot % 2 = 1)
          - avg(1 - 2 * (bit_count(kk & m) % 2)) FILTER (WHERE shot % 2 = 0)) AS gap FROM (SELECT k AS kk, shot FROM bits) b, masks GROUP BY ALL)""",
        body="""SELECT CAST(k AS INT) AS k, count(*) AS subsets, count(*) FILTER (WHERE gap > 1e-12) AS nonzero, round(max(gap), 8) AS max_gap FROM g GROUP BY k""",
    ),
)
def parity(spark, sf):
    rows = V.bits(spark, sf).withColumn("cls", F.pmod("shot", F.lit(2)).cast("int"))
    out = M.parity_scan(rows, "cls", "k", 7, 3)
    return out.select("k", "subsets", "nonzero", V.r6(F.col("max_gap"), 8).alias("max_gap"))


@query(
    "a17_marginal_deviation",
    V.sql(
        V.BITS_LONG,
        """m AS (SELECT role, chk, avg(bit) AS rate FROM bits_long GROUP BY ALL)""",
        body="""SELECT role, round(avg(rate), 8) AS mean_rate, round(max(abs(rate - (0.4 + 0.02 * chk))), 8) AS max_gap FROM m GROUP BY role""",
    ),
)
def deviation(spark, sf):
    rows = V.bits(spark, sf).select("role", B.unpack("k", 7).alias("bits"))
    expected = spark.createDataFrame([(r, c, 0.4 + 0.02 * c) for r in range(5) for c in range(7)], "role int, chk int, p double")
    out = M.marginal_deviation(rows, "role", "bits", expected)
    return out.select("role", V.r6(F.col("mean_rate"), 8).alias("mean_rate"), V.r6(F.col("max_gap"), 8).alias("max_gap"))
