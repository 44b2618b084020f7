"""Encodings and row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.registry import query
from statewatch.functions import bits as B
from statewatch.functions import encode as E
from statewatch.operators import windows as W
from statewatch.operators.baselines import standardize


def cells(df, keep, column, digits=6):
    return df.select(*keep, F.posexplode(column).alias("i", "v")).select(
        *keep, "i", V.r6(F.col("v"), digits).alias("v")
    )


@query("f01_amplitude", V.sql(V.UNIT_LONG, body="SELECT vec_id, i, round(v, 6) AS v FROM ulong"))
def amplitude(spark, sf):
    return cells(V.vec(spark, sf).select("vec_id", E.encode("x", "Amplitude").alias("e")), ["vec_id"], "e")


@query(
    "f02_affine",
    V.sql(
        V.VEC_LONG,
        """lifted AS (SELECT vec_id, i, v FROM vlong UNION ALL SELECT vec_id, 64, 0.5 FROM vec)""",
        body="""SELECT vec_id, CAST(i AS INT) AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS v FROM lifted""",
    ),
)
def affine(spark, sf):
    return cells(V.vec(spark, sf).select("vec_id", E.encode("x", "affine-amplitude", 0.5).alias("e")), ["vec_id"], "e")


@query(
    "f03_stereographic",
    V.sql(
        V.VEC_LONG,
        """sq AS (SELECT vec_id, sum(v * v) AS q FROM vlong GROUP BY 1)""",
        body="""SELECT vec_id, i, round(4 * v / (q + 4), 6) + 0.0 AS v FROM vlong JOIN sq USING (vec_id)
        UNION ALL SELECT vec_id, 64, round((q - 4) / (q + 4), 6) FROM sq""",
    ),
)
def stereographic(spark, sf):
    return cells(V.vec(spark, sf).select("vec_id", E.encode("x", "STEREO", 2.0).alias("e")), ["vec_id"], "e")


HOT = ", ".join(f"CAST(event_type = '{c}' AS INT)::DOUBLE" for c in V.EVENT_TYPES)


@query(
    "f04_window_density",
    V.sql(
        V.CAT,
        """w AS (SELECT user_id, (t - 1) // 8 AS "window", event_type FROM cat)""",
        """full_w AS (SELECT user_id, "window" FROM w GROUP BY ALL HAVING count(*) = 8)""",
        f"""c AS (SELECT i, ['{"','".join(V.EVENT_TYPES)}'][i + 1] AS event_type FROM (SELECT CAST(i AS INT) AS i FROM range(5) r(i)))""",
        body="""SELECT f.user_id, f."window", c.i, round(count(w.event_type) / 8.0, 6) AS p
        FROM full_w f CROSS JOIN c LEFT JOIN w ON w.user_id = f.user_id AND w."window" = f."window"
          AND w.event_type = c.event_type GROUP BY ALL""",
    ),
)
def window_density(spark, sf):
    rows = V.cat(spark, sf).withColumn("x", E.one_hot("event_type", V.EVENT_TYPES))
    dens = W.window_density(rows, ["user_id"], ["ts", "event_id"], "x", 5, 8)
    diag = dens.select("user_id", "window", F.array(*[F.get("rho", F.lit(6 * i)) for i in range(5)]).alias("d"))
    return diag.select("user_id", "window", F.posexplode("d").alias("i", "p")).withColumn("p", V.r6(F.col("p")))


@query(
    "f05_pad_pow2",
    V.sql(
        V.GRID_LONG,
        body="""SELECT p_partkey, v AS i, CAST(b AS DOUBLE) AS v FROM glong UNION ALL
        SELECT p_partkey, CAST(i AS INT), 0.0 FROM grid, range(9, 16) r(i)""",
    ),
)
def pad(spark, sf):
    return cells(V.grid(spark, sf).select("p_partkey", E.pad_pow2("bits").alias("e")), ["p_partkey"], "e")


@query(
    "f06_standardize",
    """WITH t AS (SELECT avg(l_quantity) AS m0, stddev_pop(l_quantity) AS s0, avg(l_tax) AS m1, stddev_pop(l_tax) AS s1,
      avg(1.0) AS m2, stddev_pop(1.0) AS s2 FROM lineitem WHERE l_linestatus = 'F')
    SELECT l_returnflag AS flag, round(sum((l_quantity - m0) / s0), 4) + 0.0 AS z0, round(sum((l_tax - m1) / s1), 4) + 0.0 AS z1,
      round(sum((1.0 - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END), 4) + 0.0 AS z2 FROM lineitem, t GROUP BY 1""",
)
def standardized(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), "l_linestatus", F.array("l_quantity", "l_tax", F.lit(1.0)).alias("x")
    )
    out = standardize(rows.where("l_linestatus = 'F'"), rows, "x", 3)
    return out.groupBy("flag").agg(*[V.r6(F.sum(F.get("x", F.lit(i))), 4).alias(f"z{i}") for i in range(3)])


@query(
    "f07_one_hot",
    V.sql(
        V.CAT,
        body="SELECT user_id, "
        + ", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{c}') AS DOUBLE) AS {c}_n" for c in V.EVENT_TYPES)
        + " FROM cat GROUP BY user_id",
    ),
)
def one_hot(spark, sf):
    rows = V.cat(spark, sf).withColumn("x", E.one_hot("event_type", V.EVENT_TYPES))
    return rows.groupBy("user_id").agg(
        *[F.sum(F.get("x", F.lit(i))).alias(f"{c}_n") for i, c in enumerate(V.EVENT_TYPES)]
    )


PAIR_EQ = """feat AS (SELECT user_id, shot, role, chk AS f, CAST(bit AS DOUBLE) AS v FROM bits_long UNION ALL
  SELECT a.user_id, a.shot, a.role, CAST(7 + a.chk * 6 - (a.chk * (a.chk - 1)) // 2 + b.chk - a.chk - 1 AS INT),
    CAST(a.bit = b.bit AS INT)::DOUBLE FROM bits_long a JOIN bits_long b USING (user_id, shot, role) WHERE a.chk < b.chk)"""


@query(
    "f08_pair_equality",
    V.sql(V.BITS_LONG, PAIR_EQ, body="SELECT user_id, role, f, sum(v) AS v FROM feat GROUP BY ALL"),
)
def pair_equality(spark, sf):
    rows = V.bits(spark, sf).select("user_id", "role", B.pair_equality(unpacked()).alias("x"))
    long = rows.select("user_id", "role", F.posexplode("x").alias("f", "v"))
    return long.groupBy("user_id", "role", "f").agg(F.sum("v").alias("v"))


def unpacked(name="k"):
    return B.unpack(name, 7)


@query(
    "f09_spin_density",
    V.sql(
        V.BITS_LONG,
        body="""SELECT a.user_id, CAST(a.chk * 7 + b.chk AS INT) AS i, round(avg((1 - 2 * a.bit) * (1 - 2 * b.bit) / 7.0), 6) + 0.0 AS v
        FROM bits_long a JOIN bits_long b USING (user_id, shot, role) GROUP BY ALL""",
    ),
)
def spin_density(spark, sf):
    rows = V.bits(spark, sf).select("user_id", B.spin_density(unpacked()).alias("x"))
    long = rows.select("user_id", F.posexplode("x").alias("i", "v"))
    return long.groupBy("user_id", "i").agg(V.r6(F.avg("v")).alias("v"))


@query(
    "f10_firing_rate",
    V.sql(V.BITS, body="SELECT user_id, shot, role, round(bit_count(k) / 7.0, 6) AS rate FROM bits"),
)
def firing_rate(spark, sf):
    return V.bits(spark, sf).select("user_id", "shot", "role", V.r6(B.firing_rate(unpacked())).alias("rate"))


@query(
    "f11_paired_contrast",
    V.sql(
        V.PAIRS_LONG,
        """eq AS (SELECT a.user_id, a.pair, a.role, sum(CAST(a.m = b.m AS INT) - CAST(a.r = b.r AS INT)) AS d,
          sum((1 - 2 * a.m) * (1 - 2 * b.m) - (1 - 2 * a.r) * (1 - 2 * b.r)) / 7.0 AS z
          FROM pairs_long a JOIN pairs_long b USING (user_id, pair, role) WHERE a.chk < b.chk GROUP BY ALL)""",
        """fr AS (SELECT user_id, pair, role, sum(m - r) / 7.0 AS rate, sum(m - r) AS ones FROM pairs_long GROUP BY ALL)""",
        body="""SELECT user_id, pair, role, round(rate, 6) + 0.0 AS rate, CAST(ones + d AS DOUBLE) AS feature_sum,
        round(2 * z, 6) + 0.0 AS density_sum FROM fr JOIN eq USING (user_id, pair, role)""",
    ),
)
def paired_contrast(spark, sf):
    rows = V.pairs(spark, sf).withColumn("c", B.paired_contrast(unpacked("ref_k"), unpacked("mon_k")))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        "user_id", "pair", "role", V.r6(F.col("c.rate")).alias("rate"),
        add("c.features").alias("feature_sum"), V.r6(add("c.density")).alias("density_sum"),
    )


GRID_STATS = """st AS (SELECT a.p_partkey, avg(1 - 2 * a.b) AS z,
  avg((1 - 2 * a.b) * (1 - 2 * h1.b) + (1 - 2 * a.b) * (1 - 2 * v1.b)) / 2 AS g1,
  avg((1 - 2 * a.b) * (1 - 2 * h2.b) + (1 - 2 * a.b) * (1 - 2 * v2.b)) / 2 AS g2
  FROM glong a
  JOIN glong h1 ON h1.p_partkey = a.p_partkey AND h1.v = (a.v // 3) * 3 + (a.v % 3 + 1) % 3
  JOIN glong v1 ON v1.p_partkey = a.p_partkey AND v1.v = (a.v // 3 + 1) % 3 * 3 + a.v % 3
  JOIN glong h2 ON h2.p_partkey = a.p_partkey AND h2.v = (a.v // 3) * 3 + (a.v % 3 + 2) % 3
  JOIN glong v2 ON v2.p_partkey = a.p_partkey AND v2.v = (a.v // 3 + 2) % 3 * 3 + a.v % 3
  GROUP BY 1)"""


@query(
    "f12_grid_pair_stats",
    V.sql(V.GRID_LONG, GRID_STATS,
          body="SELECT p_partkey, round(z, 6) + 0.0 AS z, round(g1, 6) + 0.0 AS g1, round(g2, 6) + 0.0 AS g2 FROM st"),
)
def grid_stats(spark, sf):
    rows = V.grid(spark, sf).withColumn("s", B.grid_pair_stats("bits", 3))
    return rows.select("p_partkey", *[V.r6(F.col(f"s.{c}")).alias(c) for c in ("z", "g1", "g2")])


@query(
    "f13_power_spectrum",
    V.sql(
        V.VEC_LONG,
        """dft AS (SELECT a.vec_id, f.f, sum(a.v * cos(2 * pi() * f.f * a.i / 64)) AS re, sum(a.v * sin(2 * pi() * f.f * a.i / 64)) AS im
          FROM vlong a, (SELECT CAST(f AS INT) AS f FROM range(64) r(f)) f GROUP BY ALL)""",
        body="""SELECT vec_id, f AS i, round((re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY vec_id), 6) AS v FROM dft""",
    ),
)
def power(spark, sf):
    return cells(V.vec(spark, sf).select("vec_id", E.power_spectrum("x").alias("e")), ["vec_id"], "e")


POWER2D = """dft2 AS (SELECT p_partkey, u, w, sum((1 - 2 * b) * cos(2 * pi() * (u * (v // 3) + w * (v % 3)) / 3)) AS re,
  sum((1 - 2 * b) * sin(2 * pi() * (u * (v // 3) + w * (v % 3)) / 3)) AS im
  FROM glong, range(3) r(u), range(3) s(w) GROUP BY ALL),
pow2d AS (SELECT p_partkey, CAST(u * 3 + w AS INT) AS i, (re * re + im * im) / 81.0 AS v FROM dft2)"""


@query("f14_power_spectrum_2d", V.sql(V.GRID_LONG, POWER2D, body="SELECT p_partkey, i, round(v, 6) AS v FROM pow2d"))
def power2d(spark, sf):
    return cells(V.grid(spark, sf).select("p_partkey", B.power_state_2d("bits", 3).alias("e")), ["p_partkey"], "e")


@query(
    "f15_orbit_sum",
    V.sql(
        V.GRID_LONG,
        POWER2D,
        """orb AS (SELECT CAST(i AS INT) AS i, CASE WHEN i = 0 THEN 0 WHEN i IN (1, 2, 3, 6) THEN 1 ELSE 2 END AS o FROM range(9) r(i))""",
        body="SELECT p_partkey, o AS i, round(sum(v), 6) AS v FROM pow2d JOIN orb USING (i) GROUP BY ALL",
    ),
)
def orbits(spark, sf):
    rows = V.grid(spark, sf).withColumn("p", B.power_state_2d("bits", 3))
    return cells(rows.select("p_partkey", B.orbit_sum("p", B.mode_orbits(3)).alias("e")), ["p_partkey"], "e")


@query(
    "f16_pair_lift",
    V.sql(
        V.GRID_LONG,
        GRID_STATS,
        """o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t, z, g1, g2
          FROM st JOIN grid USING (p_partkey))""",
        body="""SELECT a.p_brand, CAST((a.t - 1) // 2 AS BIGINT) AS pair, round(a.z * b.g1, 6) + 0.0 AS zg, round(a.g2 * b.g2, 6) + 0.0 AS gg
        FROM o a JOIN o b ON a.p_brand = b.p_brand AND a.t % 2 = 1 AND b.t = a.t + 1""",
    ),
)
def lift(spark, sf):
    rows = V.grid(spark, sf).withColumn("s", B.grid_pair_stats("bits", 3))
    rows = rows.select("p_brand", "p_partkey", F.array("s.z", "s.g1", "s.g2").alias("x"))
    out = W.pair_lift(rows, ["p_brand"], ["p_partkey"], "x", check=False)
    return out.select(
        "p_brand", "pair", V.r6(F.get("lift", F.lit(1))).alias("zg"), V.r6(F.get("lift", F.lit(8))).alias("gg")
    )


FAMILY = """o AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS t FROM grid),
w AS (SELECT p_brand, p_partkey, t // 4 AS "window", t % 4 AS c FROM o),
fw AS (SELECT p_brand, "window" FROM w GROUP BY ALL HAVING count(*) = 4),
wf AS (SELECT w.* FROM w JOIN fw USING (p_brand, "window")),
rate AS (SELECT p_partkey, avg(b) AS r FROM glong GROUP BY 1),
orbp AS (SELECT p_partkey, sum(v) FILTER (WHERE i IN (1, 2, 3, 6)) AS o1 FROM pow2d GROUP BY 1)"""


@query(
    "f17_window_features_spatial",
    V.sql(
        V.GRID_LONG, GRID_STATS, POWER2D, FAMILY,
        body="""SELECT p_brand, "window", round(max(r) FILTER (WHERE c = 2), 6) AS third_count,
        round(avg(CAST(x.b AS DOUBLE)), 6) AS site4, round(avg(g1), 6) + 0.0 AS g1, round(avg(o1), 6) AS orbit1
        FROM wf JOIN rate USING (p_partkey) JOIN st USING (p_partkey) JOIN orbp USING (p_partkey)
        JOIN (SELECT p_partkey, b FROM glong WHERE v = 4) x USING (p_partkey) GROUP BY ALL""",
    ),
)
def families_spatial(spark, sf):
    out = W.window_features(V.grid(spark, sf), ["p_brand"], ["p_partkey"], "bits", 3, 4, "spatial")
    return out.select(
        "p_brand", "window", V.r6(F.get("counts", F.lit(2))).alias("third_count"),
        V.r6(F.get("first_moment", F.lit(4))).alias("site4"), V.r6(F.get("translation", F.lit(1))).alias("g1"),
        V.r6(F.get("orbit_power", F.lit(1))).alias("orbit1"),
    )


@query(
    "f17_window_features_temporal",
    V.sql(
        V.GRID_LONG, GRID_STATS, POWER2D, FAMILY,
        body="""SELECT a.p_brand, a."window", round(avg(sa.z * sb.g2), 6) + 0.0 AS z_g2, round(avg(oa.o1 * ob.o1), 6) AS orbit11
        FROM wf a JOIN wf b ON a.p_brand = b.p_brand AND a."window" = b."window" AND a.c % 2 = 0 AND b.c = a.c + 1
        JOIN st sa ON sa.p_partkey = a.p_partkey JOIN st sb ON sb.p_partkey = b.p_partkey
        JOIN orbp oa ON oa.p_partkey = a.p_partkey JOIN orbp ob ON ob.p_partkey = b.p_partkey GROUP BY ALL""",
    ),
)
def families_temporal(spark, sf):
    out = W.window_features(V.grid(spark, sf), ["p_brand"], ["p_partkey"], "bits", 3, 4, "temporal")
    return out.select(
        "p_brand", "window", V.r6(F.get("translation", F.lit(2))).alias("z_g2"),
        V.r6(F.get("orbit_power", F.lit(4))).alias("orbit11"),
    )


@query(
    "f18_pair_products",
    V.sql(
        V.GRID_LONG,
        body="""SELECT a.p_brand, d.d AS displacement, a.v AS pair_site, round(avg((1 - 2 * a.b) * (1 - 2 * b.b)), 6) + 0.0 AS v
        FROM glong a CROSS JOIN (SELECT 0 AS d, 0 AS dr, 1 AS dc UNION ALL SELECT 1, 1, 1) d
        JOIN glong b ON b.p_partkey = a.p_partkey AND b.v = (a.v // 3 + d.dr) % 3 * 3 + (a.v % 3 + d.dc) % 3 GROUP BY ALL""",
    ),
)
def products(spark, sf):
    bank = W.pair_bank(3, [(0, 1), (1, 1)])
    out = W.pair_products(V.grid(spark, sf), ["p_brand"], "bits", bank)
    site = F.pmod("pair", F.lit(9)).cast("int")
    return out.groupBy("p_brand", "displacement", site.alias("pair_site")).agg(V.r6(F.avg("value")).alias("v"))


@query(
    "f19_shadow_products",
    V.sql(
        V.GRID_LONG,
        """m AS (SELECT p_partkey, p_brand, v, 1 - 2 * b AS o, (p_partkey + v * v) % 3 AS basis FROM glong)""",
        body="""SELECT a.p_brand, a.v AS pair_site, round(avg(CASE WHEN a.basis = 2 AND b.basis = 2 THEN 9.0 * a.o * b.o ELSE 0 END), 6) + 0.0 AS v
        FROM m a JOIN m b ON b.p_partkey = a.p_partkey AND b.v = (a.v // 3) * 3 + (a.v % 3 + 1) % 3 GROUP BY ALL""",
    ),
)
def shadows(spark, sf):
    sites = F.sequence(F.lit(0), F.lit(8))
    bases = F.transform(sites, lambda v: F.pmod(F.col("p_partkey") + v * v, F.lit(3)).cast("int"))
    rows = V.grid(spark, sf).withColumn("bases", bases).withColumn("outcomes", B.signs("bits"))
    out = W.shadow_products(rows, ["p_brand"], "bases", "outcomes", W.pair_bank(3, [(0, 1)]))
    return out.groupBy("p_brand", F.col("pair").alias("pair_site")).agg(V.r6(F.avg("value")).alias("v"))
