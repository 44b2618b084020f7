"""Views over the shared tables that give them the shapes the operators expect, in both dialects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewatch.functions.bits import unpack
from statewatch.plans import place

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def r6a(c: Column | str, digits: int = 6) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: r6(x, digits))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def cat(spark: SparkSession, sf: str) -> DataFrame:
    """Categorical stream; order it by (ts, event_id)."""
    return events(spark, sf).select("user_id", "ts", "event_id", "event_type")


def score(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded score stream in [-1, 1]."""
    s = F.least(F.greatest((F.col("value") - 50) / 200, F.lit(-1.0)), F.lit(1.0))
    return events(spark, sf).select("user_id", "ts", "event_id", s.alias("s"))


def bits(spark: SparkSession, sf: str) -> DataFrame:
    """7-bit codes as (shot, role), five roles per shot."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = events(spark, sf).select("user_id", "ts", "event_id", k.alias("k"))
    placed = place(rows, ["user_id"], ["ts", "event_id"], "rn").rows()
    i = F.col("rn") - 1
    return placed.select(
        "user_id", F.floor(i / 5).cast("bigint").alias("shot"), F.pmod(i, F.lit(5)).cast("int").alias("role"), "k"
    )


def bits_long(spark: SparkSession, sf: str) -> DataFrame:
    return bits(spark, sf).select("user_id", "shot", "role", F.posexplode(unpack("k", 7)).alias("chk", "bit"))


def numbered_shots(rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``shot`` counted from 0 over all users of a key, so that no two users share a number; a user's shots follow those of the one before."""
    shots = place(rows.select(*key, "user_id", "shot").distinct(), key, ["user_id", "shot"], "_at").rows()
    joined = rows.join(shots, [*key, "user_id", "shot"])
    return joined.drop("shot").withColumn("shot", F.col("_at") - 1).drop("_at")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """First half of a user's complete shots is the reference, second half the monitor side."""
    b = bits(spark, sf)
    whole = b.groupBy("user_id", "shot").agg(F.count(F.lit(1)).alias("n")).where("n = 5")
    half = whole.groupBy("user_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("half"))
    r = b.join(half, "user_id").where("shot < half")
    r = r.select("user_id", F.col("shot").alias("pair"), "role", F.col("k").alias("ref_k"), "half")
    m = b.select("user_id", F.col("shot").alias("_s"), "role", F.col("k").alias("mon_k"))
    joined = r.withColumn("_s", F.col("pair") + F.col("half")).join(m, ["user_id", "role", "_s"])
    return joined.select("user_id", "pair", "role", "ref_k", "mon_k")


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def vec2(spark: SparkSession, sf: str) -> DataFrame:
    x = F.array(F.col("l_quantity") - 25.5, (F.col("l_discount") - 0.05) * 100)
    return table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("label"), x.alias("x"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """9-bit codes read as 3x3 periodic cells; order by p_partkey inside p_brand."""
    code = F.pmod(F.col("p_partkey") * 37 + F.col("p_size"), F.lit(512)).cast("int")
    return table(spark, sf, "part").select("p_partkey", "p_brand", code.alias("code"), unpack(code, 9).alias("bits"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id")


# --------------------------------------------------------------------------- the same in SQL

CAT = """cat AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  event_type FROM events)"""
SCORE = """score AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  least(greatest((value - 50) / 200, -1.0), 1.0) AS s FROM events)"""
BITS = """bits AS (SELECT user_id, CAST(floor((rn - 1) / 5.0) AS BIGINT) AS shot, CAST((rn - 1) % 5 AS INT) AS role, k
  FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""
BITS_LONG = BITS + """, bits_long AS (SELECT user_id, shot, role, CAST(i AS INT) AS chk,
  CAST((k >> CAST(i AS INT)) & 1 AS INT) AS bit FROM bits, range(7) r(i))"""
PAIRS = BITS + """, full_shots AS (SELECT user_id, shot FROM bits GROUP BY user_id, shot HAVING count(*) = 5),
halves AS (SELECT user_id, CAST(floor(count(*) / 2.0) AS BIGINT) AS half FROM full_shots GROUP BY user_id),
pairs AS (SELECT r.user_id, r.shot AS pair, r.role, r.k AS ref_k, m.k AS mon_k
  FROM (SELECT b.*, h.half FROM bits b JOIN halves h ON b.user_id = h.user_id WHERE b.shot < h.half) r
  JOIN bits m ON r.user_id = m.user_id AND r.role = m.role AND m.shot = r.shot + r.half)"""
PAIRS_LONG = PAIRS + """, pairs_long AS (SELECT user_id, pair, role, CAST(i AS INT) AS chk,
  CAST((ref_k >> CAST(i AS INT)) & 1 AS INT) AS r, CAST((mon_k >> CAST(i AS INT)) & 1 AS INT) AS m
  FROM pairs, range(7) q(i))"""
VEC = """vec AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label FROM embeddings)"""
VEC_LONG = VEC + """, vlong AS (SELECT vec_id, label, CAST(i - 1 AS INT) AS i, x[i] AS v
  FROM vec, range(1, 65) r(i))"""
UNIT_LONG = VEC_LONG + """, ulong AS (SELECT vec_id, label, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v
  FROM vlong)"""
VEC2 = """vec2 AS (SELECT l_linestatus AS label, l_quantity - 25.5 AS x, (l_discount - 0.05) * 100 AS y FROM lineitem)"""
GRID = """grid AS (SELECT p_partkey, p_brand, CAST((p_partkey * 37 + p_size) % 512 AS INT) AS code FROM part)"""
GRID_LONG = GRID + """, glong AS (SELECT p_partkey, p_brand, CAST(i AS INT) AS v,
  CAST((code >> CAST(i AS INT)) & 1 AS INT) AS b FROM grid, range(9) r(i))"""
OUTCOMES = """outcomes AS (SELECT l.doc_id, l.quality, l.toxic, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def sql(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n" + body if views else body


def tail_sql(x: str, n: str, p: str) -> str:
    """P(X <= x) of a binomial."""
    return f"list_sum(list_transform(range(0, {x} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


def clopper_sql(source: str, k: str, n: str, keep: str) -> str:
    """``bi`` holds ``keep`` with 95 % ``low`` and ``high``, both halved 50 times. The tail falls as p grows."""
    return f"""bi0 AS (SELECT *, {k} AS k_, {n} AS n_ FROM {source}),
    bi1 AS (SELECT {keep}, k_, n_, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0 AS turn FROM bi0
      UNION ALL SELECT {keep}, k_, n_, CASE WHEN coalesce({tail_sql("k_ - 1", "n_", "((a + b) / 2)")}, 0) > 0.975 THEN (a + b) / 2 ELSE a END, CASE WHEN coalesce({tail_sql("k_ - 1", "n_", "((a + b) / 2)")}, 0) > 0.975 THEN b ELSE (a + b) / 2 END,
        CASE WHEN {tail_sql("k_", "n_", "((c + d) / 2)")} > 0.025 THEN (c + d) / 2 ELSE c END, CASE WHEN {tail_sql("k_", "n_", "((c + d) / 2)")} > 0.025 THEN d ELSE (c + d) / 2 END, turn + 1 FROM bi1 WHERE turn < 50),
    bi AS (SELECT {keep}, k_ AS k, n_ AS n, CASE WHEN k_ = 0 THEN 0.0 ELSE (a + b) / 2 END AS low, CASE WHEN k_ = n_ THEN 1.0 ELSE (c + d) / 2 END AS high FROM bi1 WHERE turn = 50)"""
