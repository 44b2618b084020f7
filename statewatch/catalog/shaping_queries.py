"""Sources, indexing, splits, pairing, folds, shards and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statewatch.catalog import views as V
from statewatch.catalog.registry import query
from statewatch.functions.bits import unpack
from statewatch.operators import shaping
from statewatch.plans import place
from statewatch.plans.durable import durable, shared_folder
from statewatch.sources import tables

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "s01_labelled_table",
    """SELECT l_returnflag AS label, count(*) AS n, round(sum(l_quantity), 2) AS f0, round(sum(l_extendedprice), 2) AS f1,
       round(sum(l_discount), 2) AS f2, round(sum(l_tax), 2) AS f3 FROM lineitem GROUP BY l_returnflag""",
)
def labelled_table(spark, sf):
    rows = tables.load_labelled(spark, f"{sf}/lineitem.parquet", NUMERIC, "l_returnflag", "l_orderkey")
    sums = [V.r6(F.sum(F.get("features", F.lit(i))), 2).alias(f"f{i}") for i in range(4)]
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums)


LAYOUT = [(p, r, x, t) for p, (r, x, t) in enumerate([(1, 2, 0), (0, 1, 1), (0, 0, 0), (1, 0, 1), (0, 2, 1), (1, 1, 0)])]


@query(
    "s03_apply_layout",
    V.sql(
        V.BITS,
        """layout(position, role, x) AS (VALUES (0,1,2),(1,0,1),(2,0,0),(3,1,0),(4,0,2),(5,1,1))""",
        """canon AS (SELECT position, role, dense_rank() OVER (PARTITION BY role ORDER BY x) - 1 AS chk FROM layout)""",
        body="""SELECT c.role AS layout_role, CAST(c.chk AS INT) AS chk, b.user_id,
        CAST(sum((b.k >> c.position) & 1) AS BIGINT) AS events FROM bits b CROSS JOIN canon c GROUP BY ALL""",
    ),
)
def layout_bits(spark, sf):
    layout = spark.createDataFrame([(p, r, x, 0) for p, r, x, _ in LAYOUT], "position int, role int, x int, y int")
    records = V.bits(spark, sf).select("user_id", unpack("k", 6).alias("bits"))
    long = shaping.apply_layout(records, layout, keep=["user_id"])
    return long.groupBy("user_id", F.col("role").alias("layout_role"), "chk").agg(
        F.sum("bit").cast("bigint").alias("events")
    )


@query(
    "s04_snapshot_json",
    V.sql(
        V.BITS,
        body="""SELECT user_id, CAST(k AS BIGINT) AS k, count(*) AS n, CAST(sum(bit_count(k)) AS BIGINT) AS ones
        FROM bits GROUP BY user_id, k""",
    ),
)
def snapshot_json(spark, sf):
    """Nested JSON in ``events.props`` read with an explicit schema."""
    parsed = F.from_json("props", "k bigint")["k"]
    rows = V.events(spark, sf).select("user_id", parsed.alias("k"))
    ones = F.aggregate(unpack("k", 7), F.lit(0), lambda s, b: s + b)
    return rows.withColumn("o", ones).groupBy("user_id", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o").cast("bigint").alias("ones")
    )


@query(
    "s06_difference_events",
    V.sql(
        V.BITS_LONG,
        body="""SELECT user_id, shot, role, chk, CAST(xor(bit, coalesce(lag(bit) OVER
        (PARTITION BY user_id, shot, chk ORDER BY role), 0)) AS INT) AS event FROM bits_long""",
    ),
)
def difference(spark, sf):
    out = shaping.difference_events(V.bits_long(spark, sf), ["user_id", "shot", "chk"], "role", "bit", rounds=5)
    return out.select("user_id", "shot", "role", "chk", "event")


#: Shots of a snapshot entry, and lines of a text file, at most.
RUN, LINES = 1_000, 100_000


@query(
    "s04_load_snapshots",
    """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS shot, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events WHERE event_type = 'click')
    SELECT shot, CAST(i AS INT) AS position, CAST((k >> CAST(i AS INT)) & 1 AS INT) AS bit FROM e, range(7) r(i)""",
)
def load_snapshots(spark, sf):
    """Snapshot files written from the events, one entry per type and run of shots, all read back through the operator."""
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    bits = V.events(spark, sf).select("event_type", "event_id", unpack(F.from_json("props", "k bigint")["k"], 7).alias("bits"))
    numbered = place(bits, ["event_type"], ["event_id"], "rn").rows().withColumn("first", F.col("rn") - 1 - F.pmod(F.col("rn") - 1, F.lit(RUN)))
    shots = numbered.groupBy("event_type", "first").agg(F.sort_array(F.collect_list(F.struct("rn", "bits"))).alias("shots"))
    metadata = F.create_map(F.lit("logical_state"), "event_type", F.lit("first_shot"), F.col("first").cast("string"))
    entry = shots.select(metadata.alias("metadata"), F.create_map(F.lit("checks"), F.col("shots.bits")).alias("per_shot_cregs"))
    entry.write.json(folder)
    back = tables.load_snapshot_entries(spark, folder, "checks", ["logical_state", "first_shot"])
    every = durable(back.withColumn("shot", F.col("first_shot").cast("bigint") + F.col("shot")), "snapshots")  # checks the other types too
    return every.where("logical_state = 'click'").select("shot", "position", "bit")


@query(
    "s05_load_outcomes",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS shot, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS bit FROM orders
    QUALIFY shot >= 100""",
)
def load_outcomes(spark, sf):
    """0/1 lines written from the orders in order of their key, read back from line 100 on."""
    folder = f"{shared_folder(spark)}/outcomes-{uuid.uuid4().hex}"
    lines = V.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("value"))
    lines.orderBy("o_orderkey").select("value").write.text(folder)
    return tables.load_outcomes(spark, folder, start=100)


@query(
    "s07_shot_index",
    V.sql(
        V.BITS,
        body="""SELECT user_id, shot * 5 + role AS idx, CAST((shot * 5 + role) // 5 AS BIGINT) AS shot_back,
        CAST((shot * 5 + role) % 5 AS INT) AS role_back, k FROM bits""",
    ),
)
def shot_index(spark, sf):
    rows = V.bits(spark, sf).withColumn("idx", shaping.to_index("shot", "role", 5))
    shot, role = shaping.from_index("idx", 5)
    return rows.select("user_id", "idx", shot.alias("shot_back"), role.alias("role_back"), "k")


@query(
    "s07_flatten_shots",
    V.sql(V.BITS_LONG, body="""SELECT (dense_rank() OVER (ORDER BY user_id, shot) - 1) * 5 + role AS "index", chk, bit FROM bits_long"""),
)
def flatten(spark, sf):
    rows = V.bits(spark, sf).withColumn("bits", unpack("k", 7))
    return shaping.flatten_shots(V.numbered_shots(rows), "bits", "shot", "role", 5)


SPLITS = [("fit", 0, 4), ("threshold", 4, 8), ("held", 9, 14)]


@query(
    "s08_assign_split",
    V.sql(
        V.BITS,
        """spl(split, a, b) AS (VALUES ('fit', 0, 4), ('threshold', 4, 8), ('held', 9, 14))""",
        body="SELECT user_id, shot, role, split FROM bits JOIN spl ON a <= shot AND shot < b",
    ),
)
def assign_split(spark, sf):
    return shaping.assign_split(V.bits(spark, sf), "shot", SPLITS).select("user_id", "shot", "role", "split")


@query(
    "s09_pair_blocks",
    V.sql(
        V.BITS,
        """ref AS (SELECT user_id, role, k, row_number() OVER (PARTITION BY user_id, role ORDER BY shot) - 1 AS pair
        FROM bits WHERE shot < 6)""",
        """mon AS (SELECT user_id, role, k, row_number() OVER (PARTITION BY user_id, role ORDER BY shot) - 1 AS pair
        FROM bits WHERE shot >= 6)""",
        body="""SELECT user_id, role, pair, ref.k AS ref_k, mon.k AS mon_k,
        CASE WHEN ref.k IS NULL THEN 'monitor' WHEN mon.k IS NULL THEN 'reference' END AS side
        FROM ref FULL JOIN mon USING (user_id, role, pair)""",
    ),
)
def pair_blocks(spark, sf):
    rows = V.bits(spark, sf)
    return shaping.pair_blocks(rows.where("shot < 6"), rows.where("shot >= 6"), ["user_id", "role"], ["shot"], ["k"])


@query(
    "s10_stratified_sample",
    """SELECT CAST(n AS INT) AS stratum, CASE WHEN n < 2 THEN 5 ELSE 4 END AS picked FROM range(10) r(n)""",
)
def stratified_sample(spark, sf):
    picked = shaping.stratified_sample(V.vec(spark, sf), "label", "vec_id", 42, 10, seed=7)
    return picked.groupBy(F.col("label").alias("stratum")).agg(F.count(F.lit(1)).cast("int").alias("picked"))


@query(
    "s11_stratified_folds",
    """WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT label, CAST(rep AS INT) AS repeat, CAST(f AS INT) AS fold, (n + 4 - f) // 5 AS n
    FROM c, range(2) r(rep), range(5) q(f)""",
)
def folds(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("id"),
    )
    assigned = shaping.assign_folds(rows, "label", "id", 5, 2, seed=3)
    return assigned.groupBy("label", "repeat", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s12_table_round_trip",
    """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1""",
)
def round_trip(spark, sf):
    """Write CSV and a partitioned parquet table, read both back and join what they say."""
    folder = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    tables.write_table(rows, f"{folder}/csv", "csv")
    tables.write_table(rows, f"{folder}/parquet", "parquet", by=["o_orderpriority"])
    back = spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/csv")
    part = spark.read.parquet(f"{folder}/parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    price = back.groupBy("o_orderpriority").agg(V.r6(F.sum("o_totalprice"), 2).alias("price"))
    return part.join(price, "o_orderpriority")


@query(
    "s13_file_manifest",
    """WITH l AS (SELECT o_custkey % 8 AS shard, o_orderkey || ' ' || o_orderstatus || chr(10) AS line, o_orderkey FROM orders)
    SELECT CAST(sum(length(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS sha256 FROM l GROUP BY shard""",
)
def manifest(spark, sf):
    """Bytes and SHA-256 of eight shards that a sink wrote from the orders table, each as text files of bounded length."""
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    lines = V.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 8).alias("shard"), F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"), "o_orderkey"
    )
    placed = lines.repartitionByRange("shard", "o_orderkey").sortWithinPartitions("shard", "o_orderkey").select("shard", "value")
    placed.write.option("maxRecordsPerFile", LINES).partitionBy("shard").text(folder)
    return tables.folder_manifest(spark, folder).select("bytes", "sha256")


@query(
    "s14_merge_shards",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey, round(o_totalprice, 2) AS price FROM orders""",
)
def shards(spark, sf):
    placed = place(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], ["o_orderkey"], "rn").rows()
    rows = placed.select((F.col("rn") - 1).alias("idx"), "o_orderkey", V.r6(F.col("o_totalprice"), 2).alias("price"))
    parts = [rows.where(F.pmod("o_orderkey", F.lit(3)) == i) for i in range(3)]
    return shaping.merge_shards(parts, "idx", rows.count())


@query(
    "s14_shard_problems",
    """WITH o AS (SELECT o_orderkey % (SELECT count(*) FROM orders) AS i FROM orders WHERE o_orderkey % 7 <> 3
       UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 1),
    c AS (SELECT i, count(*) AS n FROM o GROUP BY i)
    SELECT r.i AS "index", 'missing' AS problem FROM range((SELECT count(*) FROM orders)) r(i) WHERE r.i NOT IN (SELECT i FROM c)
    UNION ALL SELECT i, 'duplicate' FROM c WHERE n > 1
    UNION ALL SELECT i, 'unknown' FROM c WHERE i < 0 OR i >= (SELECT count(*) FROM orders)""",
)
def shard_problems(spark, sf):
    orders = V.table(spark, sf, "orders")
    n = orders.count()
    kept = orders.where(F.pmod("o_orderkey", F.lit(7)) != 3).select(F.pmod("o_orderkey", F.lit(n)).alias("i"))
    extra = orders.where(F.pmod("o_orderkey", F.lit(50)) == 1).select(F.col("o_orderkey").alias("i"))
    return shaping.coverage_problems(kept.unionByName(extra), "i", n)


@query(
    "s15_domain_checks",
    """SELECT l_returnflag AS flag, count(*) FILTER (WHERE abs(l_discount + l_tax - 1) <= 1e-9) AS simplex,
      count(*) FILTER (WHERE l_quantity BETWEEN 5 - 1e-9 AND 40 + 1e-9 AND l_discount BETWEEN 0.01 - 1e-9 AND 0.09 + 1e-9) AS in_box,
      count(*) FILTER (WHERE l_quantity IN (0, 1) AND l_linenumber IN (0, 1)) AS binary_rows,
      round(sum(CASE WHEN l_quantity > 0 THEN l_quantity / (l_quantity + l_linenumber) END), 4) AS mass
    FROM lineitem GROUP BY 1""",
)
def domain(spark, sf):
    """Quarantine flags, and the strict check applied to rows that pass it."""
    rows = V.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    simplex = F.array("l_discount", "l_tax")
    box = F.array("l_quantity", "l_discount")
    low, high = F.array(F.lit(5.0), F.lit(0.01)), F.array(F.lit(40.0), F.lit(0.09))
    shares = F.array("l_quantity", F.col("l_linenumber").cast("double"))
    unit = F.transform(shares, lambda x: x / (F.col("l_quantity") + F.col("l_linenumber")))
    marked = rows.select(
        F.col("l_returnflag").alias("flag"),
        shaping.is_simplex(simplex).cast("int").alias("a"),
        shaping.is_box(box, low, high).cast("int").alias("b"),
        shaping.is_binary(shares).cast("int").alias("c"),
        F.get(shaping.require_simplex(unit), F.lit(0)).alias("m"),
    )
    return marked.groupBy("flag").agg(
        F.sum("a").alias("simplex"), F.sum("b").alias("in_box"), F.sum("c").alias("binary_rows"),
        V.r6(F.sum("m"), 4).alias("mass"),
    )
