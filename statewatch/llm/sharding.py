"""Placement of records in shards by a permutation-filled lookup table, with Spark expressions only on the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewatch.llm.common import unused

#: Default number of slots; prime, and well above the number of shards.
SLOTS = 65_537


def hash52(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts as text, joined by colons; NULL parts are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])), 1, 13), 16, 10).cast("bigint")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Slot -> number of the shard.

    Shard ``i`` prefers slots ``offset + k * skip (mod slots)``, k = 0, 1, ..., a permutation because ``slots`` is prime. Shards take turns, each
    claiming the first slot of its order that is still free, until none is. Slot counts differ by at most one. The work depends
    on ``slots`` alone, not on the records.
    """
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if len(shards) > slots:
        raise ValueError("more shards than slots")
    number = lambda name, use: int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:13], 16)
    at = [number(name, "offset") % slots for name in shards]
    skip = [number(name, "skip") % (slots - 1) + 1 for name in shards]
    table = [-1] * slots
    free = slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``, one row per slot."""
    text = ",".join(map(str, lookup_table(shards, slots)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "i"))
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    return rows.select(F.col("slot").cast("bigint").alias("slot"), F.get(names, F.col("i").cast("int")).alias("shard"))


def assign_shards(records: DataFrame, key: str = "shot", shards: Sequence[str] = ("0",), slots: int = SLOTS, within: str | None = None) -> DataFrame:
    """``records`` with ``slot`` and ``shard``; the same key always goes to the same place.

    For the project's shot records the key is the shot, so a later shard merge finds each shot once. The table has ``slots`` rows whatever
    the records are, which bounds the broadcast; placement is one hash and one lookup per row, without a shuffle.

    With ``within`` (an id column) a key with more rows than a shard's even share is split: its rows go to as many places as
    shares it fills, by the hash of ``within``. At most ``len(shards)`` keys can be that large, so their table is broadcast.

    Cases: NULL keys share one place. Repeated rows go together (unless split, then by ``within``). An empty table gives no rows. Columns
    of ``records`` named slot or shard are replaced by the new ones. Only key and ``within`` are read for the placement.
    """
    spark = records.sparkSession
    taken = [c for c in records.columns if c not in ("slot", "shard")]
    rows = records.select(*[F.col(f"`{c}`") for c in taken])
    piece = F.lit(None).cast("string")
    if within is not None:
        name, pieces = unused(records, "_large"), unused(records, "_pieces")
        share = records.select(F.ceil(F.count("*") / len(shards)).alias("share"))
        counts = records.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n"))
        large = counts.crossJoin(F.broadcast(share)).where("n > share").select(name, F.ceil(F.col("n") / F.col("share")).alias(pieces))
        rows = rows.join(F.broadcast(large), F.col(key).eqNullSafe(F.col(name)), "left")
        piece = F.pmod(hash52(F.lit("piece"), F.col(within)), F.col(pieces)).cast("string")
    placed = rows.withColumn("slot", F.pmod(hash52(F.lit("key"), F.col(key), piece), F.lit(slots)))
    found = placed.join(F.broadcast(table_frame(spark, shards, slots)), "slot")
    return found.select(*[F.col(f"`{c}`") for c in taken], "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; each is written by many tasks, so none holds a shard whole."""
    placed.drop("slot").write.partitionBy("shard").parquet(path)
