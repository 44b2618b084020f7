"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.plans.durable import durable



def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def plain(text: str) -> Column:
    """The text column with NULL as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def remainder(id: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``: a split that depends on the id only. NULL ids count as ``''``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def row_key(id: str, text: Column) -> Column:
    """Tells rows with the same id and different texts apart; rows equal in both share it."""
    return F.xxhash64(F.col(id), text)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text (one longer text stays alone)."""
    for batch in batches:
        start = 0
        size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for row, n in enumerate(lengths):
            if row > start and size + n > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row, NULL as empty."""
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def map_rows(df: DataFrame, columns: list[Column], schema: T.StructType | str, fn: Callable) -> DataFrame:
    """``fn`` over Arrow batches of just the named columns."""
    return df.select(*columns).mapInArrow(fn, schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_copies(records: DataFrame, id: str, text: Column, removed: DataFrame, repeats: DataFrame) -> DataFrame:
    """``records`` without the rows of ``removed``, and one of each set of repeated rows.

    Both tables have columns ``id`` and ``key`` (``row_key`` of the same text). Repeated rows, equal in id and text, are rare: the
    second pass runs only where ``repeats`` has rows.
    """
    columns = records.columns
    key, i, k = unused(records, "_key"), unused(records, "_i"), unused(records, "_k")
    keyed = records.withColumn(key, row_key(id, text))

    def matches(other: DataFrame):
        return keyed[key].eqNullSafe(other[k]) & keyed[id].eqNullSafe(other[i])

    def renamed(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").alias(i), F.col("key").alias(k))

    gone = renamed(removed)
    left = keyed.join(gone, matches(gone), "left_anti")
    if repeats.isEmpty():
        return left.select(*columns)
    twice = renamed(repeats).distinct()
    same = left[key].eqNullSafe(twice[k]) & left[id].eqNullSafe(twice[i])
    once, again = left.join(twice, same, "left_anti"), left.join(twice, same, "left_semi")
    return once.unionByName(again.dropDuplicates([id, key])).select(*columns)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` bigint): one row ``(node, component)`` per node that has an edge.

    ``component`` is the smallest node reachable. Alternates the large-star and small-star steps (Kiveris et al.,
    2014); a star's centre only ever passes through aggregates and joins, so no task holds the neighbours of a
    node. Each round is a table in the shared folder, compared with the one before by count and hash sum.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = durable(pairs, "edges")
    seen = (0, None)
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        pairs = durable(small.where("a <> b").distinct(), "edges")
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == seen:
            break
        seen = (row["n"], row["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def frequent_bound(counts: DataFrame, most: int) -> int:
    """The smallest ``step`` that at most ``most`` rows reach. ``step`` is the count in eighths of powers of two, so the summary has few rows."""
    sizes = sorted(((r["step"], r["k"]) for r in counts.groupBy("step").agg(F.count("*").alias("k")).collect()), reverse=True)
    kept, bound = 0, 512
    for step, k in sizes:
        if kept + k > most:
            break
        kept, bound = kept + k, step
    return int(bound)


def hashed_sample(df: DataFrame, hash: Column, rows: int, most: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows of ``df``, and never more than twice as many: those whose 64-bit hash lies below the share that is
    wanted. Nothing is sorted, and the choice does not depend on the partitions."""
    share = most / max(rows, 1)
    if share >= 1.0:
        return df
    return df.where(hash < F.lit(int(-(2**63) + share * 2.0**64))).limit(2 * most)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While an action runs inside, Arrow batches hold at most ``rows`` rows: whole texts are large rows, and a batch is held on both sides of
    the pipe. The session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker serves many tasks, and else keeps the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(fn: Callable) -> Callable:
    """``fn`` over Arrow batches, giving memory back at the end of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run
