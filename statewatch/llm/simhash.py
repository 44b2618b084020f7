"""SimHash fingerprints and the exact links between them, by covering locality-sensitive hashing.

The project's records hold numbers and bits, no prose, so this operator is general: any table with an id and a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.llm.common import arrow_rows, components, drop_copies, plain, row_key, slices, texts, trimmed
from statewatch.plans.durable import durable

SEED = 42
SHINGLE = 3
RADIUS = 3
BITS = 64
#: Buckets with more distinct fingerprints than this are split by the masks of the second level.
BUCKET = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 65_536):  # bounds the unpacked bits of very long texts
        bits = np.unpackbits(hashes[part : part + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(records: DataFrame, id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``(id, key, fingerprint)``, the fingerprint as a signed bigint; each text is read whole."""
    schema = T.StructType([T.StructField("id", records.schema[id].dataType), T.StructField("key", T.LongType()), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = np.array([fingerprint(t, shingle) for t in texts(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["id", "key", "fingerprint"])

    return records.select(F.col(id).alias("id"), row_key(id, plain(text)).alias("key"), plain(text).alias("text")).mapInArrow(trimmed(run), schema)


def masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """Covering masks over the bit positions ``free``.

    Position p gets a code m(p), a non-zero vector of radius + 1 bits, in turn. For each non-zero v of as many bits, mask v
    keeps the positions with <m(p), v> odd. Any ``radius`` positions give that many linear equations <m(p), v> = 0 in
    radius + 1 unknowns, so some non-zero v solves them all: two values that differ in at most ``radius`` of
    the positions agree under that mask. About half the positions are kept by each mask.
    """
    codes = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, codes + 1):
        mask = 0
        for turn, position in enumerate(free):
            if bin((turn % codes + 1) & v).count("1") % 2:
                mask |= 1 << position
        out.append(mask)
    return out


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def closest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of its component's first member, linking at ``radius`` bits or fewer."""
    root = np.arange(len(values))
    rows = max(1, 2_000_000 // len(values))
    for start in range(0, len(values), rows):
        part = values[start : start + rows]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) <= radius)
        i += start
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, root[root]):
                root = root[root]
    return root


def bucket_links(rows: DataFrame, group: list[str], radius: int, most: int | None) -> DataFrame:
    """Spanning links ``(a, b)`` inside each bucket of ``rows`` (``group`` columns and ``value``).

    Buckets stream through sorted Arrow batches. A bucket of more than ``most`` values is handed back instead, as rows
    ``(table, value, NULL)``; it is held only up to that size.
    """
    parts = rows.repartition(*group).sortWithinPartitions(*group, "value").select(*group, "value")
    width = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last: tuple | None = None
        passing = False

        def close() -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate(held)
            if len(values) < 2:
                return values[:0], values[:0]
            root = closest(values.view(np.uint64), radius)
            linked = root != np.arange(len(values))
            return values[linked], values[root[linked]]

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in columns[:width]:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change), n]
            a, b, big_table, big = [], [], [], []
            for s, e in zip(starts, starts[1:], strict=False):
                if s == e:
                    continue
                this = tuple(c[s] for c in columns[:width])
                if this != last:
                    if held and not passing:
                        x, y = close()
                        a.append(x)
                        b.append(y)
                    held, last, passing = [], this, False
                held.append(columns[width][s:e])
                if passing or (most is not None and sum(map(len, held)) > most):
                    passing = True
                    values = np.concatenate(held)
                    big.append(values)
                    big_table.append(np.full(len(values), this[0]))
                    held = []
            yield out(a, b, big_table, big)
        if held and not passing:
            x, y = close()
            yield out([x], [y], [], [])

    def out(a, b, big_table, big) -> pa.RecordBatch:
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        a, b, big_table, big = map(join, (a, b, big_table, big))
        second = pa.concat_arrays([pa.array(b), pa.nulls(len(big), pa.int64())])
        table = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(big_table)])
        return pa.RecordBatch.from_arrays([table, pa.array(np.concatenate([a, big])), second], ["table", "a", "b"])

    return parts.mapInArrow(trimmed(run), "table bigint, a bigint, b bigint")


def fingerprint_links(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct ``value`` fingerprints within ``radius`` bits of each other.

    Every value goes to one bucket per covering mask. Values of an oversized bucket agree in the kept half of their
    bits, so they are dealt out again by covering masks over the other half; what then shares a bucket differs in about a
    quarter of the bits only, at most 2**16 values, which a task compares by tiles. Nothing is dropped.
    """
    first = masks(list(range(BITS)), radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(signed(m)).alias("m")) for t, m in enumerate(first)]))
    dealt = values.select("value", tables.alias("x")).select(F.col("x.t").alias("t"), F.col("value").bitwiseAND(F.col("x.m")).alias("k"), "value")
    found = durable(bucket_links(dealt, ["t", "k"], radius, bucket), "links")
    second = []
    for t, m in enumerate(first):
        free = [p for p in range(BITS) if not m >> p & 1]
        for u, n in enumerate(masks(free, radius)):
            second.append(F.struct(F.lit(t * len(first) + u).cast("bigint").alias("t"), F.lit(signed(m)).alias("m"), F.lit(signed(n)).alias("n")))
    per_table = [F.array(*second[t * len(first) : (t + 1) * len(first)]) for t in range(len(first))]
    crowded = found.where(F.col("b").isNull())
    again = F.element_at(F.array(*per_table), F.col("table").cast("int") + 1)
    spread = crowded.select(F.col("a").alias("value"), F.explode(again).alias("x"))
    spread = spread.select(
        F.col("x.t").alias("t"), F.col("value").bitwiseAND(F.col("x.m")).alias("k"), F.col("value").bitwiseAND(F.col("x.n")).alias("k2"), "value"
    )
    more = bucket_links(spread, ["t", "k", "k2"], radius, None)
    return found.where(F.col("b").isNotNull()).select("a", "b").unionByName(more.select("a", "b"))


def grouped_copies(records: DataFrame, id: str, text: str, radius: int, bucket: int) -> DataFrame:
    """What ``near_copies`` returns, with the ``group`` of each row: the group's smallest fingerprint as a bigint, which no other group shares."""
    with arrow_rows(records.sparkSession):
        prints = durable(fingerprints(records, id, text), "fingerprints")
    distinct = prints.groupBy(F.col("fingerprint").alias("value")).agg(F.min("id").alias("least"))
    distinct = durable(distinct, "values")
    found = components(fingerprint_links(distinct.select("value"), radius, bucket))
    named = distinct.join(found, F.col("value") == F.col("node"), "left")
    named = named.select("value", F.coalesce("component", "value").alias("group"), "least")
    groups = named.groupBy("group").agg(F.min("least").alias("component_id"))
    lookup = named.join(groups, "group").select(F.col("value").alias("fingerprint"), "component_id", "group")
    out = prints.join(durable(lookup, "groups"), "fingerprint")
    return out.select("id", "key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "group")


def near_copies(records: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Groups of texts whose SimHash fingerprints differ in ``radius`` bits or fewer, chains included.

    One row per input row: ``id, key, fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest id of the group.

    Cases: NULL text counts as empty; texts without words share fingerprint zero and link like any other. Fewer than three
    words are one shingle. Repeated rows and ties share a fingerprint. NULL ids belong to groups but name none unless all
    ids of a group are NULL. An empty table gives no rows. Other columns are not read. Texts are read whole.
    """
    return grouped_copies(records, id, text, radius, bucket).drop("group")


def drop_near_copies(records: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``records`` with one row of each group of ``near_copies``: the one with the smallest id; all columns stay.

    Groups stay apart even where they share the smallest id or have none.
    """
    found = grouped_copies(records, id, text, radius, bucket)
    ours = F.col("id").eqNullSafe(F.col("component_id"))
    rows = found.groupBy("group", "component_id", "id", "key").agg(F.count("*").alias("n"))
    # of rows that share the smallest id, the one with the smallest key stays
    best = rows.where(ours).groupBy("group").agg(F.min("key").alias("best"))
    rows = durable(rows.join(best, "group"), "decided")
    stays = ours & (F.col("key") == F.col("best"))
    return drop_copies(records, id, plain(text), rows.where(~stays), rows.where(stays & (F.col("n") > 1)))
