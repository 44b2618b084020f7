"""Exact copies of records, with the copies of frequent contents removed before any shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.llm.common import ascii_lower, drop_copies, row_key
from statewatch.plans.durable import durable


def content_text(records: DataFrame, content: str) -> Column:
    """Text of a content column: strings as they are, bit arrays joined by commas; NULL is empty."""
    if isinstance(records.schema[content].dataType, T.ArrayType):
        return F.concat_ws(",", F.transform(F.col(content), lambda b: F.coalesce(b.cast("string"), F.lit("null"))))
    return F.coalesce(F.col(content).cast("string"), F.lit(""))


def digests(records: DataFrame, id: str, content: str) -> DataFrame:
    """``(id, key, digest, row)``: SHA-256 of the content with A-Z in lower case, written once.

    ``row`` numbers the written rows; it only tells repeated rows apart.
    """
    text = content_text(records, content)
    digest = F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))
    table = records.select(F.col(id).alias("id"), row_key(id, text).alias("key"), digest.alias("digest"))
    return durable(table.withColumn("row", F.monotonically_increasing_id()), "digests")


def misra_gries(table: DataFrame, column: str, counters: int) -> DataFrame:
    """``(digest, seen)``: sums of the tasks' Misra-Gries summaries, each of at most ``counters`` entries.

    ``seen`` is at most the true count, and short of it by less than rows / (counters + 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            for entry in pc.value_counts(batch.column(0)):
                kept[entry["values"].as_py()] += entry["counts"].as_py()
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({k: n - cut for k, n in kept.items() if n > cut})
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "seen"])

    partial = table.select(column).mapInArrow(run, "digest binary, seen bigint")
    return partial.groupBy("digest").agg(F.sum("seen").alias("seen"))


def exact_copies(records: DataFrame, id: str = "shot", content: str = "bits", heavy: int = 256, counters: int = 1024) -> DataFrame:
    """Which record stays of each set with the same content.

    Works on the project's detection-event records (one row per shot, ``bits`` an array) and on any table
    with an id and a text column. One row per input row: ``id, keep_id, group_size, kept, sha256, key, keep_key``.

    A content held by at least one row in ``heavy`` is frequent: Misra-Gries summaries find a superset of at most
    1 / (1/heavy - 1/(counters+1)) digests, an exact count verifies them, and the at most ``heavy`` winners are broadcast, so
    the copies are settled where they are read. All other digests go through an ordinary shuffle.

    Cases: NULL content counts as empty text. Of equal contents the largest id stays, NULL ids last; of rows with
    that id exactly one is kept. Ties and repeated rows count in ``group_size``. An empty table gives no rows. Other
    columns of ``records`` are not read, whatever their names. Texts of any length are hashed whole.
    """
    table = digests(records, id, content)
    n = table.count()
    fewest = n / heavy
    seen = misra_gries(table, "digest", counters)
    candidates = seen.where(F.col("seen") >= fewest - n / (counters + 1)).select("digest")
    summary = [F.count("*").alias("group_size"), F.max(F.struct("id", "row", "key")).alias("winner")]
    found = table.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*summary)
    winners = durable(found.where(F.col("group_size") >= fewest), "winners")  # at most `heavy` rows
    frequent = table.join(F.broadcast(winners), "digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    ordinary = rest.join(rest.groupBy("digest").agg(*summary), "digest")
    decided = frequent.unionByName(ordinary)
    return decided.select(
        "id",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("sha256"),
        "key",
        F.col("winner.key").alias("keep_key"),
    )


def drop_exact_copies(records: DataFrame, id: str = "shot", content: str = "bits", **options) -> DataFrame:
    """``records`` with one record of each content, chosen as in ``exact_copies``; all columns stay.

    Rows that repeat id and content of the winner are dropped but for one.
    """
    decided = exact_copies(records, id, content, **options).where(~F.col("kept"))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    decided = durable(decided.select("id", "key", same.alias("again")), "dropped")
    text = content_text(records, content)
    return drop_copies(records, id, text, decided.where(~F.col("again")), decided.where("again"))

