"""Labelled tables, nested snapshots, 0/1 lines, sinks and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewatch.functions.arrays import finite
from statewatch.plans.durable import durable
from statewatch.plans.guards import require
from statewatch.plans.ordering import place as ordering_place


def labelled(df: DataFrame, features: Sequence[str] | Column, label: str, id: str) -> DataFrame:
    """``(id, features, label)`` with double features; NaN or infinite features fail the query."""
    raw = F.array(*[F.col(c).cast("double") for c in features]) if not isinstance(features, Column) else features
    values = raw.cast("array<double>")
    checked = require(finite(values), values, "features must be finite")
    return df.select(F.col(id).alias("id"), checked.alias("features"), F.col(label).alias("label"))


def load_labelled(
    spark: SparkSession, path: str, features: Sequence[str], label: str, id: str, schema: str | None = None
) -> DataFrame:
    """Labelled CSV (with header) or parquet. In CSV only an empty cell is missing, so a label such
    as ``no_change`` or ``NA`` stays text."""
    if path.endswith(".parquet"):
        return labelled(spark.read.parquet(path), features, label, id)
    reader = spark.read.option("header", True).option("nullValue", "")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return labelled(reader.csv(path), features, label, id)


SNAPSHOT = T.StructType(
    [
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("per_shot_cregs", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.IntegerType())))),
    ]
)


def register_bits(entries: DataFrame, field: str, value: str, register: str) -> DataFrame:
    """``(shot, position, bit)`` of one named register of the single entry with that metadata value."""
    picked = entries.where(F.col("metadata")[field] == value)
    counted = picked.agg(F.count(F.lit(1)).alias("n"), F.any_value("per_shot_cregs").alias("regs"))
    regs = require(F.col("n") == 1, F.col("regs"), f"expected one entry with {field}={value}")
    rows = F.try_element_at(regs, F.lit(register))
    rows = require(rows.isNotNull(), rows, f"no register {register}")
    width = F.size(F.get(rows, F.lit(0)))
    good = F.forall(rows, lambda r: (F.size(r) == width) & F.forall(r, lambda b: b.isin(0, 1)))
    checked = counted.select(require(good, rows, "register must be a rectangular array of bits").alias("rows"))
    shots = checked.select(F.posexplode("rows").alias("shot", "bits"))
    return shots.select(F.col("shot").cast("bigint").alias("shot"), F.posexplode("bits").alias("position", "bit"))


def load_snapshots(
    spark: SparkSession, path: str, value: str, registers: Sequence[str], field: str = "logical_state"
) -> dict[str, DataFrame]:
    """Read named registers of one entry; all must have the same number of shots."""
    entries = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    out = {name: register_bits(entries, field, value, name) for name in registers}
    sizes = {name: df.select("shot").distinct().count() for name, df in out.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"registers differ in shots: {sizes}")
    return out


def load_snapshot_entries(spark: SparkSession, path: str, register: str, fields: Sequence[str]) -> DataFrame:
    """``(*fields, shot, position, bit)`` of one register of every entry, from JSON lines with one entry each.

    The metadata ``fields`` name an entry and must not repeat. Entries are decoded where they are read; every one is checked.
    """
    entries = spark.read.schema(SNAPSHOT).json(path)
    named = [F.col("metadata")[f].alias(f) for f in fields]
    rows = F.try_element_at("per_shot_cregs", F.lit(register))
    rows = require(rows.isNotNull(), rows, f"no register {register}")
    width = F.size(F.get(rows, F.lit(0)))
    good = F.forall(rows, lambda r: (F.size(r) == width) & F.forall(r, lambda b: b.isin(0, 1)))
    checked = entries.select(*named, require(good, rows, "register must be a rectangular array of bits").alias("rows"))
    repeated = entries.select(*named).groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"entries repeat: {repeated.first().asDict()}")
    shots = checked.select(*fields, F.posexplode("rows").alias("shot", "bits"))
    return shots.select(*fields, F.col("shot").cast("bigint").alias("shot"), F.posexplode("bits").alias("position", "bit"))


def load_outcomes(
    spark: SparkSession, path: str, start: int = 0, stop: int | None = None, expected: int | None = None
) -> DataFrame:
    """``(shot, bit)`` for lines ``[start, stop)`` of a 0/1 text file, or of a folder of them in order of their names.

    Lines are numbered inside the block of a file that a task reads; a short table with the lines of each block gives the number of
    the first. Only the requested slice is validated.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(F.col("value").alias("line"), *place, F.monotonically_increasing_id().alias("_at"))
    lines = durable(lines, "lines")  # the numbers hold for what has been written
    blocks = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    placed = ordering_place(blocks, [], ["_file", "_block"], "_k").running(_upto=("sum", F.col("_lines"))).rows()
    counted = durable(placed, "blocks")
    if expected is not None and (counted.agg(F.sum("_lines")).first()[0] or 0) != expected:
        raise ValueError(f"expected {expected} outcome lines")
    joined = lines.join(counted.drop("_k"), ["_file", "_block"])
    df = joined.select((F.col("_upto") - F.col("_lines") + F.col("_at") - F.col("_first")).alias("shot"), "line")
    if start:
        df = df.where(F.col("shot") >= start)
    if stop is not None:
        df = df.where(F.col("shot") < stop)
    bit = require(F.col("line").isin("0", "1"), F.col("line"), "outcome lines must be 0 or 1")
    return df.select("shot", bit.cast("int").alias("bit"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Parquet or CSV with header. CSV doubles read back exactly."""
    if fmt == "csv":
        cols = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, T.DoubleType):
                text = c.cast("string")  # shortest text that reads back to the same double
                c = F.when(c == float("inf"), "+inf").when(c == float("-inf"), "-inf").otherwise(text)
            cols.append(c.alias(f.name))
        writer = df.select(*cols).write.option("header", True).option("nullValue", "")
    elif fmt == "parquet":
        writer = df.write
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")
    if by:
        writer = writer.partitionBy(*by)
    writer.format(fmt).save(path)


def folder_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Folder, bytes and SHA-256 of the files that Spark wrote into each folder below ``path``, one after another in the order written.

    A digest is sequential, so a folder streams through one task; it holds a few files at a time, and each is as long as the writer's ``maxRecordsPerFile``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("bigint")
    parts = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), number(r"^part-(\d+)").alias("task"), number(r"\.c(\d+)").alias("part"), "content")
    placed = parts.repartition("folder").sortWithinPartitions("folder", "task", "part").select("folder", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, size = None, hashlib.sha256(), 0
        done = lambda: pa.RecordBatch.from_pydict({"folder": [last], "bytes": [size], "sha256": [digest.hexdigest()]})
        for batch in batches:
            for folder, content in zip(batch.column(0), batch.column(1), strict=True):
                if folder.as_py() != last:
                    if last is not None:
                        yield done()
                    last, digest, size = folder.as_py(), hashlib.sha256(), 0
                digest.update(content.as_py())
                size += len(content.as_py())
        if last is not None:
            yield done()

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "8")  # whole files are large rows
    try:
        return durable(placed.mapInArrow(run, "folder string, bytes bigint, sha256 string"), "digests")
    finally:
        spark.conf.set(setting, before)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, byte size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
