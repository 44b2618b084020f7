"""Cutting lineage in a way that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewatch.plans.guards import MODEL_ROWS


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="statewatch-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session beside ``spark`` with the same settings but for ``settings``: what is read in it runs under them, also later, and the
    caller's own settings stay as they are."""
    beside = spark.newSession()
    for name, value in {**spark.conf.getAll, **settings}.items():
        if beside.conf.isModifiable(name):
            beside.conf.set(name, value)
    return beside


def durable(df: DataFrame, label: str = "stage", reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back, in the session ``reader`` if there is one.

    Used where later steps read the same rows several times and must see the same
    assignment of rows to chunks each time. Unlike a lineage checkpoint it costs a single
    pass, and readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or spark).read.schema(df.schema).parquet(path)


def model_table(df: DataFrame, rows: int = MODEL_ROWS) -> DataFrame:
    """``df`` written once, and broadcast in joins if it is the size of a model; larger tables are left to the planner."""
    table = durable(df, "model")
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
