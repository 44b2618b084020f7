"""A local session with the settings the tests and the benchmark use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    # Arrow workers import this package from the repository root
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, os.environ.get("PYTHONPATH")) if p)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("statewatch")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
