"""Vectorised Python columns whose inputs are materialised first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def add_columns(df: DataFrame, fields: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Add (or replace) columns computed per Arrow batch.

    For small model tables: unlike a UDF inside a projection, the inputs here are computed
    once, and Catalyst does not inline their expressions into the call.
    """
    added = T._parse_datatype_string(fields).fields
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *added])
    order = schema.fieldNames()

    def run(batches):
        for pdf in batches:
            extra = make(pdf).reset_index(drop=True)
            out = pdf.drop(columns=[n for n in names if n in pdf]).reset_index(drop=True)
            yield pd.concat([out, extra[names]], axis=1)[order]

    return df.mapInPandas(run, schema)
