"""Data source for files of fixed-width bit records.

Each record starts on a byte boundary; bits are little-endian inside a byte; padding bits must
be zero. A read of records ``[start, stop)`` is split into byte ranges, one task per range, and
a task seeks to its range, so no task reads more than it decodes.

    spark.dataSource.register(PackedBits)
    spark.read.format("packedbits").option("bits", 24).load("/data/events.b8")
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 * 1024 * 1024
BATCH_BITS = 1 << 24


class Records(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class PackedBits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packedbits"

    def schema(self) -> str:
        return "shot bigint, bits array<tinyint>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.bits = int(options["bits"])
        if self.bits < 1:
            raise ValueError("bits must be positive")
        self.width = -(-self.bits // 8)
        size = os.path.getsize(self.path)
        if size % self.width:
            raise ValueError(f"{self.path} is not a whole number of {self.width}-byte records")
        records = size // self.width
        expected = options.get("records")
        if expected is not None and int(expected) != records:
            raise ValueError(f"expected {expected} records, found {records}")
        self.start = int(options.get("start", 0))
        self.stop = int(options.get("stop", records))
        if not 0 <= self.start <= self.stop <= records:
            raise ValueError("require 0 <= start <= stop <= records")
        self.chunk = max(1, int(options.get("range_bytes", RANGE_BYTES)) // self.width)

    def partitions(self) -> list[Records]:
        edges = list(range(self.start, self.stop, self.chunk)) + [self.stop]
        return [Records(a, b) for a, b in zip(edges, edges[1:], strict=False)] or [Records(self.start, self.start)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as handle:
            handle.seek(partition.start * self.width)
            step = max(1, BATCH_BITS // self.bits)
            for first in range(partition.start, partition.stop, step):
                count = min(step, partition.stop - first)
                raw = handle.read(count * self.width)
                if len(raw) != count * self.width:
                    raise ValueError("the file ended inside the requested range")
                table = np.unpackbits(
                    np.frombuffer(raw, dtype=np.uint8).reshape(count, self.width), axis=1, bitorder="little"
                )
                if table[:, self.bits :].any():
                    raise ValueError("padding bits must be zero")
                flat = pa.array(table[:, : self.bits].reshape(-1).astype(np.int8))
                offsets = pa.array(np.arange(count + 1, dtype=np.int32) * self.bits)
                bits = pa.ListArray.from_arrays(offsets, flat)
                shots = pa.array(np.arange(first, first + count, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([shots, bits], names=["shot", "bits"])
