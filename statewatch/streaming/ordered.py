"""Event-time order for stateful detectors.

Structured Streaming gives no order inside a micro-batch. Rows of a key wait in a buffer in the
state store until the watermark has passed them; then they are sorted and stepped with the same
kernel the batch operator uses. A key's state is one flat vector. Keys share buckets by hash, so that a
micro-batch calls Python once per bucket and not once per key, and rows wait as packed columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from statewatch.plans.durable import shared_folder
from statewatch.plans.ordering import Group, arrays, frame, key_runs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[Group, np.ndarray], tuple[Group, np.ndarray]]
BUCKET = "key_bucket"
#: Keys share a call and a state of this many; rows wait in lots of at most so many.
BUCKETS, PACKED = 256, 4096


def _inner(name: str) -> str:
    """State rows travel as named tuples, whose fields may not start with an underscore."""
    return f"hidden{name}" if name.startswith("_") else name


def _plain(value):
    """The state store takes Python values only."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    return value.item() if isinstance(value, np.generic) else value


def _outer(name: str) -> str:
    return name.removeprefix("hidden") if name.startswith("hidden_") else name


class OrderedProcessor(StatefulProcessor):
    """The keys of one bucket: their rows wait packed by column, their learners are one value.

    With ``late``, rows that the watermark has passed are handed on as they come, marked; without it the engine drops them beforehand.
    """

    def __init__(
        self, step: Step, start: np.ndarray, fields: T.StructType, key: Sequence[str], order: Sequence[str], output: T.StructType, late: bool = False
    ) -> None:
        self.step, self.start, self.fields, self.key, self.order, self.late = step, np.asarray(start, float), fields, list(key), list(order), late
        self.output = output.fieldNames()
        self.whole = [f.name for f in output.fields if isinstance(f.dataType, T.LongType)]
        self.names = fields.fieldNames()
        self.outer = [_outer(n) for n in self.names]

    def init(self, handle) -> None:
        self.handle = handle
        keys = [T.StructField(f"k{i}", T.ArrayType(self.fields[_inner(k)].dataType)) for i, k in enumerate(self.key)]
        self.learner = handle.getValueState("learner", T.StructType([*keys, T.StructField("v", T.ArrayType(T.ArrayType(T.DoubleType())))]))
        self.buffer = handle.getListState("buffer", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.fields.fields]))
        self.due = handle.getValueState("due", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        fresh = pd.concat(list(rows), ignore_index=True)
        mark = timerValues.getCurrentWatermarkInMs()
        passed = fresh["at_ms"] <= mark
        if self.late and passed.any():
            yield self._marked(fresh[passed])
            fresh = fresh[~passed]
        elif passed.any():
            yield from self._release(fresh, mark, None)
            return
        if len(fresh):  # nothing is due before the watermark moves on, so what waits is not read
            self._wait(fresh, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(None, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        learners = self._learners()
        names = [tuple(None if pd.isna(v) else _plain(v) for v in k) for k in initialState[self.key].itertuples(index=False, name=None)]
        learners.update(zip(names, initialState["_state"], strict=True))
        self._keep(learners)

    def _learners(self) -> dict[tuple, np.ndarray]:
        if not self.learner.exists():
            return {}
        *keys, states = self.learner.get()
        return dict(zip(zip(*keys, strict=True), states, strict=True))

    def _keep(self, learners: dict[tuple, np.ndarray]) -> None:
        keys = zip(*learners, strict=True)
        self.learner.update((*[[_plain(v) for v in k] for k in keys], [np.asarray(v, float).tolist() for v in learners.values()]))

    def _column(self, rows: pd.DataFrame, name: str) -> list:
        values = rows[name]
        if values.dtype == object:
            return [_plain(v) for v in values]
        if values.dtype.kind == "f" and isinstance(self.fields[name].dataType, T.IntegralType):
            return [None if pd.isna(v) else int(v) for v in values]
        return values.tolist()

    def _wait(self, rows: pd.DataFrame, expired: int | None) -> None:
        """Add rows (inner names) to those that wait; the bucket has one timer, at the first of them."""
        for i in range(0, len(rows), PACKED):
            part = rows.iloc[i : i + PACKED]
            self.buffer.appendValue(tuple(self._column(part, n) for n in self.names))
        first, due = int(rows["at_ms"].min()), self.due.get()[0] if self.due.exists() else None
        if due is not None and due != expired and first < due:
            self.handle.deleteTimer(due)
        if due is None or due == expired or first < due:
            self.handle.registerTimer(first)
            self.due.update((first,))

    def _marked(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows without a result: their key, time, and mark."""
        made = pd.DataFrame({c: pd.Series([None] * len(rows), dtype=object) for c in self.output})
        for name in self.key:
            made[name] = rows[_inner(name)].to_numpy()
        made["late"], made["at"] = True, pd.to_datetime(rows["at_us"].to_numpy(), unit="us", utc=True)
        for name in self.whole:
            made[name] = made[name].astype("Int64")
        return made[self.output]

    def _release(self, fresh: pd.DataFrame | None, mark: int, expired: int | None):
        """Step the rows, waiting and fresh, that the watermark has passed, key by key; the others wait on."""
        parts = [pd.DataFrame(dict(zip(self.names, columns, strict=True))) for columns in (self.buffer.get() if self.buffer.exists() else ())]
        parts += [] if fresh is None else [fresh[self.names]]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        ready = rows["at_ms"] <= mark
        if not ready.any():
            return
        self.buffer.clear()
        if self.due.exists():
            if self.due.get()[0] != expired:
                self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if not ready.all():
            self._wait(rows[~ready], expired)
        pdf = rows[ready].set_axis(self.outer, axis=1)
        codes = np.stack([pd.factorize(pdf[k], use_na_sentinel=False)[0] for k in self.key], axis=1)
        marks = [f"_code{i}" for i in range(len(self.key))]
        pdf = pdf.assign(**dict(zip(marks, codes.T, strict=True))).sort_values([*marks, *self.order], kind="stable", ignore_index=True).drop(columns=marks)
        learners, columns, done = self._learners(), arrays(pdf), []
        for name, a, b in key_runs(pdf, self.key):
            out, learners[name] = self.step({c: v[a:b] for c, v in columns.items()}, np.asarray(learners.get(name, self.start), float))
            done.append(out)
        self._keep(learners)
        made = frame(done)
        if self.late:
            made["late"], made["at"] = False, pd.to_datetime(pdf["at_us"].to_numpy(), unit="us", utc=True)
        for name in self.whole:
            made[name] = made[name].astype("Int64")
        yield made[self.output]

    def close(self) -> None:
        pass


def _bucket(key: Sequence[str], inner: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; missing values have buckets of their own, so that a column of a bucket is whole or empty."""
    absent = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(inner)), F.lit(0))
    return (F.pmod(F.xxhash64(*[F.col(c) for c in inner]), F.lit(buckets)) + absent * buckets).cast("bigint").alias(BUCKET)


def stream_detector(
    df: DataFrame, key: Sequence[str], event_time: str, order: Sequence[str], columns: Sequence[str], step: Step, start: np.ndarray,
    schema: str, delay: str | None = "0 seconds", states: DataFrame | None = None, late: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Run a batch kernel on a stream: one state per key, rows stepped in event-time order.

    Rows later than the watermark are dropped by the engine, which counts them (``dropped_rows``). With ``late`` they come out instead, each with its
    key, ``late`` and its time ``at`` and nothing else, so that no row vanishes; rows with a result then have ``late`` false. ``delay`` is
    None where the rows carry a watermark already, as behind an event-time window. ``states`` (key..., ``_state``) warms keys from an earlier run.
    A task holds the waiting rows and the learners of one bucket at a time; ``buckets`` stays as it is for the life of a checkpoint.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = df if delay is None else df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    # order ties inside a millisecond by microseconds and then by the given columns
    rows = timed.withColumns({"at_us": F.unix_micros(event_time), "at_ms": F.floor(F.unix_micros(event_time) / 1000).cast("bigint")})
    names = list(dict.fromkeys([*key, *columns, *[c for c in order if c != event_time], "at_us", "at_ms"]))
    # the engine drops late rows by the column that bears the watermark; without that column they reach the processor
    kept = rows.select(*([] if late else [event_time]), *[F.col(n).alias(_inner(n)) for n in names])
    fields = T.StructType([kept.schema[_inner(n)] for n in names])
    output = T._parse_datatype_string(schema + (", late boolean, at timestamp" if late else ""))
    sort = ["at_us", *[c for c in order if c != event_time]]
    processor = OrderedProcessor(step, start, fields, key, sort, output, late)
    initial = None if states is None else states.select(*key, "_state", _bucket(key, key, buckets)).groupBy(BUCKET)
    return kept.withColumn(BUCKET, _bucket(key, [_inner(k) for k in key], buckets)).groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime", initialState=initial
    )


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the engine dropped behind the watermark, over the progress reports it still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_to_tables(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Process everything available of a stream made with ``late`` and write two tables: rows in time, and late ones.

    Every micro-batch has a folder of its own in both, replaced as a whole if the batch runs again.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"

    def split(batch: DataFrame, number: int) -> None:
        batch.write.partitionBy("late").mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(split).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    fields = [f for f in stream.schema.fields if f.name != "late"]
    schema = T.StructType([*fields, T.StructField("late", T.BooleanType())])
    table = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    return table.where(~F.col("late")).select(*[f.name for f in fields]), table.where("late").select(*[f.name for f in fields])


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, write parquet, return the table; a checkpoint makes it resumable."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
