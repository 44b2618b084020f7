import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewatch.functions.learners import smoothing
from statewatch.operators import sequences as Q
from statewatch.operators.adaptive import contrast_eprocess, ewma_spectral, ewma_topk, logistic_kernel, online_logistic, spectral_step, topk_step
from statewatch.operators.sequences import chain_step
from statewatch.operators.states import sliding_state
from statewatch.streaming import (
    box_kernel, contrast_kernel, counted, dropped_rows, held, run_to_table, run_to_tables, simplex_kernel, sliding_kernel, sr_kernel, stream_detector,
)

BETS = (0.1, 0.5)
OUT = "k bigint, t bigint, stat double, alarm boolean, alarm_time bigint"


def files(spark, folder, parts):
    """Rows of three keys in files that arrive one after another, out of order inside a file."""
    rng = np.random.default_rng(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(int(i % 3), start + dt.timedelta(seconds=i), i, float(rng.uniform(-1, 1)), [float(v) for v in rng.uniform(0, 1, 3)]) for i in range(120)]
    schema = "k bigint, ts timestamp, id int, s double, x array<double>"
    size = len(rows) // parts
    frames = []
    for p in range(parts):
        chunk = rows[p * size : (p + 1) * size]
        rng.shuffle(chunk)
        frames.append(spark.createDataFrame(chunk, schema).coalesce(1))
    return frames, spark.createDataFrame(rows, schema), schema


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    frames, everything, schema = files(spark, tmp_path, 3)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    step, start = sr_kernel(["k"], BETS, threshold=8.0)
    for frame in frames:  # every file is a new run that resumes from the checkpoint
        frame.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("_s", F.col("s"))
        result = run_to_table(stream_detector(stream, ["k"], "ts", ["ts", "id"], ["_s"], step, start, OUT), out, check)
    got = {(r.k, r.t): (round(r.stat, 9), r.alarm_time) for r in result.collect()}
    batch = Q.bounded_sr(everything, ["k"], ["ts", "id"], "s", BETS, threshold=8.0)
    assert got == {(r.k, r.t): (round(r.stat, 9), r.alarm_time) for r in batch.collect()}


def test_learner_stream_warmed_by_a_batch(spark, tmp_path):
    _, everything, schema = files(spark, tmp_path, 1)
    both = everything.withColumn("m", F.transform("x", lambda v: 1 - v))
    whole, _ = online_logistic(both, ["k"], ["ts", "id"], "x", "m", 3, 0.5, 0.01)
    head, tail = both.where("id < 60"), both.where("id >= 60")
    _, states = online_logistic(head, ["k"], ["ts", "id"], "x", "m", 3, 0.5, 0.01)
    tail.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tail.schema).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("_d", F.zip_with("m", "x", lambda a, b: a - b))
    step = logistic_kernel(["k", "id"], 0.5, 0.01)
    out = stream_detector(stream, ["k"], "ts", ["ts", "id"], ["_d"], step, np.zeros(3), "k bigint, id int, score double, margin double, loss double", states=states)
    got = {(r.k, r.id): round(r.score, 9) for r in run_to_table(out).collect()}
    assert len(got) == 60
    ids = {}
    for r in sorted(both.collect(), key=lambda r: (r.k, r.ts)):
        ids.setdefault(r.k, []).append(r.id)
    want = {(r.k, ids[r.k][r.t - 1]): round(r.score, 9) for r in whole.collect()}
    assert all(want[key] == v for key, v in got.items())


def deliver(spark, folder, frame):
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_no_row_vanishes_behind_the_watermark(spark, tmp_path):
    """Two deliveries out of order: what is on time and what is late add up to what came in, and only the former is scored."""
    start = dt.datetime(2024, 1, 1)
    schema = "k bigint, ts timestamp, id int, s double"
    row = lambda i, at: (i % 3, start + dt.timedelta(seconds=at), i, ((i * 37) % 19 - 9) / 10)
    first = [row(i, 10 * i) for i in range(60)]
    second = [row(100 + i, 10 * i + 5) for i in range(60)] + [row(200 + i, 600 + i) for i in range(20)]
    last = [row(1000 + i, 10_000) for i in range(3)]  # moves the watermark past everything else, and waits
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    step, begin = sr_kernel(["k"], BETS, threshold=8.0)
    for part in (first, second, last):
        deliver(spark, source, spark.createDataFrame(part, schema))
        stream = spark.readStream.schema(schema).parquet(source).withColumn("_s", F.col("s"))
        timely, late = run_to_tables(stream_detector(stream, ["k"], "ts", ["ts", "id"], ["_s"], step, begin, OUT, delay="100 seconds", late=True), out, check)
    mark = start + dt.timedelta(seconds=590 - 100)
    want_late = [r for r in second if r[1] <= mark]
    assert timely.count() + late.count() == len(first) + len(second)
    assert sorted((r.k, r["at"]) for r in late.collect()) == sorted((r[0], r[1]) for r in want_late) and want_late
    assert late.where("t IS NOT NULL OR stat IS NOT NULL").count() == 0
    kept = spark.createDataFrame([r for r in first + second if r not in want_late], schema)
    batch = Q.bounded_sr(kept, ["k"], ["ts", "id"], "s", BETS, threshold=8.0)
    assert {(r.k, r.t): (round(r.stat, 9), r.alarm_time) for r in timely.collect()} == {(r.k, r.t): (round(r.stat, 9), r.alarm_time) for r in batch.collect()}


def test_keys_share_buckets(spark, tmp_path):
    """Many keys in one call, missing ones apart: over restarts equal to the batch operator and to a bucket for each key, late rows too."""
    rng, start = np.random.default_rng(9), dt.datetime(2024, 1, 1)
    rows = [(None if i % 7 == 3 else i % 7, start + dt.timedelta(seconds=int(i + rng.integers(0, 20))), i, float(rng.uniform(-1, 1))) for i in range(210)]
    schema, step_start = "k bigint, ts timestamp, id int, s double", sr_kernel(["k"], BETS, threshold=8.0)
    found = {}
    for buckets in (1, 64):
        source, out, check = (str(tmp_path / f"{n}{buckets}") for n in ("in", "out", "check"))
        for part in (rows[:100], rows[100:]):
            deliver(spark, source, spark.createDataFrame(part, schema))
            stream = spark.readStream.schema(schema).parquet(source).withColumn("_s", F.col("s"))
            made = stream_detector(stream, ["k"], "ts", ["ts", "id"], ["_s"], *step_start, OUT, delay="5 seconds", late=True, buckets=buckets)
            timely, late = run_to_tables(made, out, check)
        found[buckets] = [sorted(map(str, t.select(F.struct("*").alias("r")).collect())) for t in (timely, late)]
    assert found[1] == found[64]
    mark = max(r[1] for r in rows[:100]) - dt.timedelta(seconds=5)
    behind = [r for r in rows[100:] if r[1] <= mark]
    end = max(r[1] for r in rows) - dt.timedelta(seconds=5)
    kept = [r for r in rows if r not in behind and r[1] <= end]
    assert behind and late.count() == len(behind)
    batch = Q.bounded_sr(spark.createDataFrame(kept, schema), ["k"], ["ts", "id"], "s", BETS, threshold=8.0)
    assert {(r.k, r.t): (round(r.stat, 9), r.alarm_time) for r in timely.collect()} == {(r.k, r.t): (round(r.stat, 9), r.alarm_time) for r in batch.collect()}
    assert len({r.k for r in timely.collect()}) == 7


def test_the_engine_counts_what_it_drops(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "k bigint, ts timestamp, id int, s double"
    step, begin = sr_kernel(["k"], BETS, threshold=8.0)
    dropped = []
    for part in ([(0, start + dt.timedelta(hours=h), h, 0.1) for h in range(50)], [(0, start + dt.timedelta(hours=h), 100 + h, 0.1) for h in range(7)]):
        deliver(spark, str(tmp_path / "in"), spark.createDataFrame(part, schema))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("_s", F.col("s"))
        query = (
            stream_detector(stream, ["k"], "ts", ["ts", "id"], ["_s"], step, begin, OUT)
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        dropped.append(dropped_rows(query))
    assert dropped == [0, 7]


# ---------------------------------------------------------------- ring kernels against the batch operators


def stepped(kernel, columns, sizes, key=7):
    """Rows of one key through a step in chunks of the given sizes; the state is checked to keep its length."""
    step, state = kernel
    outs, at = [], 0
    while at < len(next(iter(columns.values()))):
        n = sizes[len(outs) % len(sizes)]
        g = {c: np.array(list(v[at : at + n]) + [None], dtype=object)[:-1] if isinstance(v, list) else v[at : at + n] for c, v in columns.items()}
        g["k"] = np.full(len(next(iter(g.values()))), key)
        out, after = step(g, state)
        assert after.shape == state.shape
        outs.append(out)
        state, at = after, at + n
    return {c: np.concatenate([np.asarray(list(o[c])) for o in outs]) for c in outs[0]}


@pytest.mark.parametrize("sizes", [[1], [3, 1, 8], [200]])
def test_ring_kernels_equal_the_batch_operators(spark, sizes):
    rng = np.random.default_rng(3)
    d, n = 4, 60
    x = rng.dirichlet(np.ones(d), n)
    x[20:] = 0.5 * x[20:] + 0.5 * np.eye(d)[1]
    ref = [0.3, 0.3, 0.2, 0.2]
    cov = np.diag(ref) - np.outer(ref, ref)
    df = spark.createDataFrame([(7, i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, i int, x array<double>")
    values = {"_x": [np.array(r) for r in x]}

    def batch(out, *names):
        rows = sorted(out.collect(), key=lambda r: r.t)
        return [np.array([r[c] for r in rows]) for c in names]

    for mode, window, every in (("raw", 8, 1), ("raw", 5, 4), ("variance", 6, 3)):
        got = stepped(simplex_kernel(["k"], ref, mode, cov, 1e-3, window, every), values, sizes)
        (want,) = batch(Q.simplex_witness(df, ["k"], ["i"], "x", ref, mode, cov, 1e-3, window, every), "score")
        assert np.allclose(got["score"], want, atol=1e-9) and (got["t"] == np.arange(1, n + 1)).all()
        low, high = [0.0] * d, [1.0] * d
        got = stepped(box_kernel(["k"], ref, low, high, mode, cov, 1e-3, window, every), values, sizes)
        (want,) = batch(Q.box_witness(df, ["k"], ["i"], "x", ref, low, high, mode, cov, 1e-3, window, every), "score")
        assert np.allclose(got["score"], want, atol=1e-9)
    got = stepped(contrast_kernel(["k"], np.diag(ref), 8, rank=2), values, sizes)
    want = batch(contrast_eprocess(df, ["k"], ["i"], "x", np.diag(ref), 8, rank=2), "score", "contrast", "e_value", "p", "alarm")
    for name, column in zip(("score", "contrast", "e_value", "p", "alarm"), want, strict=True):
        assert np.allclose(got[name].astype(float), column.astype(float), atol=1e-9), name
    got = stepped(sliding_kernel(["k"], d, 6), values, sizes)
    want = batch(sliding_state(df, ["k"], ["i"], "x", d, 6), "mass", "full", "acc")
    assert np.allclose(got["mass"], want[0]) and (got["full"] == want[1]).all() and np.allclose(got["acc"], want[2], atol=1e-9)


@pytest.mark.parametrize("sizes", [[1], [5, 2], [200]])
def test_average_and_chain_steps_go_on(spark, sizes):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (50, 3))
    rows = [(7, i, [float(v) for v in r], [float(1 - 0.2 * r[0]), float(1 + 0.5 * r[0])], [float(1 - 0.3 * r[0]), float(1 + 0.7 * r[0])]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, i int, x array<double>, a array<double>, b array<double>")
    got = stepped(counted(topk_step(["k", "t"], smoothing(4.0), [1, 2]), np.zeros(3)), {"_x": [np.array(r) for r in x]}, sizes)
    want = sorted(ewma_topk(df, ["k"], ["i"], "x", 3, 4.0, [1, 2]).collect(), key=lambda r: r.t)
    assert np.allclose(got["scores"], [r.scores for r in want])
    mats = np.array([[[0.76, 0.24], [0.56, 0.44]], [[0.88, 0.12], [0.28, 0.72]]])
    step, _, _ = chain_step(["k", "t"], mats, np.array([0.7, 0.3]), np.array([0.5, 0.5]))
    got = stepped(held(*counted(step, np.zeros(5)), 6.0), {"_a": [np.array(r[3]) for r in rows], "_b": [np.array(r[4]) for r in rows]}, sizes)
    want = sorted(Q.hmm_sr(df, ["k"], ["i"], "a", "b", mats.tolist(), [0.7, 0.3], threshold=6.0).collect(), key=lambda r: r.t)
    assert np.allclose(got["stat"], [r.stat for r in want]) and list(got["alarm_time"]) == [r.alarm_time for r in want]
    m = np.array([np.diag([a, -a]) for a in rng.uniform(-1, 1, 30)])
    flat = spark.createDataFrame([(7, i, [float(v) for v in r.ravel()]) for i, r in enumerate(m)], "k int, i int, d array<double>")
    step, _ = spectral_step(["k", "t"], 2, smoothing(4.0), 4)
    got = stepped(counted(step, np.zeros(8)), {"_x": [r.ravel() for r in m]}, sizes)
    want = sorted(ewma_spectral(flat, ["k"], ["i"], "d", 2, 4.0, 4).collect(), key=lambda r: r.t)
    assert np.allclose(got["rank_one"], [r.rank_one for r in want]) and np.allclose(got["positive"], [r.positive for r in want])
