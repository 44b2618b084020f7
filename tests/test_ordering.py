import numpy as np
import pytest
from pyspark.sql import functions as F

from statewatch.plans import place, quantiles
from tests.conftest import by_key


def test_positions_do_not_depend_on_blocks(stream):
    plain = place(stream, ["k"], ["t0"])
    cut = place(stream, ["k"], ["t0"], rows_per_block=16)
    assert cut.blocked and not plain.blocked
    assert {(r.k, r.t0): r.t for r in plain.rows().collect()} == {(r.k, r.t0): r.t for r in cut.rows().collect()}


@pytest.mark.parametrize("key", [["k"], []])
def test_running_and_look_back(stream, key):
    def build(size):
        p = place(stream, key, ["k", "t0"], "n", rows_per_block=size)
        p = p.running(total=("sum", F.col("s")), low=("min", F.col("s")), high=("max", F.col("s")))
        p = p.look_back(3, lambda w: {"last3": F.sum("s").over(w.rowsBetween(-3, -1)), "prev": F.lag("s").over(w)})
        return sorted((r.k, r.t0, r.n, r.total, r.low, r.high, r.last3, r.prev) for r in p.rows().collect())

    for a, b in zip(build(None), build(8)):
        assert a[:3] == b[:3]
        for x, y in zip(a[3:], b[3:]):
            assert (x is None and y is None) or x == pytest.approx(y)


def test_quantiles_by_rank_match_builtin(stream):
    levels = {"a": 0.25, "b": 0.5, "c": 0.975}
    plain = {r.k: tuple(r[n] for n in levels) for r in quantiles(stream, ["k"], "s", levels).collect()}
    ranked = {r.k: tuple(r[n] for n in levels) for r in quantiles(stream, ["k"], "s", levels, rows_per_block=16).collect()}
    rows = stream.collect()
    for k in plain:
        values = [r.s for r in rows if r.k == k]
        assert plain[k] == pytest.approx(tuple(np.quantile(values, q) for q in levels.values()))
        assert ranked[k] == pytest.approx(plain[k])


def test_draws_ignore_partitioning(spark):
    from statewatch.plans import draw_index

    ids = spark.range(200)
    pick = lambda df: {r[0]: r[1] for r in df.select("id", draw_index(7, 3, F.col("id"))).collect()}
    assert pick(ids.repartition(1)) == pick(ids.repartition(13))


def test_fold_carries_state_across_blocks_and_runs(stream):
    def step(g, state):
        total = state[0] + np.cumsum(g["s"])
        return {"k": g["k"], "t": g["t"], "c": total}, np.array([total[-1]])

    def run(df, size, states=None):
        return place(df, ["k"], ["t0"], rows_per_block=size).fold("k int, t bigint, c double", ["s"], step, np.zeros(1), states)

    plain, cut = run(stream, None), run(stream, 16)
    for k, v in by_key(plain[0], "c").items():
        assert by_key(cut[0], "c")[k] == pytest.approx(v)
    ends = {r.k: r._state[0] for r in plain[1].collect()}
    assert {r.k: r._state[0] for r in cut[1].collect()} == pytest.approx(ends)
    head, tail = stream.where("t0 < 4"), stream.where("t0 >= 4")
    for size in (None, 16):
        resumed, after = run(tail, size, run(head, None)[1])
        assert {r.k: r._state[0] for r in after.collect()} == pytest.approx(ends)
        assert by_key(resumed, "c")[0][-1] == pytest.approx(ends[0])


def test_a_frame_may_span_several_blocks(spark):
    rows = spark.createDataFrame([(0, t, float(t % 7)) for t in range(60)] + [(1, t, 1.0) for t in range(3)], "k int, t0 int, x double")
    wide = lambda w: {"s": F.sum("x").over(w.rowsBetween(-24, 0))}
    short = {(r.k, r.t): r.s for r in place(rows, ["k"], ["t0"]).look_back(24, wide).rows().collect()}
    long = {(r.k, r.t): r.s for r in place(rows, ["k"], ["t0"], rows_per_block=7).look_back(24, wide).rows().collect()}
    assert short == long and len(short) == 63


def test_learners_stream_through_a_long_key(spark):
    """A key that takes many Arrow batches, cold and warm, against a plain loop."""
    n = 25_000
    rows = spark.range(n).select((F.col("id") % 3 == 2).cast("int").alias("k"), F.col("id").alias("t0"), (F.col("id") % 11).cast("double").alias("x"))

    def step(g, state):
        total = np.cumsum(g["x"]) + state[0]
        return {"k": g["k"], "t": g["t"], "s": total}, np.array([total[-1]])

    warm = spark.createDataFrame([(0, [5.0]), (9, [1.0])], "k int, _state array<double>")
    placed = place(rows, ["k"], ["t0"], spread=True)
    for states, first in ((None, 0.0), (warm, 5.0)):
        out, ends = placed.fold("k int, t bigint, s double", ["x"], step, np.zeros(1), states)
        last = {r.k: r.s for r in out.groupBy("k").agg(F.max_by("s", "t").alias("s")).collect()}
        want = {k: sum(float(i % 11) for i in range(n) if (i % 3 == 2) == bool(k)) for k in (0, 1)}
        want[0] += first
        assert last == want and out.count() == n
        ended = {r.k: r["_state"][0] for r in ends.collect()}
        assert {k: ended[k] for k in (0, 1)} == want and ended.get(9) == (None if states is None else 1.0)
