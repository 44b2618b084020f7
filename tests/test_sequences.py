import numpy as np
import pytest
from pyspark.sql import functions as F

from statewatch.functions.likelihood import TemplateModel
from statewatch.functions.learners import spectral_effects
from statewatch.operators import adaptive as A
from statewatch.operators import sequences as Q
from tests.conftest import by_key

BETS = (0.1, 0.5, 0.9)


def rows_of(stream, *names):
    out = {}
    for r in sorted(stream.collect(), key=lambda r: (r.k, r.t0)):
        out.setdefault(r.k, []).append(tuple(r[n] for n in names))
    return out


@pytest.mark.parametrize("size", [None, 16])
def test_bounded_sr_freezes_at_the_alarm(stream, size):
    got = Q.bounded_sr(stream, ["k"], ["t0"], "s", BETS, threshold=20.0, rows_per_block=size).cache()
    stat, alarm = by_key(got, "stat"), by_key(got, "alarm_time")
    for k, rows in rows_of(stream, "s").items():
        r, first = np.zeros(3), None
        for t, (s,) in enumerate(rows, 1):
            if first is None:
                r = (r + 1) * (1 + np.array(BETS) * s)
                first = t if r.mean() >= 20.0 * (1 - 1e-12) else None
            assert stat[k][t - 1] == pytest.approx(r.mean(), rel=1e-9)
            assert alarm[k][t - 1] == first


@pytest.mark.parametrize("size", [None, 16])
def test_zero_ratios_restart_the_statistic(stream, size):
    ratio = F.when(F.pmod("t0", F.lit(7)) == 3, 0.0).otherwise(F.exp("s"))
    got = Q.lr_sr(stream.withColumn("r", F.array(ratio, F.exp(-F.col("s")))), ["k"], ["t0"], "r", 2, threshold=1e9, rows_per_block=size)
    stat = by_key(got, "stat")
    for k, rows in rows_of(stream, "t0", "s").items():
        a = np.zeros(2)
        for t0, s in rows:
            a = (a + 1) * np.array([0.0 if t0 % 7 == 3 else np.exp(s), np.exp(-s)])
            assert stat[k][t0] == pytest.approx(a.mean(), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("size", [None, 16])
def test_banks_keep_running_after_the_alarm(stream, size):
    fs = stream.withColumn("f", F.array(1 + 0.3 * F.col("s"), 1 - 0.3 * F.col("s")))
    e = by_key(Q.eprocess_bank(fs, ["k"], ["t0"], "f", [0.5, 0.5], 200, rows_per_block=size), "stat")
    sr = Q.sr_bank(fs, ["k"], ["t0"], "f", [0.5, 0.5], 5.0, rows_per_block=size).cache()
    stat, alarm = by_key(sr, "stat"), by_key(sr, "alarm")
    for k, rows in rows_of(stream, "s").items():
        a, r, hit = np.zeros(2), np.zeros(2), False
        for t, (s,) in enumerate(rows, 1):
            f = np.array([1 + 0.3 * s, 1 - 0.3 * s])
            a, r = f * (a + 1 / 200), f * (r + 1)
            hit = hit or r.mean() >= 5.0
            assert e[k][t - 1] == pytest.approx((200 - t) / 200 + a.mean(), rel=1e-9)
            assert stat[k][t - 1] == pytest.approx(r.mean(), rel=1e-9)
            assert alarm[k][t - 1] == hit


def test_unit_factors_and_horizon(stream):
    ones = stream.withColumn("f", F.array(F.lit(1.0)))
    assert all(v == pytest.approx(1.0) for vs in by_key(Q.eprocess_bank(ones, ["k"], ["t0"], "f", [1.0], 200), "stat").values() for v in vs)
    assert by_key(Q.sr_bank(ones, ["k"], ["t0"], "f", [1.0], 1e9), "stat")[1] == pytest.approx(list(range(1, 22)))
    with pytest.raises(ValueError, match="horizon"):
        Q.eprocess_bank(ones, ["k"], ["t0"], "f", [1.0], 100)


@pytest.mark.parametrize("size", [None, 16])
def test_page_cusum(stream, size):
    got = by_key(Q.page_cusum(stream, ["k"], ["t0"], ["s"], (0.05, 0.2), rows_per_block=size), "cusum", "t0")
    for k, rows in rows_of(stream, "s").items():
        p, n = np.zeros(2), np.zeros(2)
        for t, (s,) in enumerate(rows):
            p, n = np.maximum(0, p + s - np.array([0.05, 0.2])), np.maximum(0, n - s - np.array([0.05, 0.2]))
            assert got[k][t] == pytest.approx(max(p.max(), n.max()), abs=1e-9)


@pytest.mark.parametrize("size", [None, 16])
def test_chain_sr(stream, size):
    s = F.col("s")
    df = stream.withColumns({"a": F.array(1 - 0.2 * s, 1 + 0.5 * s), "b": F.array(1 - 0.3 * s, 1 + 0.7 * s)})
    mats = [[[0.76, 0.24], [0.56, 0.44]], [[0.88, 0.12], [0.28, 0.72]]]
    got = by_key(Q.hmm_sr(df, ["k"], ["t0"], "a", "b", mats, [0.7, 0.3], threshold=1e12, rows_per_block=size), "stat")
    for k, rows in rows_of(stream, "s").items():
        m = np.zeros((2, 2))
        for t, (v,) in enumerate(rows):
            m = (np.einsum("kh,khj->kj", m, np.array(mats)) + [0.7, 0.3]) * [1 - 0.2 * v, 1 + 0.5 * v]
            m = np.einsum("kh,khj->kj", m, np.array(mats)) * [1 - 0.3 * v, 1 + 0.7 * v]
            assert got[k][t] == pytest.approx(m.sum(axis=1).mean(), rel=1e-9)


def test_chain_increments_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, [int(b) for b in rng.integers(0, 2, 9)]) for k, n in ((0, 60), (1, 8)) for t in range(n)]
    df = spark.createDataFrame(rows, "k int, t0 int, bits array<int>")
    model = TemplateModel(3, 0.6, 0.05)
    runs = [by_key(Q.hmm_increments(df, ["k"], ["t0"], "bits", model, 0.3, 0.4, rows_per_block=n), "increment", "block") for n in (None, 8)]
    for k in runs[0]:
        assert runs[1][k] == pytest.approx(runs[0][k])
    with pytest.raises(Exception, match="even number"):
        Q.hmm_increments(df.where("k = 1 AND t0 < 7"), ["k"], ["t0"], "bits", model, 0.3, 0.4).collect()


REF = np.array([0.4, 0.3, 0.2, 0.1])


@pytest.mark.parametrize("size", [None, 32])
@pytest.mark.parametrize("mode", ["raw", "variance"])
def test_simplex_witness_scores_with_the_past(stream, mode, size):
    unit = stream.withColumn("x", F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda a, b: a + b)))
    cov = np.diag(REF) - np.outer(REF, REF)
    got = by_key(Q.simplex_witness(unit, ["k"], ["t0"], "x", REF, mode, cov, 1e-2, 10, 3, rows_per_block=size), "score", "t0")
    prec = np.linalg.pinv(cov + 1e-2 * np.eye(4), hermitian=True)
    for k, rows in rows_of(unit, "x").items():
        xs, effect = np.array([r[0] for r in rows]), np.zeros(4)
        for t in range(len(xs)):
            assert got[k][t] == pytest.approx(float(effect @ (xs[t] - REF)), abs=1e-9)
            if (t + 1) % 3 == 0:
                delta = xs[max(0, t - 9) : t + 1].mean(axis=0) - REF
                d = prec @ delta
                effect = (delta > 1e-12).astype(float) if mode == "raw" else (d - d.min()) / np.ptp(d)


@pytest.mark.parametrize("size", [None, 32])
def test_box_witness_variance(stream, size):
    got = by_key(Q.box_witness(stream, ["k"], ["t0"], "x", [0.5] * 4, [0.0] * 4, [1.0] * 4, "variance", np.eye(4), 0.1, 12, rows_per_block=size), "score", "t0")
    for k, rows in rows_of(stream, "x").items():
        xs, w = np.array([r[0] for r in rows]), np.zeros(4)
        for t in range(len(xs)):
            assert got[k][t] == pytest.approx(float(w @ (xs[t] - 0.5)), abs=1e-9)
            d = (xs[max(0, t - 11) : t + 1].mean(axis=0) - 0.5) / 1.1
            w = d / np.abs(d).sum()


@pytest.mark.parametrize("size", [None, 32])
def test_contrast_eprocess_matches_start_mixture(stream, size):
    rho = np.diag(REF)
    got = A.contrast_eprocess(stream, ["k"], ["t0"], "x", rho, 8, [0.1, 0.6], rows_per_block=size).cache()
    score, value = by_key(got, "score"), by_key(got, "e_value")
    for k, rows in rows_of(stream, "x").items():
        states = [np.outer(v, v) / (v @ v) for v in (np.array(r[0]) for r in rows)]
        logs, weights = np.empty((0, 2)), []
        for t, state in enumerate(states[:40], 1):
            effect = np.zeros((4, 4))
            if t > 1:
                lam, vec = np.linalg.eigh(np.mean(states[max(0, t - 9) : t - 1], axis=0) - rho)
                effect = vec[:, lam > 1e-12] @ vec[:, lam > 1e-12].T
            s = float(np.trace(effect @ (state - rho)))
            assert score[k][t - 1] == pytest.approx(s, abs=1e-9)
            logs = np.vstack([logs + np.log1p(np.array([0.1, 0.6]) * s), np.log1p(np.array([0.1, 0.6]) * s)])
            weights.append(6 / (np.pi * t) ** 2)
            e = 1 - sum(weights) + float(np.array(weights) @ np.exp(logs).mean(axis=1))
            assert value[k][t - 1] == pytest.approx(e, rel=1e-8)


@pytest.mark.parametrize("size", [None, 16])
def test_ewma_topk(stream, size):
    df = stream.withColumn("d", F.transform("x", lambda v: v - 0.5))
    got = by_key(A.ewma_topk(df, ["k"], ["t0"], "d", 4, 3.0, [1, 2], rows_per_block=size), "scores")
    alpha = 1 - 2 ** (-1 / 3)
    for k, rows in rows_of(df, "d").items():
        e = np.zeros(4)
        for t, (d,) in enumerate(rows):
            d = np.array(d)
            for i, n in enumerate((1, 2)):
                top = np.argsort(-np.abs(e), kind="stable")[:n]
                want = 0.0 if np.abs(e).max() <= 1e-12 else float((np.where(e[top] < 0, -1, 1) * d[top]).sum() / n)
                assert got[k][t][i] == pytest.approx(want, abs=1e-9)
            e = (1 - alpha) * e + alpha * d


@pytest.mark.parametrize("size", [None, 16])
def test_ewma_spectral_refits_by_stride(stream, size):
    z = F.transform("x", lambda v: F.when(v > 0.5, 1.0).otherwise(-1.0))
    flat = F.flatten(F.transform(z, lambda a: F.transform(z, lambda b: (a * b - F.when(a.isNotNull(), 1.0)) / 4)))
    df = stream.withColumn("m", flat)
    diff = F.transform("m", lambda v, i: F.when(F.pmod(i, F.lit(5)) == 0, 0.0).otherwise(v / 2))
    df = df.withColumn("m", diff)
    got = A.ewma_spectral(df, ["k"], ["t0"], "m", 4, 5.0, 4, rows_per_block=size).cache()
    one, pos = by_key(got, "rank_one"), by_key(got, "positive")
    alpha = 1 - 2 ** (-1 / 5)
    for k, rows in rows_of(df, "m").items():
        e, effects = np.zeros((1, 4, 4)), np.zeros((2, 4, 4))
        for t, (m,) in enumerate(rows, 1):
            m = np.array(m).reshape(4, 4)
            want = [np.trace(f @ m) for f in effects]
            assert (one[k][t - 1], pos[k][t - 1]) == pytest.approx(tuple(want), abs=1e-8)
            e = (1 - alpha) * e + alpha * m
            if t % 4 == 0:
                effects = spectral_effects(e)[0]


@pytest.mark.parametrize("size", [None, 16])
def test_online_logistic(stream, size):
    df = stream.withColumn("m", F.transform("x", lambda v: 1 - v))
    rows, states = A.online_logistic(df, ["k"], ["t0"], "x", "m", 4, 0.5, 0.01, rows_per_block=size)
    score, final = by_key(rows, "score"), {r.k: r._state for r in states.collect()}
    for k, data in rows_of(df, "x", "m").items():
        w = np.zeros(4)
        for t, (a, b) in enumerate(data):
            d = np.array(b) - np.array(a)
            margin = w @ d
            assert score[k][t] == pytest.approx(np.tanh(margin / max(1.0, np.abs(w).sum())), abs=1e-9)
            w = w - 0.5 * (-d / (1 + np.exp(margin)) + 0.01 * w)
        assert final[k] == pytest.approx(w)


def test_detectors_in_one_pass_equal_one_trace_each(spark):
    from statewatch.operators.monitor import run_detectors, run_detectors_once

    rng = np.random.default_rng(11)
    ref = [0.4, 0.3, 0.2, 0.1]
    rows = []
    for key, n in ((0, 300), (1, 40), (None, 25)):
        x = rng.dirichlet(np.ones(4), n)
        x[n // 2 :] = 0.3 * x[n // 2 :] + 0.7 * np.eye(4)[3]
        rows += [(key, t, [float(v) for v in r], [float(1 + r[3] - 0.1), float(1 + 0.5 * (r[3] - 0.1))]) for t, r in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if k is None else int(k), int(t), list(x), list(f)) for k, t, x, f in rows], "k int, t0 int, x array<double>, f array<double>").repartition(3)
    cov = np.diag(ref) - np.outer(ref, ref)
    for threshold in (15.0, 1e9):
        args = (df, ["k"], ["t0"], "x", ref, [0.0, 0.0, 0.0, 1.0], cov, 1e-3, 12, 3, threshold)
        slow = {(r.k, r.method): r.alarm_time for r in run_detectors(*args, ratios="f", alternatives=2).collect()}
        fast = {(r.k, r.method): r.alarm_time for r in run_detectors_once(*args, ratios="f", alternatives=2).collect()}
        assert slow == fast and len(fast) == 15
    assert any(a is not None for a in slow.values()) or threshold == 1e9
    assert {r.method for r in run_detectors_once(*args).collect()} == {"blind", "raw", "variance", "matched"}
    assert run_detectors_once(df.where("false"), *args[1:]).count() == 0
