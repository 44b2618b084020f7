import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewatch.functions.learners import pair_features, spectral_effects, top_k_scores
from statewatch.functions.likelihood import TemplateModel
from statewatch.operators import bank as K
from statewatch.operators.replays import swap_audit_lockstep
from statewatch.operators import bootstrap as R
from statewatch.operators import inference as I
from statewatch.operators import states as S

Q = 4


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(6)
    rows = [
        (0, role, p, [int(b) for b in rng.integers(0, 2, Q)], [int(b) for b in rng.integers(0, 2, Q)])
        for role in range(2)
        for p in range(40)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, role int, pair int, r array<int>, m array<int>").cache()


def run(df, states=None, size=None):
    return K.score_bank(df, ["k", "role"], ["pair"], "r", "m", Q, states, ["pair"], size)


def table(df, *names):
    return {(r.role, r.pair): [np.asarray(r[n], float) for n in names] for r in df.collect()}


@pytest.mark.parametrize("size", [None, 16])
def test_bank_matches_a_plain_loop(pairs, size):
    got = table(run(pairs, size=size)[0], "logistic", "sparse", "spectral")
    for role in (0, 1):
        w, sparse, spectral, effects = np.zeros((3, 10)), np.zeros((4, 10)), np.zeros((3, Q, Q)), np.zeros((3, 2, Q, Q))
        rows = sorted((r for r in pairs.collect() if r.role == role), key=lambda r: r.pair)
        for t, row in enumerate(rows, 1):
            r, m = np.array(row.r, float), np.array(row.m, float)
            d = (pair_features(m[None]) - pair_features(r[None]))[0]
            delta = (np.outer(1 - 2 * m, 1 - 2 * m) - np.outer(1 - 2 * r, 1 - 2 * r)) / Q
            margin = w @ d
            want = [
                np.tanh(margin / np.maximum(1, np.abs(w).sum(axis=1))),
                top_k_scores(sparse, d, [1, 4]).ravel(),
                np.array([[np.trace(e @ delta) for e in es] for es in effects]).ravel(),
            ]
            for a, b in zip(got[role, row.pair], want):
                assert a == pytest.approx(b, abs=1e-9)
            w = w - np.array(K.RATES)[:, None] * (-d / (1 + np.exp(margin))[:, None] + K.L2 * w)
            a4 = np.array([1 - 2 ** (-1 / h) for h in K.SPARSE_HALF_LIVES])[:, None]
            a3 = np.array([1 - 2 ** (-1 / h) for h in K.SPECTRAL_HALF_LIVES])[:, None, None]
            sparse, spectral = (1 - a4) * sparse + a4 * d, (1 - a3) * spectral + a3 * delta
            if t % K.STRIDE == 0:
                effects = spectral_effects(spectral)


def test_roles_are_isolated_and_scores_use_the_past(pairs):
    base = table(run(pairs)[0], "sparse", "logistic")
    flip = F.when((F.col("role") == 1) & (F.col("pair") == 20), F.transform("m", lambda b: 1 - b)).otherwise(F.col("m"))
    other = table(run(pairs.withColumn("m", flip))[0], "sparse", "logistic")
    same = [k for k in base if all(np.array_equal(a, b) for a, b in zip(base[k], other[k]))]
    assert {k for k in base if k[0] == 0 or k[1] < 20} <= set(same)
    assert any(k not in same for k in base if k[0] == 1 and k[1] > 20)


def test_warm_replay_continues_the_stream(pairs):
    whole = table(run(pairs)[0], "spectral", "logistic")
    _, states = run(pairs.where("pair < 16"))
    for size in (None, 8):
        rest = table(run(pairs.where("pair >= 16"), states, size)[0], "spectral", "logistic")
        assert len(rest) == 48
        for k, v in rest.items():
            for a, b in zip(v, whole[k]):
                assert a == pytest.approx(b, abs=1e-9)


def test_priors_and_winners(pairs):
    for q in (2, 4, 24):
        for parts in K.component_priors(q).values():
            assert sum(w for _, w in parts) == pytest.approx(1.0)
    assert len(K.component_priors(24)["composite"]) == 64 + 24
    out = K.empirical_scores(run(pairs)[0], Q)
    for r in out.collect():
        assert r.composite_score == max(r.sparse_score, r.spectral_score)
        assert (r.composite_winner == "sparse") == (r.sparse_score >= r.spectral_score)


@pytest.mark.parametrize("kind,size", [("eprocess", None), ("eprocess", 16), ("sr", None), ("sr", 16)])
def test_one_evidence_step_per_shot(pairs, kind, size):
    rows = K.method_factors(pairs.withColumn("rate", K.rate_score("r", "m")), "rate")
    got = {r.pair: r.log_stat for r in K.shot_process(rows, ["k"], "role", ["pair"], [0.125] * 8, 2, kind, rows_per_block=size).collect()}
    data = {(r.role, r.pair): r for r in rows.collect()}
    a = np.zeros((2, 8))
    for p in range(40):
        f = np.array([data[role, p].factors for role in (0, 1)])
        a = f * (a + (1 / 40 if kind == "eprocess" else 1.0))
        want = a.mean() + ((39 - p) / 40 if kind == "eprocess" else 0.0)
        assert got[p] == pytest.approx(math.log(want), abs=1e-9)


def test_swaps_keep_shots_whole(pairs):
    swapped = K.swap_pairs(pairs, ["k"], ["pair"], "r", "m", 3, 1).collect()
    first = {(r.role, r.pair): r for r in pairs.collect()}
    bits = {}
    for r in swapped:
        src = first[r.role, r.pair]
        assert (r.r, r.m) == ((src.m, src.r) if r.swapped else (src.r, src.m))
        assert bits.setdefault((r.replicate, r.pair), r.swapped) == r.swapped
    assert 0 < sum(bits.values()) < len(bits)


def test_swap_audit_and_bootstrap_from_warm_state(spark, pairs):
    _, states = run(pairs.where("pair < 10"))
    audit = K.swap_audit(pairs, ["k"], "role", ["pair"], "r", "m", Q, 2, 2, 3, ("rate", "composite"), states).collect()
    assert len(audit) == 4 and all(r.shots == 40 and r.max_log_e >= max(0.0, r.final_log_e) - 1e-12 for r in audit)
    identity = R.circular_blocks(spark, 40, 40, 40, 2, start=lambda r, b: F.lit(0))
    maxima, threshold = K.bootstrap_max_e(pairs, ["k"], "role", "pair", "r", "m", Q, 2, "sparse", identity, 2, 40, states)
    values = [r.max_log_e for r in maxima.collect()]
    assert values[0] == pytest.approx(values[1])
    assert threshold.first().threshold == pytest.approx(values[0])
    bank, _ = run(pairs, states)
    weights = [w for _, w in K.component_priors(Q)["sparse"]]
    trace = K.shot_process(K.method_factors(bank, "sparse"), ["k"], "role", ["pair"], weights, 2, "eprocess", 40)
    assert trace.agg(F.max("log_stat")).first()[0] == pytest.approx(values[0])


def test_lockstep_equals_one_replay_after_another(spark, pairs):
    methods = ("rate", "logistic", "sparse", "spectral", "composite")
    both = pairs.unionByName(pairs.where("pair < 17").withColumn("k", F.lit(None).cast(pairs.schema["k"].dataType)))
    args = ("role", ["pair"], "r", "m", Q, 2, 3, 4, methods)
    key = lambda r: (r.k, r.replicate, r.method)
    slow = {key(r): r for r in K.swap_audit(both, ["k"], *args, alpha=0.7).collect()}
    fast = {key(r): r for r in swap_audit_lockstep(both, ["k"], *args, alpha=0.7).collect()}
    assert slow.keys() == fast.keys() and len(fast) == 2 * 3 * 5
    for k, a in slow.items():
        b = fast[k]
        assert (a.max_log_e, a.final_log_e) == (pytest.approx(b.max_log_e, abs=1e-9), pytest.approx(b.final_log_e, abs=1e-9))
        assert (a.crossed, a.first_crossing, a.shots, a.crossed_family) == (b.crossed, b.first_crossing, b.shots, b.crossed_family)
    # a shot without one of its roles teaches the learners it has rows for and is no evidence
    short = swap_audit_lockstep(both.where("NOT (pair = 5 AND role = 0)"), ["k"], *args)
    assert {(r.k, r.shots) for r in short.collect()} == {(0, 39), (None, 16)}


def one_by_one(pairs, indices, method, roles, states=None, horizon=None):
    """The largest log e-value of every replay, each replay through the bank by itself."""
    out = {}
    for k, replicate in {(r.k, r.replicate) for r in indices.collect()}:
        drawn = indices.where(F.col("k").eqNullSafe(k) & (F.col("replicate") == replicate)).select("position", F.col("index").alias("pair"))
        rows = pairs.where(F.col("k").eqNullSafe(k)).join(drawn, "pair").withColumn("who", F.lit(0))
        warm = None if states is None else states.where(F.col("k").eqNullSafe(k)).select(F.lit(0).alias("who"), "role", "_state")
        bank, _ = K.score_bank(rows, ["who", "role"], ["position"], "r", "m", Q, warm, ["position", "r", "m"])
        weights = [w for _, w in K.component_priors(Q)[method]]
        factors = K.method_factors(bank.withColumn("rate", K.rate_score("r", "m")), method)
        top = K.shot_process(factors, ["who"], "role", ["position"], weights, roles, "eprocess", horizon).agg(F.max("log_stat")).first()[0]
        if top is not None:
            out[k, replicate] = top
    return out


@pytest.mark.parametrize("method", ["rate", "composite"])
def test_bootstrap_replays_of_a_key_step_together(spark, pairs, method):
    """Equal to one replay after the other: a null key, uneven draws, a draw that no pair has, a shot without a role and one with a role twice."""
    null = F.lit(None).cast("int")
    part = pairs.where("pair < 13")
    odd = part.where("NOT (pair = 5 AND role = 0)").unionByName(part.where("pair = 8 AND role = 1")).withColumn("k", F.lit(7))
    some = pairs.unionByName(part.withColumn("k", null)).unionByName(odd)
    draws = [(k, r, p, (r * 5 + p * (1 if r < 2 else 3)) % n) for k, n in ((0, 20), (None, 13), (7, 13)) for r in range(3) for p in range(n - (r == 1))]
    indices = spark.createDataFrame([*draws, (0, 0, 20, 99)], "k int, replicate bigint, position bigint, index bigint")
    maxima, _ = K.bootstrap_max_e(some, ["k"], "role", "pair", "r", "m", Q, 2, method, indices, 3, None)
    got = {(r.k, r.replicate): r.max_log_e for r in maxima.collect()}
    want = one_by_one(some, indices.where("position < 20"), method, 2)
    assert got.keys() == want.keys() and len(got) >= 8
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_bootstrap_moves_pairs_once_whatever_the_replicates(spark, pairs):
    from statewatch.operators.replays import replayed_maxima

    indices = R.keyed_blocks(spark.createDataFrame([(0, 40)], "k int, n bigint"), ["k"], "n", 32, 50, seed=1)
    plan = replayed_maxima(pairs, ["k"], "role", "pair", "r", "m", Q, 2, "rate", indices, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_components_beyond_a_double_go_on_as_logs(spark):
    """A stream that always bets right grows past 1e308."""
    n = 1500
    rows = spark.createDataFrame([(0, 0, p, [0] * Q, [1] * Q) for p in range(n)], "k int, role int, pair int, r array<int>, m array<int>")
    indices = R.circular_blocks(spark, n, n, n, 2, start=lambda r, b: F.lit(0))
    maxima, _ = K.bootstrap_max_e(rows, ["k"], "role", "pair", "r", "m", Q, 1, "rate", indices, 2, None)
    a = np.full(8, -np.inf)
    for _ in range(n):
        a = np.log(1 + np.array([s * b for b in K.BETS for s in (1, -1)])) + np.logaddexp(a, -math.log(n))
    want = np.logaddexp.reduce(a) - math.log(8)
    assert want > 800 and all(r.max_log_e == pytest.approx(want, rel=1e-12) for r in maxima.collect())


def test_registered_replays_give_a_threshold_for_each_user(spark):
    from statewatch.catalog import detector_queries as D

    sf = "/root/testdata/sf0.001"
    shots = {r.user_id: r.n for r in D.pair_bits(spark, sf).groupBy("user_id").agg((F.max("pair") + 1).alias("n")).collect()}
    found = D.bootstrap_max(spark, sf).collect()
    assert len(found) == 99 * len(shots) and len({(r.user_id, r.replicate) for r in found}) == len(found)
    for user in shots:
        own = [r for r in found if r.user_id == user]
        assert {r.threshold for r in own} == {max(r.max_log_e for r in own)}
    audit = D.swap_audit(spark, sf).collect()
    assert len(audit) == 99 * 5 * len(shots) and len({r.method for r in audit}) == 5
    assert all(r.shots == shots[r.user_id] for r in audit)


def test_keyed_blocks(spark):
    sizes = spark.createDataFrame([(1, 70), (2, 3), (3, 32)], "k int, n bigint")
    found = R.keyed_blocks(sizes, ["k"], "n", 32, 4, seed=1).collect()
    for k, n in ((1, 70), (2, 3), (3, 32)):
        for replicate in range(4):
            own = sorted((r.position, r["index"]) for r in found if (r.k, r.replicate) == (k, replicate))
            assert [p for p, _ in own] == list(range(n))
            assert all(b == (a + 1) % n for (p, a), (_, b) in zip(own, own[1:]) if (p + 1) % 32)


def test_distribution_tails():
    assert I.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-6)
    assert I.beta_quantile(0.975, 1, 10) == pytest.approx(1 - 0.025**0.1, abs=1e-12)
    assert I.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert I.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert I.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert I.signed_rank_tail(0, 5) == pytest.approx(2 / 32)


def test_clopper_pearson_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10)], "k int, n int")
    got = [tuple(r.i) for r in df.select(I.clopper_pearson("k", "n").alias("i")).collect()]
    assert got[0] == pytest.approx((0, 1 - 0.025**0.1)) and got[1] == pytest.approx((0.025**0.1, 1))
    low, high = got[2]
    tail = lambda p, ks: sum(math.comb(10, k) * p**k * (1 - p) ** (10 - k) for k in ks)
    assert tail(low, range(3, 11)) == pytest.approx(0.025) and tail(high, range(4)) == pytest.approx(0.025)


def test_model_tables_are_not_joined_by_sorting_the_rows(spark):
    df = spark.createDataFrame([(k, [float(i), float(i * i % 7)]) for i in range(40) for k in ("a", "b", None)], "k string, x array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        means = S.moments(df, ["k"], "x", 2)
        out = K.hotelling_score(df, "x", means, np.eye(2), ["k"])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (means, out)]
        assert out.count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("SortMergeJoin" in p for p in plans)


def test_ratios_of_a_grid_work_out_the_lengths_once(spark):
    model = TemplateModel(3, event=0.6, eps=0.05)
    df = spark.createDataFrame([([(c >> i) & 1 for i in range(9)],) for c in range(0, 512, 7)], "bits array<int>").withColumn("g", model.counts("bits"))
    each = [model.ratio(F.col("g"), q, 0.3) for q in (0.1, 0.9)]
    both = model.ratios(F.col("g"), (0.1, 0.9), 0.3)
    for r in df.select(F.array(*each).alias("a"), both["ratio"].alias("b")).collect():
        assert np.allclose(r.a, r.b, rtol=1e-12)
    assert 2 * len(str(both)) < sum(len(str(c)) for c in each)
