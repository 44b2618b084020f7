import numpy as np
import pytest
from pyspark.sql import functions as F

from statewatch.functions import bits as B
from statewatch.functions import encode as E
from statewatch.functions.bets import effect_from_direction, top_k_signed
from statewatch.operators import contrast as C
from statewatch.operators import marginals as M
from statewatch.operators import shaping
from statewatch.operators import states as S
from statewatch.operators.classifier import DensityClassifier, helstrom, improve_basis, pretty_good, start_basis


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), float(rng.uniform(0.5, 2)), [float(v) for v in rng.normal(size=12)]) for i in range(90)]
    return spark.createDataFrame(rows, "id int, label int, w double, x array<double>").cache()


def direct(rows, dim=12, weight=True):
    out = np.zeros((dim, dim))
    for r in rows:
        x = np.array(r.x[:dim])
        out += (r.w if weight else 1) * np.outer(x, x) / (x @ x)
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("dim", [4, 12])
def test_additive_state_does_not_depend_on_partitions(data, parts, dim):
    cut = data.withColumn("x", F.slice("x", 1, dim)).repartition(parts)
    rows = cut.collect()
    for r in S.additive_state(cut, ["label"], "x", dim, "w").collect():
        mine = [q for q in rows if q.label == r.label]
        assert r.n == 30 and r.mass == pytest.approx(sum(q.w for q in mine))
        assert np.array(r.acc).reshape(dim, dim) == pytest.approx(direct(mine, dim), abs=1e-9)


def test_merge_remove_and_errors(data):
    whole = S.additive_state(data, [], "x", 12, "w")
    parts = [S.additive_state(data.where(F.col("label") == c), [], "x", 12, "w") for c in range(3)]
    merged = S.merge_states([], *parts).first()
    assert merged.acc == pytest.approx(whole.first().acc) and merged.n == 90
    rest = S.remove_from_state(whole, parts[0], []).first()
    assert rest.acc == pytest.approx(S.merge_states([], *parts[1:]).first().acc, abs=1e-9)
    with pytest.raises(Exception, match="more mass"):
        S.remove_from_state(parts[0], whole, []).collect()
    with pytest.raises(Exception, match="positive"):
        S.additive_state(data.withColumn("w", F.lit(-1.0)), [], "x", 12, "w").collect()
    with pytest.raises(Exception, match="zero vector"):
        S.additive_state(data.withColumn("x", F.transform("x", lambda v: v * 0)), [], "x", 12).collect()


def test_twirls(data):
    rho = S.additive_state(data, [], "x", 12).select(S.density().alias("rho"))
    m = np.array(rho.first().rho).reshape(12, 12)
    shifts = [np.roll(np.eye(12), s, axis=0) for s in range(12)]
    want = np.mean([u @ m @ u.T for u in shifts], axis=0)
    perms = [[(i + s) % 12 for i in range(12)] for s in range(12)]
    for out in (S.twirl(rho, "rho", shifts), S.permutation_twirl(rho, "rho", perms), S.cyclic_twirl(rho, "rho", 12)):
        assert np.array(out.first().rho).reshape(12, 12) == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        S.twirl(rho, "rho", [2 * np.eye(12)])
    report = S.check_density(rho, [], "rho").first()
    assert report.valid and report.trace == pytest.approx(1.0)


def test_moments_and_shrinkage(data):
    x = np.array([r.x for r in data.collect()])
    got = S.moments(data, [], "x", 12).first()
    assert got.mean == pytest.approx(x.mean(axis=0))
    assert np.array(got.cov).reshape(12, 12) == pytest.approx(np.cov(x, rowvar=False))
    out = S.ledoit_wolf(data, [], "x", 12).first()
    r = x - x.mean(axis=0)
    s = r.T @ r / 90
    mu = np.trace(s) / 12
    delta = ((s - mu * np.eye(12)) ** 2).sum() / 12
    beta = sum(((np.outer(v, v) - s) ** 2).sum() for v in r) / 90**2 / 12
    rate = min(beta, delta) / delta
    assert out.shrinkage == pytest.approx(rate)
    assert np.array(out.precision).reshape(12, 12) == pytest.approx(np.linalg.inv((1 - rate) * s + rate * mu * np.eye(12)))


def test_mmd_is_the_kernel_statistic(data):
    a, b = (np.array([r.x for r in data.collect() if r.label == c]) for c in (0, 1))
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    want = ((a @ a.T) ** 2).mean() + ((b @ b.T) ** 2).mean() - 2 * ((a @ b.T) ** 2).mean()
    assert S.mmd2(data, "label", "x", 12, 0, 1).first().mmd2 == pytest.approx(want)


def test_contrast_bounds_and_rank(data):
    dens = S.class_densities(data, "label", "x", 12)
    full = C.fit_contrast(dens, "label", 1, 0).first()
    effect = np.array(full.effect).reshape(12, 12)
    assert effect @ effect == pytest.approx(effect, abs=1e-9)
    assert full.positive_gap + full.negative_gap == pytest.approx(0.0, abs=1e-9)
    one = C.fit_contrast(dens, "label", 1, 0, rank=1).first()
    assert one.rank == 1 and one.positive_gap == pytest.approx(full.eigenvalues[0])
    scored = data.withColumn("s", C.score_effect(effect, "x"))
    got = C.binary_success(scored, "label", "s", 1, 0).first().success
    assert got == pytest.approx(0.5 * (1 + full.positive_gap), abs=1e-9)
    assert all(-1e-9 <= r.s <= 1 + 1e-9 for r in scored.collect())


def test_sectors_reject_a_mixing_contrast(data):
    dens = S.class_densities(data, "label", "x", 12)
    with pytest.raises(Exception, match="block diagonal"):
        C.sector_contrast(C.fit_contrast(dens, "label", 1, 0), {"a": list(range(6)), "b": list(range(6, 12))}).collect()


def test_measurement_rules(spark, data):
    dens = sorted(S.class_densities(data, "label", "x", 12).collect(), key=lambda r: r.label)
    ops = [r.prior * np.array(r.rho).reshape(12, 12) for r in dens]
    stack = np.stack(ops)
    for start in range(6):
        basis, _, history = improve_basis(stack, start_basis(stack, start, 0), 50, 1e-10)
        assert all(b >= a - 1e-12 for a, b in zip(history, history[1:]))
        assert basis.T @ basis == pytest.approx(np.eye(12), abs=1e-9)
    good = pretty_good(ops)
    assert sum(good.effects) == pytest.approx(np.eye(12), abs=1e-9)
    pair = [0.5 * np.array(r.rho).reshape(12, 12) for r in dens[:2]]
    two = helstrom(pair)
    assert two.success == pytest.approx(two.details["closed_form"])
    assert two.success >= pretty_good(pair).success - 1e-12
    model = DensityClassifier(12, random_starts=2).fit(data)
    summary = model.summary(spark).first()
    assert summary.valid and max(r.prior for r in dens) - 1e-9 <= summary.success <= 1
    assert model.expected_accuracy(data).first().accuracy == pytest.approx(summary.success, abs=1e-9)
    assert {r.prediction for r in model.transform(data).collect()} <= {0, 1, 2}
    with pytest.raises(Exception, match="not seen"):
        model.expected_accuracy(data.withColumn("label", F.lit(9))).collect()
    with pytest.raises(ValueError):
        DensityClassifier(12, measurement="pretty_good", decision_rule="spectral").fit(data)


def test_logistic_effect_separates(spark):
    rows = [(c, [0.5 + 0.2 * c + 0.01 * i, 0.5 - 0.2 * c - 0.01 * i]) for c in (0, 1) for i in range(8)]
    out = C.fit_logistic_effect(spark.createDataFrame(rows, "label int, x array<double>"), "label", "x", 100.0)
    assert list(out["effect"]) == [1.0, 0.0] and out["accuracy"] == 1.0


def test_encodings_and_errors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "x array<double>")
    good = df.where("x[0] > 0")
    assert good.select(E.encode("x").alias("e")).first().e == pytest.approx([0.6, 0.8])
    assert df.select(E.encode("x", "stereographic").alias("e")).collect()[1].e == pytest.approx([0, 0, -1])
    with pytest.raises(Exception, match="zero vector"):
        df.select(E.encode("x")).collect()
    with pytest.raises(ValueError):
        E.encode("x", "fourier")
    five = spark.createDataFrame([([1.0] * 5,)], "x array<double>")
    assert len(five.select(E.pad_pow2("x").alias("e")).first().e) == 8


def test_bit_features(spark):
    rng = np.random.default_rng(5)
    rows = [([int(b) for b in rng.integers(0, 2, 25)],) for _ in range(6)]
    out = spark.createDataFrame(rows, "b array<int>").select(
        "b", B.pair_equality("b").alias("f"), B.grid_pair_stats("b", 5).alias("g"), B.pack("b").alias("p"), B.orbit_sum(B.power_state_2d("b", 5), B.mode_orbits(5)).alias("o")
    )
    for r in out.collect():
        b = np.array(r.b)
        i, j = np.triu_indices(25, 1)
        assert r.f == [*b.astype(float), *(b[i] == b[j]).astype(float)]
        z = (1 - 2 * b).reshape(5, 5)
        want = [z.mean()] + [0.5 * ((z * np.roll(z, -n, 1)).mean() + (z * np.roll(z, -n, 0)).mean()) for n in (1, 2)]
        assert [r.g.z, r.g.g1, r.g.g2] == pytest.approx(want)
        assert r.p == sum(int(v) << k for k, v in enumerate(r.b))
        assert sum(r.o) == pytest.approx(1.0)


def test_small_rules(spark):
    df = spark.createDataFrame([([0.0, -2.0, 2.0, 1.0],)], "v array<double>")
    assert df.select(top_k_signed("v", 3).alias("w")).first().w == pytest.approx([0, -1 / 3, 1 / 3, 1 / 3])
    assert df.select(effect_from_direction("v").alias("w")).first().w == pytest.approx([0.5, 0, 1, 0.75])
    with pytest.raises(Exception, match="probability vector"):
        df.select(shaping.require_simplex("v")).collect()
    with pytest.raises(ValueError, match="overlap"):
        shaping.check_intervals([("a", 0, 5), ("b", 4, 6)])
    shards = [spark.createDataFrame([(0,), (1,)], "i bigint"), spark.createDataFrame([(1,), (3,)], "i bigint")]
    with pytest.raises(ValueError, match="cover"):
        shaping.merge_shards(shards, "i", 4)


def test_hamming_median_of_equal_prototypes_is_one(spark):
    df = spark.createDataFrame([(c, [5]) for c in (0, 0, 1, 1)], "c int, w array<bigint>")
    witness = M.fit_hamming(df, "c", "w", 4)
    assert witness.gamma == pytest.approx(np.log(2))
    assert df.select(witness.score("w").alias("s")).first().s == pytest.approx(0.0)


def test_parity_means_by_transform_equal_those_by_mask(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(c), int(c % 3 == 0), int(c) + 64 * int(x)) for c, x in zip(rng.integers(0, 64, 300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "code int, cls int, wide int")
    key = lambda r: (r.n, r.k, r.mask)
    for column in ("code", "wide"):  # bits above the width are not looked at
        fast = {key(r): (r.mean_first, r.mean_second, r.gap) for r in M.parity_gaps(df, "cls", column, 6, 3).collect()}
        monkeypatch.setattr(M, "WALSH_WIDTH", 0)
        slow = {key(r): (r.mean_first, r.mean_second, r.gap) for r in M.parity_gaps(df, "cls", column, 6, 3).collect()}
        monkeypatch.undo()
        assert fast.keys() == slow.keys() and len(fast) == 6 + 15 + 20
        assert all(np.allclose(fast[k], slow[k]) for k in fast)
