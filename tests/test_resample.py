"""Resampling in place: exact totals, agreement with the indexed forms on the same draws, and the right spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewatch.catalog import inference_queries
from statewatch.operators import bootstrap as R
from statewatch.plans import resample as P


@pytest.mark.parametrize(("n", "span"), [(1, 4), (7, 16), (100, 8), (1000, 16)])
def test_every_replicate_draws_exactly_n(n, span):
    copies, befores = [], []
    for at in range(-(-n // span)):
        c, before = P.range_copies(n, span, at, 30, [3, 4])
        copies.append(c)
        befores.append(before)
    whole = np.concatenate(copies, axis=1)
    assert whole.shape == (30, n) and (whole.sum(axis=1) == n).all()
    ends = np.cumsum([c.sum(axis=1) for c in copies], axis=0)
    assert all((b == (ends[i - 1] if i else 0)).all() for i, b in enumerate(befores))


def test_counts_are_multinomial():
    """Mean and variance of one row's count, and the correlation of two rows of different ranges."""
    n, span, reps = 64, 16, 20_000
    whole = np.concatenate([P.range_copies(n, span, at, reps, [9]) [0] for at in range(4)], axis=1)
    assert np.allclose(whole.mean(axis=0), 1.0, atol=0.04)
    assert np.allclose(whole.var(axis=0), 1 - 1 / n, atol=0.06)
    assert abs(np.cov(whole[:, 0], whole[:, 40])[0, 1] + 1 / n) < 0.03


def indices(n, replicates, seed, key_seed, span):
    """The same draws as a table of indices: ``(replicate, position, index)``."""
    whole = np.concatenate([P.range_copies(n, span, at, replicates, [seed, key_seed])[0] for at in range(-(-n // span))], axis=1)
    return [(r, p, int(i)) for r in range(replicates) for p, i in enumerate(np.repeat(np.arange(n), whole[r]))]


def key_seed(spark, seed, *key):
    value = spark.range(1).select(F.xxhash64(F.lit(seed), *[F.lit(k) for k in key]).bitwiseAND(0x7FFFFFFFFFFFFFFF)).first()[0]
    return int(value)


def test_means_equal_the_indexed_form(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 16 * 40)
    rng = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k, n in (("a", 200), ("b", 3), (None, 33)) for i, v in enumerate(rng.normal(0, 1, n))]
    df = spark.createDataFrame(rows, "k string, index bigint, d double").repartition(5)
    found = {r.k: r for r in R.paired_resample(df, "d", 40, ["k"], seed=7).collect()}
    table = []
    for k, n in (("a", 200), ("b", 3), (None, 33)):
        name = spark.createDataFrame([(k,)], "k string").select(F.xxhash64(F.lit(7), "k").bitwiseAND(0x7FFFFFFFFFFFFFFF)).first()[0]
        table += [(k, r, i) for r, _, i in indices(n, 40, 7, int(name), 16)]
    drawn = spark.createDataFrame(table, "k string, replicate bigint, index bigint")
    want = {r.k: r for r in R.paired_bootstrap(df, "d", drawn, ["k"]).collect()}
    assert found.keys() == want.keys()
    for k, r in found.items():
        assert (r.n, round(r.mean, 9), round(r.lower, 9), round(r.upper, 9)) == (want[k].n, round(want[k].mean, 9), round(want[k].lower, 9), round(want[k].upper, 9))


def test_clusters_equal_the_indexed_form(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 16 * 25)
    rng = np.random.default_rng(2)
    rows = [(int(c), float(rng.normal(c % 3, 1))) for c in rng.integers(0, 60, 500)] + [(60, None)]
    df = spark.createDataFrame(rows, "c int, d double")
    n = len({c for c, _ in rows})
    drawn = spark.createDataFrame(indices(n, 25, 3, key_seed(spark, 3), 16), "replicate bigint, position bigint, index bigint")
    a, b = R.cluster_resample(df, "d", "c", 25, seed=3).first(), R.cluster_bootstrap(df, "d", "c", drawn).first()
    assert np.allclose([a.mean, a.lower, a.upper], [b.mean, b.lower, b.upper])


@pytest.mark.parametrize("tied", [False, True])
def test_risk_and_threshold_equal_the_indexed_forms(spark, monkeypatch, tied):
    monkeypatch.setattr(P, "HELD", 16 * 20)
    rng = np.random.default_rng(4)
    n, reps = 150, 20
    labels = rng.integers(0, 2, n)
    rows = [(m, i, i, float(rng.integers(0, 6) if tied else rng.normal()), int(labels[i])) for m in ("x", "y") for i in range(n)]
    scores = spark.createDataFrame(rows, "method string, id bigint, index bigint, score double, label int").repartition(4)
    drawn = spark.createDataFrame(indices(n, reps, 5, key_seed(spark, 5), 16), "replicate bigint, position bigint, index bigint")
    key = lambda r: (r.replicate, r.method, r.budget)
    a = {key(r): (r.captured, r.recall, r.precision, r.retained_rate) for r in R.risk_resample(scores, [3, 20], reps, 5).collect()}
    b = {key(r): (r.captured, r.recall, r.precision, r.retained_rate) for r in R.bootstrap_risk(scores, drawn, [3, 20]).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    maxima = scores.withColumnRenamed("score", "maximum").select("method", "index", "maximum")
    key = lambda r: (r.replicate, r.method)
    value = lambda r: (r.threshold, r.alert_count, r.frozen_count, r.zero_alert_threshold)
    a = {key(r): value(r) for r in R.threshold_resample(maxima, 7, {"x": 1.0, "y": 2.0}, reps, 5).collect()}
    b = {key(r): value(r) for r in R.bootstrap_threshold(maxima, drawn, 7, {"x": 1.0, "y": 2.0}).collect()}
    assert a == b


def test_tasks_without_a_chosen_row(spark, monkeypatch):
    """The heads lie in one range; the tasks of all other ranges have nothing to return."""
    monkeypatch.setattr(P, "HELD", 16 * 20)
    n, reps = 600, 20
    df = spark.range(n).select(F.col("id").alias("index"), (F.col("id") == 5).alias("chosen"))
    drawn = [r for r, _, i in indices(n, reps, 3, key_seed(spark, 3), 16) if i == 5]
    assert [list(r.copies) for r in P.row_copies(df, [], reps, 3).collect()] == [[drawn.count(r) for r in range(reps)]]
    rows = [("m", i, i, float(n - i), i % 2) for i in range(n)]
    scores = spark.createDataFrame(rows, "method string, id bigint, index bigint, score double, label int")
    assert R.risk_resample(scores, [3], reps, 5).count() == reps
    maxima = scores.select("method", "index", F.col("score").alias("maximum"))
    assert R.threshold_resample(maxima, 2, {"m": 1.0}, reps, 5).count() == reps


def test_bad_numbering_and_no_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (2, 1.0)], "index bigint, d double")
    with pytest.raises(Exception, match="numbered"):
        R.paired_resample(df, "d", 3).collect()
    assert P.replicate_sums(df.where("false"), [], ["d"], 3).count() == 0
    with pytest.raises(ValueError):
        P.replicate_sums(df, [], ["d"], 0)


@pytest.mark.parametrize("own", [True, False])
def test_packed_draws_give_the_sums_of_a_join(spark, monkeypatch, own):
    """Ranges of four, packs of seven draws; missing values, an index that occurs twice, draws without a row, a NULL key."""
    monkeypatch.setattr(P, "DRAW_SPAN", 4)
    monkeypatch.setattr(P, "PACKED", 7)
    rng = np.random.default_rng(6)
    rows = [(k, 1, i, None if i % 5 == 0 else float(v)) for k, n in (("a", 30), ("b", 2), (None, 11)) for i, v in enumerate(rng.normal(0, 1, n))] + [("a", 1, 3, 2.5)]
    df = spark.createDataFrame(rows, "k string, j int, index bigint, d double").repartition(3)
    draws = [(str(rng.choice(["a", "b"])) if rng.random() < 0.7 else None, int(rng.integers(-3, 1)), int(rng.integers(0, 34))) for _ in range(300)]
    table = spark.createDataFrame(draws, "k string, replicate bigint, index bigint").repartition(2)
    found = {(r.k, r.j, r.replicate): (r.copies, r.d) for r in P.drawn_sums(df, ["k", "j"], ["d"], table if own else table.drop("k"), 4).collect()}
    want: dict = {}
    for k, j, i, d in rows:
        for q, r, at in draws:
            if at == i and (q == k or not own):
                c, s = want.get((k, j, r), (0, None))
                want[k, j, r] = (c + 1, s if d is None else (s or 0.0) + d)
    assert found.keys() == want.keys()
    for key, (c, s) in want.items():
        assert found[key][0] == c and (found[key][1] is None if s is None else abs(found[key][1] - s) < 1e-9)


def test_only_the_heads_of_a_ranking_are_put_in_order(spark, monkeypatch):
    n, reps, placed, place = 400, 6, [], R.place
    monkeypatch.setattr(R, "place", lambda df, key, *a, **k: placed.append((list(key), df.count())) or place(df, key, *a, **k))
    scores = spark.createDataFrame([("m", i, i, float(i % 37), i % 2) for i in range(n)], "method string, id bigint, index bigint, score double, label int")
    out = R.bootstrap_risk(scores, R.uniform_draws(spark, n, n, reps, 3), [2, 5]).collect()
    assert len(out) == 2 * reps and dict((len(k), c) for k, c in placed)[2] <= 5 * reps


def test_threshold_draws_do_not_pass_the_driver(spark):
    """What the planner takes for a few rows is replicates times rows. With NULL maxima, ties, and a method that lacks some indices."""
    n, reps, block = 3000, 40, 16
    maximum = lambda i: None if i % 11 == 0 else float(i * 7919 % 503)
    maxima = spark.range(n).select(
        F.explode(F.array(F.lit("x"), F.lit("y"))).alias("method"), F.col("id").alias("index"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 503).cast("double").alias("maximum"),
    ).where("method = 'x' OR index < 900")
    drawn = R.circular_blocks(spark, n, n, block, reps, start=lambda r, b: F.pmod(r * 7919 + b * 104729, F.lit(n)))
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    try:
        found = {(r.replicate, r.method): (r.threshold, r.alert_count, r.frozen_count, r.zero_alert_threshold) for r in R.bootstrap_threshold(maxima, drawn, 7, {"x": 400.0}).collect()}
    finally:
        spark.conf.set(name, before)
    want = {}
    for r in range(reps):
        index = [((r * 7919 + p // block * 104729) % n + p % block) % n for p in range(n)]
        for method, rows in (("x", n), ("y", 900)):
            known = sorted((m for i in index if i < rows and (m := maximum(i)) is not None), reverse=True)
            frozen = sum(m > 400 for m in known) if method == "x" else 0
            want[r, method] = (known[7], sum(m > known[7] for m in known), frozen, known[0])
    assert found == want


def test_starts_of_many_documents(spark):
    """From 328,000 documents on, a block's number times 104,729 is more than an int holds."""
    n = 400_000
    rows = inference_queries.doc_indices(spark, n).where(f"replicate = 39 AND position >= {n - 3}").collect()
    first = (39 * 7919 + (n // 16 - 1) * 104729) % n
    assert {r.position: r["index"] for r in rows} == {n - k: (first + 16 - k) % n for k in (1, 2, 3)}
