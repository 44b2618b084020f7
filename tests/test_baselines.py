"""Trees grown on counts by cell against trees grown on the rows one by one."""

import numpy as np
import pytest

from statewatch.operators.baselines import baseline_suite, bin_cuts


def rows_of(spark, xs, ys, parts=1):
    data = [(i, int(y), [float(v) for v in x]) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(data, "id int, y int, x array<double>").repartition(parts, "id")


def predicted(rows, method, **options):
    out = baseline_suite(rows, rows, "x", "y", 2, (method,), **options).collect()
    return [r["prediction"] for r in sorted(out, key=lambda r: r["id"])]


def noisy(n=600, classes=2):
    rng = np.random.default_rng(3)
    xs = np.stack([rng.integers(0, 9, n), rng.integers(0, 7, n)], axis=1)
    ys = np.where(rng.uniform(size=n) < 0.3, rng.integers(0, classes, n), (xs[:, 0] > 4) ^ (xs[:, 1] > 2))
    return xs, ys


def test_boosting_on_counts_equals_boosting_on_rows(spark):
    rows = rows_of(spark, *noisy())
    whole = predicted(rows, "boosting", rounds=3)
    assert len(set(whole)) == 2
    assert predicted(rows, "boosting", rounds=3, rows_by_row=0) == whole


def test_forest_draws_do_not_depend_on_partitioning(spark):
    xs, ys = noisy()
    one = predicted(rows_of(spark, xs, ys, 1), "forest", trees=4, rows_by_row=0)
    assert predicted(rows_of(spark, xs, ys, 5), "forest", trees=4, rows_by_row=0) == one
    truth = (xs[:, 0] > 4) ^ (xs[:, 1] > 2)
    assert (np.array(one) == truth).mean() > 0.9


def test_forest_with_a_class_that_samples_may_lack(spark):
    xs, ys = noisy(200, 3)
    ys[ys == 2] = 0
    ys[:2], xs[:2] = 2, 8
    found = predicted(rows_of(spark, xs, ys), "forest", trees=4, rows_by_row=0)
    assert len(found) == 200 and set(found) <= {0, 1, 2}


def test_cuts_separate_few_values_and_quantiles_of_many(spark):
    rng = np.random.default_rng(5)
    few, many = [0.0, 1.0, 5.0], rng.normal(size=3000)
    data = [(few[0 if i else 2], float(v)) for i, v in enumerate(many)] + [(1.0, None)]
    few_cuts, many_cuts = bin_cuts(spark.createDataFrame(data, "a double, b double").repartition(3), ["a", "b"])
    assert few_cuts == [0.5, 3.0]
    sizes = np.bincount(np.searchsorted(many_cuts, many), minlength=32)
    assert len(many_cuts) == 31 and sizes.min() > 70 and sizes.max() < 120


def test_a_null_entry_is_an_error(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0 * i, None if i == 7 else 2.0 * (i % 3)]) for i in range(20)], "id int, y int, x array<double>")
    with pytest.raises(Exception, match="null"):
        predicted(rows, "forest", trees=2, rows_by_row=0)


def test_wide_vectors_keep_the_rows(spark):
    xs = np.random.default_rng(7).normal(size=(300, 5))
    data = [(i, int(x[0] > 0), [float(v) for v in x]) for i, x in enumerate(xs)]
    rows = spark.createDataFrame(data, "id int, y int, x array<double>").repartition(1, "id")
    got = [{r["id"]: r["prediction"] for r in baseline_suite(rows, rows, "x", "y", 5, ("forest",), trees=3, rows_by_row=k).collect()} for k in (0, 1000)]
    assert got[0] == got[1]
