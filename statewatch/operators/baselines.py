"""Standardisation and standard classifiers to compare with, all through Spark ML or moment sums."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import doubles, vector
from statewatch.operators.states import _square, ledoit_wolf, moments
from statewatch.plans import bounded_model, durable, require

METHODS = ("logistic", "lda", "qda", "poly2", "forest", "boosting")
SEED = 90210
BINS = 32  # Spark's trees cut a feature into at most so many
GRID_CELLS = 65_536
FITS_AT_ONCE = 8


def standardize(train: DataFrame, df: DataFrame, vec: str, dim: int) -> DataFrame:
    """``(x - mean) / std`` with population statistics of ``train``; zero variance divides by one."""
    x = doubles(vec)
    stats = train.agg(
        *[F.avg(F.get(x, F.lit(i))).alias(f"m{i}") for i in range(dim)],
        *[F.stddev_pop(F.get(x, F.lit(i))).alias(f"s{i}") for i in range(dim)],
    )
    row = bounded_model(stats, 1)[0]
    mean = vector([row[f"m{i}"] for i in range(dim)])
    spread = vector([row[f"s{i}"] if row[f"s{i}"] > 0 else 1.0 for i in range(dim)])
    return df.withColumn(vec, F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), spread, lambda a, b: a / b))


def _gaussian(rows: DataFrame, means: np.ndarray, precisions: np.ndarray, offsets: np.ndarray) -> DataFrame:
    @F.pandas_udf("double")
    def nearest(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=float)
        m = np.stack(xs.to_list())
        gaps = m[:, None, :] - means[None]
        cost = np.einsum("nci,cij,ncj->nc", gaps, precisions, gaps, optimize=True)
        return pd.Series((-0.5 * cost + offsets).argmax(axis=1).astype(float))

    return rows.withColumn("prediction", nearest("_x"))


def _entries(rows: DataFrame, dim: int) -> DataFrame:
    return rows.select("*", *[F.get("_x", F.lit(i)).alias(f"_x{i}") for i in range(dim)])


def bin_cuts(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per column the ascending bounds of at most ``bins`` bins; a bin holds what is above a bound and not above the next.

    A column of at most ``bins`` values is cut between all of them, any other at its quantiles.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [set() for _ in columns]
        for batch in batches:
            for values, name in zip(found, columns, strict=True):
                if len(values) <= bins:
                    new = pc.unique(batch.column(name)).drop_null()
                    values.update(new.filter(pc.invert(pc.is_nan(new)))[: bins + 1].to_pylist())
        cells = [(i, v) for i, values in enumerate(found) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in ((0, pa.int32()), (1, pa.float64()))], ["i", "v"])

    some = rows.select(*columns).mapInArrow(seen, "i int, v double").groupBy("i").agg(F.collect_set("v").alias("v"))
    values = {r["i"]: sorted(r["v"]) for r in bounded_model(some)}
    many = [i for i in range(len(columns)) if len(values.get(i, ())) > bins]
    levels = [k / bins for k in range(1, bins)]
    ranked = rows.approxQuantile([columns[i] for i in many], levels, 1 / bins**2) if many else []
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in (values.get(i, []) for i in range(len(columns)))]
    for i, found in zip(many, ranked, strict=True):
        cuts[i] = sorted(set(found))
    return cuts


def _cell(columns: Sequence[str], cuts: Sequence[Sequence[float]]) -> Column:
    """Number of a vector's cell in the grid of all bins."""
    at = F.lit(0)
    for name, bounds in zip(columns, cuts, strict=True):
        spot = F.lit(len(bounds))
        for k in range(len(bounds) - 1, -1, -1):
            spot = F.when(F.col(name) <= bounds[k], k).otherwise(spot)
        at = at * (len(bounds) + 1) + require(F.col(name).isNotNull(), spot, "vectors must not hold nulls")
    return at


def _bins(cell: str, cuts: Sequence[Sequence[float]]) -> Column:
    """The bins of a cell as a vector: what a tree can tell apart."""
    out, rest = [], F.col(cell)
    for bounds in reversed(cuts):
        out.insert(0, (rest % (len(bounds) + 1)).cast("double"))
        rest = F.floor(rest / (len(bounds) + 1))
    return array_to_vector(F.array(*out))


def _grow_forest(cells: DataFrame, grid: DataFrame, classes: int, trees: int) -> DataFrame:
    """``grid`` rows with the forest's vote. A row of a bootstrap sample is drawn Poisson(1) times, so n rows of a cell together Poisson(n) times."""

    def draw(cell: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(cell, y, n, strict=True)
        return pd.Series([np.random.default_rng([SEED, int(c), int(k)]).poisson(m, trees).astype(float) for c, k, m in rows], dtype=object)

    drawn = durable(cells.withColumn("_w", F.pandas_udf(draw, "array<double>")("_cell", "_y", "_n")), "draws")
    known = {"ml_attr": {"type": "nominal", "num_vals": classes}}  # a sample may lack a class

    def votes(tree: int) -> np.ndarray:
        sample = drawn.select("_f", F.col("_y").alias("_y", metadata=known), F.get("_w", F.lit(tree)).alias("_w")).where("_w > 0")
        stage = RandomForestClassifier(
            featuresCol="_f", labelCol="_y", weightCol="_w", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", seed=SEED + tree
        )
        found = stage.fit(sample).transform(grid).select("_cell", vector_to_array("rawPrediction").alias("_r"))
        return np.array([r["_r"] for r in sorted(found.collect(), key=lambda r: r["_cell"])])

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        total = sum(pool.map(inheritable_thread_target(grid.sparkSession)(votes), range(trees)))
    pairs = [(i, float(k)) for i, k in enumerate(total.argmax(axis=1))]
    return grid.sparkSession.createDataFrame(pairs, "_cell bigint, prediction double")


def _tree_cells(fit_rows: DataFrame, dim: int) -> tuple[list[list[float]], DataFrame] | None:
    """The bins of each feature, and how many rows of each class a cell of their grid holds; None if the grid is too large to be a model."""
    names = [f"_x{i}" for i in range(dim)]
    cuts = bin_cuts(_entries(fit_rows, dim), names)
    if math.prod(len(c) + 1 for c in cuts) > GRID_CELLS:
        return None
    known = _entries(fit_rows, dim).select(_cell(names, cuts).cast("bigint").alias("_cell"), require(F.col("_y").isNotNull(), F.col("_y"), "labels must not be null").alias("_y"))
    counted = known.groupBy("_cell", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return cuts, durable(counted.withColumn("_f", _bins("_cell", cuts)).coalesce(1), "cells")


def baseline_suite(
    train: DataFrame, test: DataFrame, vec: str, label: str, dim: int, methods: Sequence[str] = METHODS,
    trees: int = 100, rounds: int = 20, rows_by_row: int = 100_000,
) -> DataFrame:
    """Predictions of every method on ``test``: its columns plus ``method`` and ``prediction``.

    ``label`` holds class numbers 0, 1, .... Trees see a row's bins and class only. Above ``rows_by_row`` rows they are therefore grown on
    the counts of rows by cell and class, if the grid of all bins has at most ``GRID_CELLS`` cells; else on the rows one by one.
    """
    scaled_train = standardize(train, train, vec, dim).withColumn("_x", doubles(vec))
    scaled_test = scaled_train if test is train else standardize(train, test, vec, dim).withColumn("_x", doubles(vec))
    fit_rows = scaled_train.withColumn("_f", array_to_vector("_x")).withColumn("_y", F.col(label).cast("double"))
    test_rows = scaled_test.withColumn("_f", array_to_vector("_x"))
    stats = sorted(bounded_model(moments(scaled_train, [label], "_x", dim)), key=lambda r: r[label])
    counts = np.array([r["n"] for r in stats], dtype=float)
    means = np.array([r["mean"] for r in stats])
    log_prior = np.log(counts / counts.sum())
    common = {"featuresCol": "_f", "labelCol": "_y"}
    multi = len(stats) > 2
    counted = _tree_cells(fit_rows, dim) if counts.sum() > rows_by_row and {"forest", "boosting"} & set(methods) else None
    if counted:
        cuts, cells = counted
        grid = train.sparkSession.range(0, math.prod(len(c) + 1 for c in cuts), numPartitions=1).withColumnRenamed("id", "_cell")
        grid = grid.withColumn("_f", _bins("_cell", cuts))
    outputs = []
    for method in methods:
        if method == "lda":
            fitted = bounded_model(ledoit_wolf(scaled_train, [label], "_x", dim), 1)[0]
            precision = _square(fitted["precision"])
            out = _gaussian(test_rows, means, np.repeat(precision[None], len(stats), 0), log_prior)
        elif method == "qda":
            covs = [0.9 * _square(r["cov"]) + 0.1 * np.eye(dim) for r in stats]
            logdet = np.array([np.linalg.slogdet(c)[1] for c in covs])
            out = _gaussian(test_rows, means, np.stack([np.linalg.inv(c) for c in covs]), log_prior - 0.5 * logdet)
        else:
            if method == "logistic":
                stage = LogisticRegression(**common, regParam=1.0 / counts.sum(), standardization=False, maxIter=200)
            elif method == "poly2":
                svc = LinearSVC(maxIter=50, regParam=1.0 / counts.sum(), featuresCol="_p", labelCol="_y")
                head = OneVsRest(classifier=svc, featuresCol="_p", labelCol="_y") if multi else svc
                stage = Pipeline(stages=[PolynomialExpansion(degree=2, inputCol="_f", outputCol="_p"), head])
            elif method == "forest":
                stage = RandomForestClassifier(**common, numTrees=trees, seed=SEED)
            elif method == "boosting":
                weighted = common | ({"weightCol": "_n"} if counted else {})
                gbt = GBTClassifier(**weighted, maxIter=rounds, stepSize=0.1, maxDepth=4, seed=SEED)
                stage = OneVsRest(classifier=gbt, **weighted) if multi else gbt
            else:
                raise ValueError(f"unknown method {method!r}")
            if counted and method in ("forest", "boosting"):
                if method == "forest":
                    found = _grow_forest(cells, grid, int(max(r[label] for r in stats)) + 1, trees)
                else:
                    found = stage.fit(cells).transform(grid).select("_cell", "prediction")
                names = [f"_x{i}" for i in range(dim)]
                at = _entries(test_rows, dim).withColumn("_cell", _cell(names, cuts).cast("bigint"))
                out = at.join(F.broadcast(found), "_cell")  # at most GRID_CELLS rows
            else:
                out = stage.fit(fit_rows).transform(test_rows)
        outputs.append(out.select(*test.columns, F.lit(method).alias("method"), F.col("prediction").cast("int").alias("prediction")))
    result = outputs[0]
    for other in outputs[1:]:
        result = result.unionByName(other)
    return result
