"""The bounded measurement whose mean differs most between two groups, and scores made with it.

Data passes are Spark aggregations that end in one d x d row per group; the eigenproblem of that
row runs in a pandas UDF, so thousands of groups are solved in parallel and one group costs one
small task. Effects are collected only to be shipped to the scoring tasks, and their number and
dimension are checked first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewatch.functions.arrays import col, dot, doubles, minus, norm, total, vector
from statewatch.functions.encode import power_spectrum
from statewatch.operators.states import SQL_DIM, _square, additive_state, density, moments, pooled_covariance, twirl
from statewatch.plans import bounded_model, place, require

CONTRAST = (
    "delta array<double>, eigenvalues array<double>, eigenvectors array<double>, effect array<double>, "
    "sign array<double>, positive_gap double, negative_gap double, trace_norm double, rank int"
)


def contrast_of(
    positive: Column | str,
    negative: Column | str,
    w_pos: float = 1.0,
    w_neg: float = 1.0,
    rank: int | None = None,
    tolerance: float = 1e-12,
) -> Column:
    """Struct with the contrast of two flat densities: eigenvalues descending, effect, gaps."""
    if w_pos < 0 or w_neg < 0 or (rank is not None and rank < 0):
        raise ValueError("weights and rank must be nonnegative")

    @F.pandas_udf(CONTRAST)
    def solve(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(a, b, strict=True):
            delta = w_pos * _square(p) - w_neg * _square(q)
            values, vectors = np.linalg.eigh(delta)
            values, vectors = values[::-1], vectors[:, ::-1]
            chosen = np.flatnonzero(values > tolerance)[: None if rank is None else rank]
            basis = vectors[:, chosen]
            signs = np.where(np.abs(values) <= tolerance, 0.0, np.sign(values))
            rows.append(
                (
                    delta.ravel(),
                    values,
                    vectors.T.ravel(),
                    (basis @ basis.T).ravel(),
                    ((vectors * signs) @ vectors.T).ravel(),
                    float(values[chosen].sum()),
                    float(np.minimum(values, 0).sum()),
                    float(np.abs(values).sum()),
                    len(chosen),
                )
            )
        names = [c.split()[0] for c in CONTRAST.split(", ")]
        return pd.DataFrame(rows, columns=names)

    return solve(col(positive), col(negative))


def two_sides(densities: DataFrame, label: str, positive, negative, key: Sequence[str] = (), rho: str = "rho") -> DataFrame:
    """One row per key with the densities of the two labels side by side."""
    side = lambda v: F.any_value(F.when(F.col(label) == v, F.col(rho)), ignoreNulls=True)
    return densities.groupBy(*key).agg(side(positive).alias("pos"), side(negative).alias("neg"))


def fit_contrast(
    densities: DataFrame, label: str, positive, negative, key: Sequence[str] = (), rho: str = "rho", **options
) -> DataFrame:
    """One contrast per key from a table of densities (``rho``) by ``label``."""
    sides = two_sides(densities, label, positive, negative, key, rho)
    whole = sides.where(F.col("pos").isNotNull() & F.col("neg").isNotNull())
    return whole.select(*key, contrast_of("pos", "neg", **options).alias("_c")).select(*key, "_c.*")


def effect_matrix(contrast: DataFrame, name: str = "effect") -> np.ndarray:
    """The single effect of an unkeyed contrast, for shipping to scoring tasks."""
    row = bounded_model(contrast.select(name), 1)[0]
    return _square(row[0])


def score_effect(effect: np.ndarray, vec: Column | str) -> Column:
    """``x' E x / |x|^2`` for a row vector."""
    e = 0.5 * (np.asarray(effect, dtype=float) + np.asarray(effect, dtype=float).T)
    d = len(e)
    x = doubles(vec)
    if d <= SQL_DIM:
        parts = [F.get(x, F.lit(i)) for i in range(d)]
        quad = sum(F.lit(float(e[i, j] * (1 if i == j else 2))) * parts[i] * parts[j] for i in range(d) for j in range(i, d))
        return quad / total(F.transform(x, lambda a: a * a))

    @F.pandas_udf("double")
    def quadratic(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=float)
        m = np.stack(rows.to_list())
        return pd.Series(np.einsum("ni,ni->n", m @ e, m) / np.einsum("ni,ni->n", m, m))

    return quadratic(x)


def score_state(effect: np.ndarray, rho: Column | str) -> Column:
    """``Tr(E rho)`` for a flat state."""
    return dot(vector(np.asarray(effect, dtype=float).T.ravel()), rho)


def modes(contrast: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Long table of modes: ``(k, eigenvalue, kind, component, value)``; positive modes gained weight."""
    d = F.size("eigenvalues")
    long = contrast.select(*key, d.alias("_d"), "eigenvectors", F.posexplode("eigenvalues").alias("k", "eigenvalue"))
    one = long.select(*key, "k", "eigenvalue", F.posexplode(F.slice("eigenvectors", F.col("k") * F.col("_d") + 1, F.col("_d"))).alias("component", "value"))
    kind = F.when(F.col("eigenvalue") > 1e-12, "gained").when(F.col("eigenvalue") < -1e-12, "lost").otherwise("neutral")
    return one.withColumn("kind", kind)


def mode_overlap(mode_rows: DataFrame, direction: Sequence[float], key: Sequence[str] = ()) -> DataFrame:
    """Squared overlap of each mode with a unit direction."""
    unit = np.asarray(direction, dtype=float)
    v = F.get(vector(unit / np.linalg.norm(unit)), F.col("component"))
    inner = F.sum(F.col("value") * v)
    return mode_rows.groupBy(*key, "k", "eigenvalue").agg((inner * inner).alias("overlap"))


def fit_invariant_contrast(
    densities: DataFrame, label: str, positive, negative, group: Sequence[np.ndarray], rank: int | None = None
) -> DataFrame:
    """Best effect among those that commute with a finite group; reports the commutator error."""
    averaged = twirl(densities, "rho", group)
    fitted = fit_contrast(averaged, label, positive, negative, rank=rank)
    mats = [np.asarray(u, dtype=float) for u in group]

    @F.pandas_udf("double")
    def commutator(rows: pd.Series) -> pd.Series:
        return rows.map(lambda m: max(float(np.linalg.norm(u @ _square(m) - _square(m) @ u)) for u in mats))

    return fitted.withColumn("commutator", commutator("effect"))


def invariant_classifier(df: DataFrame, label: str, vec: str, dim: int, positive, negative, rank: int = 2) -> tuple[DataFrame, Column]:
    """Shift-invariant read-out: mean power per class and bin, then the ``rank`` largest gains.

    Returns the (bin, gain, effect) table and a column scoring a row with it.
    """
    rows = df.where(F.col(label).isin(positive, negative)).withColumn("_p", power_spectrum(vec))
    means = class_means(rows, label, "_p", dim, positive, negative)
    gains = means.select(F.posexplode(minus("pos", "neg")).alias("bin", "gain"))
    order = Window.orderBy(F.col("gain").desc(), "bin")  # one row per bin
    chosen = (F.row_number().over(order) <= rank) & (F.col("gain") > 1e-12)
    table = gains.withColumn("effect", chosen.cast("double"))
    effect = [r["effect"] for r in sorted(bounded_model(table), key=lambda r: r["bin"])]
    return table, dot(vector(effect), power_spectrum(vec))


def sector_contrast(
    contrast: DataFrame, sectors: Mapping[str, Sequence[int] | np.ndarray], key: Sequence[str] = (), tolerance: float = 1e-8
) -> DataFrame:
    """Dimension, trace, trace norm and positive gap of each block of a contrast.

    A sector is a list of coordinates or a projector. Sectors must be orthogonal, complete and
    commute with the contrast.
    """
    def solve(rows: pd.Series) -> pd.Series:
        out = []
        for flat in rows:
            delta = _square(flat)
            d = len(delta)
            projectors = {}
            for name, spec in sectors.items():
                p = np.asarray(spec, dtype=float)
                if p.ndim == 1:
                    coords, p = p.astype(int), np.zeros((d, d))
                    p[coords, coords] = 1.0
                if not np.allclose(p @ p, p, atol=tolerance):
                    raise ValueError(f"sector {name} is not a projector")
                if np.linalg.norm(p @ delta - delta @ p) > tolerance:
                    raise ValueError("the contrast is not block diagonal in the sectors")
                if any(np.linalg.norm(p @ other) > tolerance for other in projectors.values()):
                    raise ValueError("sectors are not orthogonal")
                projectors[name] = p
            if not np.allclose(sum(projectors.values()), np.eye(d), atol=tolerance):
                raise ValueError("sectors must sum to the identity")
            found = []
            for name, p in projectors.items():
                weight, basis = np.linalg.eigh(p)
                basis = basis[:, weight > 0.5]
                values = np.linalg.eigvalsh(basis.T @ delta @ basis) if basis.size else np.zeros(0)
                found.append(
                    {
                        "sector": name,
                        "dimension": basis.shape[1],
                        "trace": float(values.sum()),
                        "trace_norm": float(np.abs(values).sum()),
                        "positive_gap": float(np.maximum(values, 0).sum()),
                    }
                )
            out.append(found)
        return pd.Series(out)

    schema = "array<struct<sector string, dimension int, trace double, trace_norm double, positive_gap double>>"
    split = F.pandas_udf(solve, schema)
    return contrast.select(*key, F.explode(split("delta")).alias("_s")).select(*key, "_s.*")


def regime_response(df: DataFrame, param: str, vec: str, dim: int) -> DataFrame:
    """Trace distance of the states at neighbouring parameter values, per unit of the parameter.

    ``peak`` marks the largest response. Neighbours are found among the parameter values alone; the states then meet by joins.
    """
    states = additive_state(df, [param], vec, dim).select(param, density().alias("rho"))
    values = place(df.select(param).distinct(), [], [param], "_p").rows()
    following = values.select(F.col(param).alias("_next"), (F.col("_p") - 1).alias("_p"))
    steps = values.join(following, "_p").select(param, "_next").join(states, param)
    steps = steps.join(states.select(F.col(param).alias("_next"), F.col("rho").alias("_to")), "_next").withColumn("_c", contrast_of("_to", "rho"))
    gap = (F.col("_next") - F.col(param)).cast("double")
    out = steps.select(
        ((F.col(param) + F.col("_next")) / 2.0).alias("midpoint"),
        (F.col("_c.trace_norm") / 2.0).alias("distance"),
        (F.col("_c.trace_norm") / (2.0 * gap)).alias("response"),
        F.col("_c.delta").alias("delta"),
    )
    top = out.agg(F.max_by("midpoint", F.struct(F.col("response"), -F.col("midpoint"))).alias("_top"))  # one row
    return out.crossJoin(F.broadcast(top)).withColumn("peak", F.col("midpoint") == F.col("_top")).drop("_top")


def score_scan(df: DataFrame, param: Sequence[str], score: str) -> DataFrame:
    """Mean score and its standard error per parameter value."""
    return df.groupBy(*param).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        (F.stddev_samp(score) / F.sqrt(F.count(F.lit(1)))).alias("stderr"),
    )


# ---------------------------------------------------------------- directions on simplex rows


def class_means(df: DataFrame, label: str, vec: str, dim: int, positive=1, negative=0) -> DataFrame:
    """One row: mean vectors ``pos`` and ``neg`` with their counts."""
    x = doubles(vec)
    is_pos, is_neg = F.col(label) == F.lit(positive), F.col(label) == F.lit(negative)
    mean = lambda side: F.array(*[F.avg(F.when(side, F.get(x, F.lit(i)))) for i in range(dim)])
    return df.agg(
        mean(is_pos).alias("pos"), mean(is_neg).alias("neg"),
        F.count_if(is_pos).alias("n_pos"), F.count_if(is_neg).alias("n_neg"),
    )


def positive_support(df: DataFrame, label: str, vec: str, dim: int, tolerance: float = 1e-12) -> DataFrame:
    """Effect 1 on each coordinate whose class-1 mean exceeds the class-0 mean; rows must be simplex rows."""
    x = doubles(vec)
    simplex = F.forall(x, lambda v: v >= -tolerance) & (F.abs(total(x) - 1.0) <= 1e-9)
    checked = df.select(label, require(simplex, x, "the projector needs simplex rows").alias("_x"))
    means = class_means(checked, label, "_x", dim)
    return means.select(F.zip_with("pos", "neg", lambda a, b: (a - b > tolerance).cast("double")).alias("effect"))


def positive_part_direction(df: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """Positive part of the mean difference with unit sum; zeros when nothing is positive."""
    means = class_means(df, label, vec, dim)
    part = F.zip_with("pos", "neg", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    rows = means.select(part.alias("d")).withColumn("_s", total("d"))
    return rows.select(F.transform("d", lambda v: F.when(F.col("_s") > 0, v / F.col("_s")).otherwise(F.lit(0.0))).alias("direction"))


def hotelling_direction(
    df: DataFrame, label: str, vec: str, dim: int, ridge_fraction: float, floor: float
) -> DataFrame:
    """``(pooled covariance + ridge I)^-1 (mean1 - mean0)`` with unit norm, and the ridge used."""
    per_class = moments(df.where(F.col(label).isin(0, 1)), [label], vec, dim)
    sides = per_class.agg(
        F.any_value(F.when(F.col(label) == 1, F.col("mean")), ignoreNulls=True).alias("m1"),
        F.any_value(F.when(F.col(label) == 0, F.col("mean")), ignoreNulls=True).alias("m0"),
        F.min("n").alias("least"),
    )
    joined = sides.crossJoin(F.broadcast(pooled_covariance(per_class)))  # one row each

    @F.pandas_udf("ridge double, direction array<double>")
    def solve(m1: pd.Series, m0: pd.Series, cov: pd.Series, least: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, n in zip(m1, m0, cov, least, strict=True):
            if n < 2 or a is None or b is None:
                raise ValueError("each class needs two rows")
            s = _square(c)
            ridge = max(floor, ridge_fraction * float(np.trace(s)) / len(s))
            w = np.linalg.solve(s + ridge * np.eye(len(s)), np.asarray(a) - np.asarray(b))
            size = float(np.linalg.norm(w))
            rows.append((ridge, w / size if size else w))
        return pd.DataFrame(rows, columns=["ridge", "direction"])

    return joined.select(solve("m1", "m0", "cov", "least").alias("_h")).select("_h.*")


def fit_logistic_effect(df: DataFrame, label: str, vec: str, c: float, iterations: int = 200) -> dict:
    """L2 logistic on simplex rows with intercept; coefficients, the derived effect, training accuracy."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = doubles(vec)
    simplex = F.forall(x, lambda v: v >= -1e-10) & (F.abs(total(x) - 1.0) <= 1e-9)
    rows = df.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(require(simplex, x, "logistic rows must lie on the simplex")).alias("features"),
    )
    n = rows.count()
    model = LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-10
    ).fit(rows)
    weights = model.coefficients.toArray()
    span = float(np.ptp(weights))
    effect = np.zeros_like(weights) if span <= 1e-12 else (weights - weights.min()) / span
    hits = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return {"coefficients": weights, "intercept": float(model.intercept), "effect": effect, "accuracy": float(hits)}


def scalar_classifier(df: DataFrame, label: str, score: str, c: float = 1e3) -> DataFrame:
    """One-feature logistic read-out; adds ``prediction`` at threshold one half."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_f", array_to_vector(F.array(F.col(score).cast("double"))))
    n = rows.count()
    model = LogisticRegression(
        featuresCol="_f", labelCol=label, regParam=1.0 / (c * n), standardization=False, maxIter=200, tol=1e-10
    ).fit(rows)
    return model.transform(rows).drop("_f", "rawPrediction", "probability")


# ---------------------------------------------------------------- simple uses of scores


def binary_success(scored: DataFrame, label: str, score: str, positive, negative, key: Sequence[str] = ()) -> DataFrame:
    """``(mean score on positive rows + 1 - mean score on negative rows) / 2``."""
    side = lambda v: F.avg(F.when(F.col(label) == v, F.col(score)))
    return scored.groupBy(*key).agg((0.5 * (side(positive) + 1.0 - side(negative))).alias("success"))


def nearest_state_score(windows: DataFrame, reference: Sequence[float], alternative: Sequence[float], rho: str = "rho") -> DataFrame:
    """Distance of each window state to the reference minus its distance to the alternative."""
    gap = norm(minus(rho, vector(reference))) - norm(minus(rho, vector(alternative)))
    return windows.withColumn("score", gap)

