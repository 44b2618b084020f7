"""Thresholds, ROC and multi-class evaluation, fold summaries and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewatch.plans import place
from statewatch.plans.guards import null_safe


def _by_score(df: DataFrame, label: str, score: str, key: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: the only thing ranking measures need."""
    one, zero = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*key, F.col(score).cast("double").alias("score")).agg(one.alias("pos"), zero.alias("neg"))


def best_threshold(df: DataFrame, label: str, score: str, key: Sequence[str] = ()) -> DataFrame:
    """Threshold (rule: score >= threshold) with the best balanced accuracy.

    Candidates are the distinct scores and +inf; ties go to the highest finite threshold, and
    +inf alone stands for the largest score.
    """
    cells = _by_score(df, label, score, key)
    placed = place(cells, key, [F.col("score").desc()], "_t")
    above = placed.running(tp=("sum", F.col("pos")), fp=("sum", F.col("neg"))).rows()
    totals = cells.groupBy(*key).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.max("score").alias("_top"))
    rows = null_safe(above, totals, list(key))
    balanced = 0.5 * (F.col("tp") / F.col("_p") + 1.0 - F.col("fp") / F.col("_n"))
    level = F.floor(balanced / 1e-15 / 16)  # a few units in the last place count as a tie
    best = F.max_by(F.struct(F.col("score"), balanced.alias("b")), F.struct(level, F.col("score")))
    out = rows.groupBy(*key).agg(best.alias("_b"), F.any_value("_top").alias("_top"))
    poor = F.col("_b.b") < 0.5 - 1e-15
    return out.select(
        *key,
        F.when(poor, F.col("_top")).otherwise(F.col("_b.score")).alias("threshold"),
        F.greatest(F.col("_b.b"), F.lit(0.5)).alias("balanced_accuracy"),
    )


def roc_auc(df: DataFrame, label: str, score: str, key: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting one half, from running counts over distinct scores."""
    placed = place(_by_score(df, label, score, key), key, ["score"], "_t")
    rows = placed.running(_below=("sum", F.col("neg"))).rows()
    wins = F.sum(F.col("pos") * (F.col("_below") - 0.5 * F.col("neg")))
    return rows.groupBy(*key).agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def evaluate(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """AUC, confusion counts, rates and balanced accuracy at ``score >= threshold``."""
    hit, one = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(one & hit).alias("tp"), F.count_if(one & ~hit).alias("fn"),
        F.count_if(~one & hit).alias("fp"), F.count_if(~one & ~hit).alias("tn"),
    )
    tpr, tnr = F.col("tp") / (F.col("tp") + F.col("fn")), F.col("tn") / (F.col("tn") + F.col("fp"))
    rates = counts.select("*", tpr.alias("tpr"), tnr.alias("tnr"), (0.5 * (tpr + tnr)).alias("balanced_accuracy"))
    return rates.crossJoin(roc_auc(df, label, score))  # one row each


def evaluate_multiclass(df: DataFrame, label: str, prediction: str, key: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 from the confusion counts."""
    cells = df.groupBy(*key, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    long = cells.select(
        *key, "_n", hit.alias("_h"),
        F.explode(F.array(F.struct(F.lit(True).alias("true"), F.col("_y").alias("c")), F.struct(F.lit(False).alias("true"), F.col("_p").alias("c")))).alias("_e"),
    )
    per = long.groupBy(*key, F.col("_e.c").alias("_c")).agg(
        F.sum(F.when(F.col("_e.true"), F.col("_n")).otherwise(0)).alias("_true"),
        F.sum(F.when(~F.col("_e.true"), F.col("_n")).otherwise(0)).alias("_said"),
        F.sum(F.when(F.col("_e.true"), F.col("_h")).otherwise(0)).alias("_hits"),
    )
    return per.groupBy(*key).agg(
        (F.sum("_hits") / F.sum("_true")).alias("accuracy"),
        F.avg(F.when(F.col("_true") > 0, F.col("_hits") / F.col("_true"))).alias("balanced_accuracy"),
        F.avg(2.0 * F.col("_hits") / (F.col("_true") + F.col("_said"))).alias("macro_f1"),
    )


def average_rank(df: DataFrame, block: Sequence[str], value: str, ascending: bool = False) -> DataFrame:
    """Rank inside each block with tied values sharing the average; a block is one fold or dataset."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    rank = F.rank().over(Window.partitionBy(*block).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*block, value))
    return df.withColumn("rank", rank + (ties - 1) / 2.0)


def summarize_folds(records: DataFrame, value: str = "accuracy") -> tuple[DataFrame, DataFrame]:
    """Mean, sample deviation and median per dataset and method; the method board by mean rank."""
    summary = records.groupBy("dataset", "method").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.count(F.lit(1)).alias("folds")
    )
    ranked = average_rank(records, ["dataset", "repeat", "fold"], value)
    board = ranked.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.avg(value).alias("mean"))
    return summary, board.orderBy("mean_rank", "method")


def pivot_metric(df: DataFrame, row: str, column: str, values: Sequence, metric: str) -> DataFrame:
    """Row x column matrix of means; the column values are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, list(values)).avg(metric)


def select_best(df: DataFrame, by: Sequence[str], metric: str, parameter: str, largest: bool = False) -> DataFrame:
    """The row with the smallest (or largest) metric per group; ties go to the smaller parameter."""
    key = -F.col(metric) if largest else F.col(metric)
    names = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct(key, F.col(parameter))).alias("_b"))
    return best.select(*by, "_b.*")


def estimator_errors(df: DataFrame, expected: DataFrame, budgets: Sequence[int], group: Sequence[str], replicate: str, order: str, observable: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Error of the running mean at each budget, per replicate, and its spread over replicates.

    ``df`` holds one value per (group, replicate, observable, order); ``expected`` the exact
    value ``p`` per observable.
    """
    keys = [*group, replicate, observable]
    placed = place(df, keys, [order], "_t").rows()
    cut = placed.select(*keys, value, F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"), "_t").where("_t <= budget")
    means = cut.groupBy(*keys, "budget").agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n")).where("_n = budget")
    gaps = means.join(expected, observable).withColumn("_e", F.col("_m") - F.col("p"))
    per = gaps.groupBy(*group, replicate, "budget").agg(
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"),
        F.avg("_e").alias("bias"), F.max(F.abs("_e")).alias("max_error"),
    )
    rolled = per.groupBy(*group, "budget").agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.avg("mae").alias("mean_mae"),
        F.avg("max_error").alias("mean_max_error"), F.avg("bias").alias("mean_bias"),
        (1.96 * F.stddev_samp("rmse") / F.sqrt(F.count(F.lit(1)))).alias("half_width"),
    )
    return per, rolled
