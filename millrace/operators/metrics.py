"""Aggregations: hierarchies of means, classification and probability metrics, quantile rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def staged_mean(df: DataFrame, levels: list[list[str]], value: str, name: str = "mean") -> DataFrame:
    """Unweighted means, level by level; the last level's keys remain."""
    out = df.select(*dict.fromkeys(c for keys in levels for c in keys), F.col(value).alias(name))
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(name).alias(name)) if keys else out.agg(F.avg(name).alias(name))
    return out


def finite(c: Column) -> Column:
    """The value, null where it is null, NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def equal_weight_summary(df: DataFrame, unit: str, value: str, by: list[str] = ()) -> DataFrame:
    """Over unit means: mean, median, sd; rows without a finite value are counted apart."""
    v = finite(F.col(value))
    means = df.groupBy(*by, unit).agg(F.avg(v).alias("_m"), F.count_if(v.isNull()).alias("_off"))
    return means.groupBy(*by).agg(F.avg("_m").alias("mean"), F.median("_m").alias("median"), F.stddev_samp("_m").alias("sd"), F.count("_m").alias("units"), F.sum("_off").alias("excluded"))


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """One row per true label and a count column for each guessed label; other labels are ignored."""
    own = df.where(F.col(truth).isin(*labels) & F.col(guess).isin(*labels))
    return own.groupBy(truth).pivot(guess, labels).count().na.fill(0, labels)


def classification(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """accuracy, balanced accuracy and macro F1; a ratio with nothing below it is 0, and means run over all labels."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    count = lambda c: F.count_if(c).cast("double")
    aggs = []
    for k, lab in enumerate(labels):
        t, g = F.col(truth) == lab, F.col(guess) == lab
        aggs += [count(t & g).alias(f"tp{k}"), count(t).alias(f"t{k}"), count(g).alias(f"g{k}")]
    s = df.agg(F.count("*").alias("n"), count(F.col(truth) == F.col(guess)).alias("hits"), *aggs)
    recall = [ratio(F.col(f"tp{k}"), F.col(f"t{k}")) for k in range(len(labels))]
    f1 = [ratio(2 * F.col(f"tp{k}"), F.col(f"t{k}") + F.col(f"g{k}")) for k in range(len(labels))]
    mean = lambda xs: reduce(lambda a, b: a + b, xs) / len(labels)
    return s.select("n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), mean(recall).alias("balanced_accuracy"), mean(f1).alias("macro_f1"))


def probability_metrics(df: DataFrame, truth: Column, probabilities: dict[str, Column], floor: float = 1e-12) -> DataFrame:
    """Brier (summed over labels), clipped log-loss and the probability of the truth, means over rows."""
    brier = reduce(lambda a, b: a + b, [F.pow(p - F.when(truth == lab, 1.0).otherwise(0.0), 2) for lab, p in probabilities.items()])
    own = reduce(lambda a, b: F.coalesce(a, b), [F.when(truth == lab, p) for lab, p in probabilities.items()])
    own = F.coalesce(own, F.lit(0.0))
    loss = -F.log(F.least(F.greatest(own, F.lit(floor)), F.lit(1 - floor)))
    return df.agg(F.avg(brier).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(own).alias("true_probability"), F.count("*").alias("n"))


def midrank(order: Column, by: list[str] = ()) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(W.partitionBy(*by, order)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).withColumns({"_rx": midrank(F.col("_x")), "_ry": midrank(F.col("_y"))})
    return ranked.agg(F.corr("_x", "_y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.avg((F.signum("_x") == F.signum("_y")).cast("double")).alias("sign_agreement"))


def error_metrics(error: Column, scale: Column | None = None) -> list[Column]:
    out = [F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")]
    return out + [(F.sqrt(F.avg(error * error)) / scale).alias("scaled_rmse")] if scale is not None else out


def quantile_rank(values: Column, q: float, rule: str) -> Column:
    """Order statistic of a sorted array at round or truncate of (n - 1) q, or linear interpolation."""
    n = F.size(values)
    if rule == "round":
        return F.element_at(values, (F.bround((n - 1) * F.lit(q)) + 1).cast("int"))
    if rule == "truncate":
        return F.element_at(values, (F.floor((n - 1) * F.lit(q)) + 1).cast("int"))
    low = F.floor((n - 1) * F.lit(q)).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, n))
    return a + ((n - 1) * F.lit(q) - low) * (b - a)


def k_stability(df: DataFrame, unit: str, replicate: str, value: str) -> DataFrame:
    """Running mean over replicates against the mean over all: per number of replicates MAE, RMSE and the largest drift."""
    w = W.partitionBy(unit).orderBy(replicate).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = df.select(unit, F.row_number().over(W.partitionBy(unit).orderBy(replicate)).alias("k"), F.avg(value).over(w).alias("_run"), F.avg(value).over(W.partitionBy(unit)).alias("_all"))
    gap = F.col("_run") - F.col("_all")
    return run.groupBy("k").agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(F.abs(gap)).alias("max_drift"), F.count("*").alias("units"))


def leave_one_out_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Smallest and largest mean that leaving one row out gives, and whether all have the sign of the whole."""
    w = W.partitionBy(*by)
    n, s = F.count(value).over(w), F.sum(value).over(w)
    loo = df.select(*by, ((s - F.col(value)) / (n - 1)).alias("_loo"), (s / n).alias("_mean"))
    return loo.groupBy(*by).agg(F.min("_loo").alias("low"), F.max("_loo").alias("high"), F.min((F.signum("_loo") == F.signum("_mean")).cast("int")).cast("boolean").alias("sign_stable"))
