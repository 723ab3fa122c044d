"""Decision baselines: published hazard and mark models, an ordered probit fitted by sums, a cumulative forest."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of a rational approximation of the normal distribution in double precision, highest power first.
_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# Published weekly duration model (0, 1) and ordered probit of target changes.
DURATION = 0.067460919
CONSTANT = 30.390652
MEETING_WEEK = -23.045727
ABSOLUTE_SPREAD = -8.2087573
PASTE_DELTA = 0.1
PASTE_EPSILON = 0.0001
MARK_PREVIOUS = 2.5449149
MARK_SPREAD = 0.54142729
MARK_THRESHOLDS = (-1.8948826, -0.42001991, -0.005251548, 1.5173916)
MARKS = (-50, -25, 0, 25, 50)


def normal_cdf(c: Column) -> Column:
    """Standard normal distribution, in arithmetic that stays in generated code; errors are below 1e-14."""
    x = F.abs(c)

    def polynomial(coefficients):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    fraction = x + 0.65
    for k in (4, 3, 2, 1):
        fraction = x + k / fraction
    tail = F.exp(-x * x / 2) * F.when(x < 7.07106781186547, polynomial(_ABOVE) / polynomial(_BELOW)).otherwise(1 / fraction / math.sqrt(2 * math.pi))
    return F.when(c > 0, 1 - tail).otherwise(tail)


def change_hazard(weeks: Column, spread: Column, meeting: Column) -> Column:
    """Probability of a change in a week, by its smooth pasted link; null where the duration is not positive."""
    index = CONSTANT + DURATION * weeks + MEETING_WEEK * meeting.cast("double") + ABSOLUTE_SPREAD * F.abs(spread)
    over = index - 1
    smooth = 1 + PASTE_EPSILON + 2 * PASTE_DELTA * over * over / (PASTE_DELTA**2 + over * over)
    below = F.when(index <= 1, F.lit(1 + PASTE_EPSILON)).when(index <= 1 + PASTE_DELTA, smooth).otherwise(index + PASTE_EPSILON)
    return F.when(weeks > 0, 1 / below)


def action_probabilities(hazard: Column, previous: Column, spread: Column) -> Column:
    """Probabilities of MARKS: marks given a change, times the hazard; no change adds to the mark 0."""
    eta = MARK_PREVIOUS * previous + MARK_SPREAD * spread
    cumulative = [F.lit(0.0), *(normal_cdf(t - eta) for t in MARK_THRESHOLDS), F.lit(1.0)]
    marks = [F.greatest(b - a, F.lit(0.0)) for a, b in zip(cumulative, cumulative[1:])]
    return F.array(*(hazard * p + (1 - hazard if mark == 0 else 0.0) for mark, p in zip(MARKS, marks, strict=True)))


def _probit_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and expected information (row by row) of a block of rows."""
    n, classes = len(y), len(cuts) + 1
    at = np.clip(np.column_stack([np.full(n, -40.0), cuts - (x @ beta)[:, None], np.full(n, 40.0)]), -40, 40)
    size = np.abs(at)
    fraction = size + 0.65
    for k in (4, 3, 2, 1):
        fraction = size + k / fraction
    tail = np.exp(-size * size / 2) * np.where(size < 7.07106781186547, np.polyval(_ABOVE, size) / np.polyval(_BELOW, size), 1 / fraction / math.sqrt(2 * math.pi))
    density = np.exp(-size * size / 2) / math.sqrt(2 * math.pi)
    # Between two cuts above 0 the upper tails are subtracted, which keeps small differences.
    level = np.where(at > 0, 1 - tail, tail)
    p = np.where(at[:, :-1] > 0, tail[:, :-1] - tail[:, 1:], level[:, 1:] - level[:, :-1]).clip(1e-300)
    # by[row, class, parameter]
    by = np.zeros((n, classes, x.shape[1] + len(cuts)))
    by[:, :, : x.shape[1]] = -(density[:, 1:] - density[:, :-1])[:, :, None] * x[:, None, :]
    for j in range(len(cuts)):
        by[:, j, x.shape[1] + j] += density[:, j + 1]
        by[:, j + 1, x.shape[1] + j] -= density[:, j + 1]
    own = np.arange(n)
    gradient = (by[own, y] / p[own, y][:, None]).sum(0)
    information = np.einsum("nca,ncb->ab", by / p[:, :, None], by)
    return np.concatenate([[np.log(p[own, y]).sum()], gradient, information.reshape(-1)])


def fit_ordered_probit(df: DataFrame, label: str, classes: list, features: list[str], rounds: int = 60, tolerance: float = 1e-8) -> tuple[list[float], list[float]]:
    """Coefficients and cuts of largest likelihood, by Fisher scoring with halved steps.

    A round sends (features + cuts)^2 sums of each Arrow batch, so rows never leave their tasks.
    Rows with a null or non-finite feature or a label that is no class are an error, as is a class
    without rows, a feature that does not vary, or a fit that does not settle.
    """
    k, size = len(features), len(features) + len(classes) - 1
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label))
    bad = F.coalesce(place, F.lit(0)) == 0
    for x in features:
        bad = bad | F.coalesce(F.abs(F.col(x).cast("double")) == float("inf"), F.lit(True)) | F.isnan(F.col(x).cast("double"))
    rows = df.select((place - 1).cast("int").alias("_y"), bad.alias("_bad"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(features))).persist()
    try:
        moments = [F.array(*(f(f"_x{i}") for i in range(k))) for f in (F.avg, F.stddev_pop)]
        n, wrong, counts, mean, scale = rows.agg(F.count("*"), F.count_if("_bad"), F.array(*(F.count_if(F.col("_y") == j) for j in range(len(classes)))), *moments).first()
        if wrong or not all(counts):
            raise ValueError("rows without a class or a finite feature, or a class without rows")
        mean, scale = np.array(mean), np.array(scale)
        if (scale == 0).any():
            raise ValueError("a feature that does not vary is no feature beside the cuts")

        def summed(beta, cuts):
            def part(batches):
                for batch in batches:
                    x = (batch[[f"_x{i}" for i in range(k)]].to_numpy() - mean) / scale
                    sums = _probit_sums(x, batch["_y"].to_numpy(), beta, cuts)
                    yield pd.DataFrame([sums], columns=[f"s{i}" for i in range(len(sums))])

            names = [f"s{i}" for i in range(1 + size + size * size)]
            partial = rows.drop("_bad").mapInPandas(part, ", ".join(f"{c} double" for c in names))
            return np.array(partial.agg(*(F.sum(c) for c in names)).first(), dtype=float)

        at, step, best = np.array([0.0] * k + [NormalDist().inv_cdf(share) for share in np.cumsum(counts)[:-1] / n]), None, -math.inf
        for _ in range(rounds):
            sums = summed(at[:k], at[k:]) if (np.diff(at[k:]) > 0).all() else np.array([-math.inf])
            if step is not None and sums[0] < best - 1e-9 * abs(best):
                at, step = at - step / 2, step / 2
                continue
            best, step = sums[0], np.linalg.solve(sums[1 + size :].reshape(size, size), sums[1 : 1 + size])
            at = at + step
            if np.abs(step).max() < tolerance:
                beta = at[:k] / scale
                return beta.tolist(), (at[k:] + beta @ mean).tolist()
        raise ValueError("the ordered probit did not settle")
    finally:
        rows.unpersist()


def ordered_probit_probabilities(features: list[str], beta: list[float], cuts: list[float]) -> Column:
    index = sum((b * F.col(x) for b, x in zip(beta, features, strict=True)), F.lit(0.0))
    level = [F.lit(0.0), *(normal_cdf(c - index) for c in cuts), F.lit(1.0)]
    return F.array(*(F.greatest(b - a, F.lit(0.0)) for a, b in zip(level, level[1:])))


def projected_classes(over_first: Column, over_second: Column) -> Column:
    """Three class probabilities of two cumulative ones; where they cross, both become their mean."""
    mean = (over_first + over_second) / 2
    first, second = F.when(over_first >= over_second, over_first).otherwise(mean), F.when(over_first >= over_second, over_second).otherwise(mean)
    return F.array(1 - first, first - second, second)


def cumulative_forest(train: DataFrame, test: DataFrame, label: str, classes: list, features: list[str], trees: int = 500, least_leaf: int = 5, seed: int = 20_260_827, depth: int = 10) -> DataFrame:
    """test with `p`: two balanced forests for "over the first class" and "over the second", projected to be in order.

    Classes weigh the same in the whole of train, where a balanced subsample would weigh them in each tree's draw.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gather = VectorAssembler(inputCols=features, outputCol="_features")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
    rows, out = gather.transform(train.withColumn("_place", place)).persist(), gather.transform(test)
    try:
        for k in range(2):
            own = rows.withColumn("_over", (F.col("_place") > k).cast("double"))
            n, over = own.agg(F.count("*"), F.sum("_over")).first()
            if not 0 < over < n:
                raise ValueError("a cumulative label with one value only")
            own = own.withColumn("_weight", F.when(F.col("_over") == 1, n / (2 * over)).otherwise(n / (2 * (n - over))))
            forest = RandomForestClassifier(labelCol="_over", featuresCol="_features", weightCol="_weight", numTrees=trees, minInstancesPerNode=least_leaf, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + k)
            forest = forest.setProbabilityCol(f"_q{k}").setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_class{k}")
            out = forest.fit(own).transform(out)
    finally:
        rows.unpersist()
    return out.withColumn("p", projected_classes(vector_to_array("_q0")[1], vector_to_array("_q1")[1])).select(*test.columns, "p")
