"""Resampling, tests and regressions.

Means, ranks and counts are DataFrame work.  Draws come from numpy generators with fixed
seeds in one task for each group, so that a plan is the same on every machine; a group is
the clusters of one comparison, not the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holm(df: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """Holm-adjusted `p_adjusted`: running maximum of (m - rank) p, at most 1; null p stays null and does not count."""
    w = W.partitionBy(*family)
    ranked = df.withColumn("_m", F.count(p).over(w)).withColumn("_k", F.when(F.col(p).isNotNull(), F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *order)) - 1))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_k")) * F.col(p))
    running = F.max(step).over(w.orderBy(F.col("_k").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), running)).drop("_m", "_k")


def bootstrap_p(draws: Column) -> Column:
    """Two-sided: min(1, 2 (min(#<=0, #>=0) + 1) / (B + 1)), over an array of draws."""
    low, high = F.size(F.filter(draws, lambda x: x <= 0)), F.size(F.filter(draws, lambda x: x >= 0))
    return F.least(F.lit(1.0), 2 * (F.least(low, high) + 1) / (F.size(draws) + 1))


def null_centred_p(draws: Column, estimate: Column) -> Column:
    return (1 + F.size(F.filter(draws, lambda x: F.abs(x - estimate) >= F.abs(estimate)))) / (F.size(draws) + 1)


def _sums_of_flips(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sums, ascending; masks of each) over all sign masks; values of one size share their binomial counts."""
    sums, masks = np.zeros(1), np.ones(1)
    for size, n in zip(*np.unique(np.abs(values), return_counts=True), strict=True):
        steps = np.arange(n + 1) if size else np.zeros(1, np.int64)
        ways = np.array([float(math.comb(int(n), int(k))) for k in steps]) if size else np.array([2.0**n])
        sums, inv = np.unique((sums[:, None] + size * (n - 2 * steps if size else steps)).ravel(), return_inverse=True)
        masks = np.bincount(inv, (masks[:, None] * ways).ravel())
    return sums, masks


def flip_share(values: list[float], slack: float = 1e-12) -> float:
    """The share of all sign masks whose absolute sum is at least that of the values.

    The masks of two halves meet in sorted sums: 2**(n / 2) sums are held and never the 2**n
    masks; sizes that repeat make it fewer.  Some 44 different sizes still fit a worker.
    """
    v = np.array(values, float)
    total = abs(float(v.sum()))
    if not math.isfinite(total):
        # NaN is the largest number, as in SQL: only infinite sums are smaller, and only than NaN.
        return 1.0 if math.isinf(total) or np.isnan(v).any() else 1.0 - 2.0 ** (1 - int(np.isinf(v).sum()))
    # The masks add up in another order, so sums may differ by their rounding.
    bound = total - slack - 2 * len(v) * np.finfo(float).eps * np.abs(v).sum()
    sizes, n = np.unique(np.abs(v), return_counts=True)
    # Sizes go whole to the half that has fewer sums so far: their repeats then count and are not told apart.
    halves, room = ([], []), [1.0, 1.0]
    for size, k in sorted(zip(sizes.tolist(), n.tolist(), strict=True), key=lambda x: -x[1]):
        at = int(room[0] > room[1])
        halves[at].extend([size] * k)
        room[at] *= k + 1 if size else 1
    (a, in_a), (b, in_b) = (_sums_of_flips(np.array(h)) for h in halves)
    before = np.concatenate([[0.0], np.cumsum(in_b)])
    high, low = before[-1] - before[np.searchsorted(b, bound - a, "left")], before[np.searchsorted(b, -bound - a, "right")]
    as_large = np.where(bound > 0, high + low, before[-1])
    return float((in_a * as_large).sum() / 2.0 ** len(v))


def exact_sign_flip(df: DataFrame, group: str, value: str) -> DataFrame:
    """p over all 2**n sign masks of a group's values (n at most 62, and sizes so few that flip_share holds them): the share whose sum is at least as large, and their number."""
    values = df.groupBy(group).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))

    @F.pandas_udf("double")
    def share(column: pd.Series) -> pd.Series:
        return column.map(flip_share).astype(float)

    return values.select(group, share("_v").alias("p"), F.pow(F.lit(2), F.size("_v")).cast("long").alias("masks"))


def sign_flip(df: DataFrame, group: str, key: str, value: str, exact_upto: int = 13, draws: int = 100_000) -> DataFrame:
    """p and the masks used per group: all sign masks up to `exact_upto` values, beyond that `draws` fixed ones, counted plus one.

    A draw's sign of a row is a bit of md5(draw:key), so a draw is the same wherever a row
    lies and sums are combined before they move.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"), F.abs(F.sum(value)).alias("_t"))
    few, many = sizes.where(F.col("_n") <= exact_upto), sizes.where(F.col("_n") > exact_upto)
    exact = exact_sign_flip(df.join(few, group, "left_semi"), group, value)
    bit = F.substring(F.md5(F.concat_ws(":", F.col("_draw").cast("string"), F.col(key).cast("string"))), 1, 1) < "8"
    drawn = df.join(many, group).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    sums = drawn.groupBy(group, "_draw").agg(F.abs(F.sum(F.when(bit, F.col(value)).otherwise(-F.col(value)))).alias("_x"), F.first("_t").alias("_t"))
    counted = sums.groupBy(group).agg(((F.count_if(F.col("_x") >= F.col("_t") - 1e-9) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("masks"))
    return exact.unionByName(counted)


def label_swap(df: DataFrame, group: str, unit: str, a: Column, b: Column, weight: Column | None = None) -> DataFrame:
    """Exact p per group over all swaps of two models' labels within units (at most 62): the share whose weighted difference is as large."""
    own = df.select(group, unit, ((a - b) * (F.lit(1.0) if weight is None else weight)).alias("_w"))
    return exact_sign_flip(own.groupBy(group, unit).agg(F.sum("_w").alias("_w")), group, "_w")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out / a


def t_p_value(t: float, df: float) -> float:
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def one_sample_t(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, t and p per group.  No spread: mean 0 gives t 0 and p 1, any other mean a null t and p 0."""
    s = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))

    @F.pandas_udf(T.DoubleType())
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else t_p_value(x, k - 1) for x, k in zip(t, n, strict=True)])

    flat = F.col("sd") == 0
    s = s.withColumn("t", F.when(flat & (F.col("mean") == 0), 0.0).when(~flat, F.col("mean") / (F.col("sd") / F.sqrt("n"))))
    return s.withColumn("p", F.when(flat & (F.col("mean") == 0), 1.0).when(flat, 0.0).otherwise(p("t", "n")))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(moments: pd.Series) -> pd.Series:
    """Of X'X (row by row), X'y and n: the coefficients and the inverse; null where X has no full rank."""

    def solve(m):
        k = int(round(math.sqrt(len(m) - 0.75) - 0.5))
        xx, xy = np.array(m[: k * k]).reshape(k, k), np.array(m[k * k : k * k + k])
        scale = np.sqrt(np.diag(xx))
        if m[-1] <= k or (scale == 0).any() or np.linalg.matrix_rank(xx / np.outer(scale, scale)) < k:
            return None
        inv = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
        return [*(inv @ xy), *inv.reshape(-1)]

    return moments.map(lambda m: None if m is None or any(x is None for x in m) else solve(m))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _errors(solved: pd.Series, meat: pd.Series, n: pd.Series) -> pd.Series:
    def errors(s, m, rows):
        k = int(round(math.sqrt(len(m))))
        inv = np.array(s[k:]).reshape(k, k)
        return np.sqrt(np.diag(inv @ np.array(m).reshape(k, k) @ inv * rows / (rows - k))).tolist()

    return pd.Series([None if s is None else errors(s, m, r) for s, m, r in zip(solved, meat, n, strict=True)])


def ols(df: DataFrame, by: str, y: str, xs: list[str], order: str, lags: int | None = None) -> DataFrame:
    """Coefficients and standard errors per group: HC1, or Newey-West with Bartlett weights where lags are given.

    Products are summed where the rows are; only lags need a group's order, by a window.
    Python sees one row of k * k sums for each group.
    """
    terms = ["const", *xs]
    k = len(terms)
    rows = df.select(by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs, 1))).withColumn("_x0", F.lit(1.0))
    x = [F.col(f"_x{i}") for i in range(k)]
    moments = F.array(*(F.sum(a * b) for a in x for b in x), *(F.sum(a * F.col("_y")) for a in x), F.count("*").cast("double"))
    solved = rows.groupBy(by).agg(moments.alias("m"), F.count("*").alias("_n")).select(F.col(by).alias("_by"), _solved("m").alias("_s"), "_n")
    met = rows.join(solved, F.col(by).eqNullSafe(F.col("_by")))
    residual = F.col("_y") - sum((F.col("_s")[i] * x[i] for i in range(1, k)), F.col("_s")[0])
    scored = met.select("_by", "_s", "_n", "_o", *((x[i] * residual).alias(f"_u{i}") for i in range(k)))
    w = W.partitionBy("_by").orderBy("_o")
    for lag in range(1, (lags or 0) + 1):
        scored = scored.withColumns({f"_l{lag}_{i}": F.lag(f"_u{i}", lag).over(w) for i in range(k)})

    def product(i, j):
        out = F.col(f"_u{i}") * F.col(f"_u{j}")
        for lag in range(1, (lags or 0) + 1):
            both = F.col(f"_u{i}") * F.col(f"_l{lag}_{j}") + F.col(f"_u{j}") * F.col(f"_l{lag}_{i}")
            out = out + (1 - lag / (lags + 1)) * F.coalesce(both, F.lit(0.0))
        return F.sum(out)

    meat = scored.groupBy("_by").agg(F.array(*(product(i, j) for i in range(k) for j in range(k))).alias("_m"), F.first("_s").alias("_s"), F.first("_n").alias("_n"))
    found = meat.select(F.col("_by").alias(by), "_s", _errors("_s", "_m", "_n").alias("_e"))
    at = F.posexplode(F.array(*map(F.lit, terms))).alias("_k", "term")
    return found.select(by, "_s", "_e", at).select(by, "term", F.col("_s")[F.col("_k")].alias("beta"), F.col("_e")[F.col("_k")].alias("se"))


def beta_bootstrap(rows: DataFrame, arm: str, y: str, xs: list[str], block: str, drawn: DataFrame) -> DataFrame:
    """(draw, arm, n, betas, status): the regression of every arm on the blocks of every draw of a plan that all arms share.

    Sums of products are taken per block once and only weighted by a draw, so a draw costs
    blocks and not rows.  Where rows have a column `draw` (scores drawn anew), sums are taken for
    each.  betas are of the constant and xs in order; a draw without full rank is rejected.
    """
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    k, keys = len(x), ["draw"] if "draw" in rows.columns else []
    products = [*(a * b for a in x for b in x), *(a * F.col(y).cast("double") for a in x), F.lit(1.0)]
    sums = rows.groupBy(*keys, F.col(arm).alias("arm"), F.col(block).alias("unit")).agg(*(F.sum(p).alias(f"m{i}") for i, p in enumerate(products)))
    met = drawn.select("draw", "unit", "times").join(sums, ["unit", *keys])
    weighted = met.groupBy("draw", "arm").agg(F.array(*(F.sum(F.col(f"m{i}") * F.col("times")) for i in range(len(products)))).alias("m"))
    solved = weighted.select("draw", "arm", F.element_at("m", -1).cast("long").alias("n"), _solved("m").alias("s"))
    return solved.select("draw", "arm", "n", F.slice("s", 1, k).alias("betas"), F.when(F.col("s").isNull(), "rank deficient").otherwise("ok").alias("status"))


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided binomial p of the discordant counts; terms are relative to the largest, so that no count underflows."""
    n, k = a_only + b_only, F.least(a_only, b_only)
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))
    log_top = F.aggregate(steps, F.lit(0.0), lambda s, i: F.when(i <= k, s + F.log((n - k + i) / i)).otherwise(s)) - n * F.log(F.lit(2.0))
    # C(n, k - i) / C(n, k - i + 1), from the largest term down.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    lower = lambda s, i: s["term"] * (k - i + 1) / (n - k + i)
    tail = F.aggregate(steps, start, lambda s, i: F.when(i <= k, F.struct(lower(s, i).alias("term"), (s["sum"] + lower(s, i)).alias("sum"))).otherwise(s), lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail * F.exp(log_top)))


def argmax_label(labels: list[str], probabilities: Column, slack: float = 1e-12) -> Column:
    """The label of the largest probability, null where it is shared."""
    top = F.array_max(probabilities)
    ties = F.size(F.filter(probabilities, lambda p: p >= top - slack))
    return F.when(ties == 1, F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, top).cast("int")))


def move_probabilities(bp: Column) -> Column:
    """Mass of a move, winsorised at 100, split between the two neighbouring 25 bp nodes: struct (low, p_low, high, p_high)."""
    move = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), bp))
    low = F.floor(move / 25) * 25
    high = F.least(low + 25, F.lit(100))
    share = (move - low) / 25.0
    return F.struct(low.cast("int").alias("low"), (1 - share).alias("p_low"), high.cast("int").alias("high"), share.alias("p_high"))
