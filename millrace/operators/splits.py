"""Deduplication, splits, samples and schedules.  Every choice has a total order, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hex_mod


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def dedup_agreeing(df: DataFrame, keys: list[str], label: str, order: list[Column]) -> DataFrame:
    """First row per key; a key whose labels disagree fails where the query runs."""
    w = W.partitionBy(*keys)
    disagree = F.min(label).over(w) != F.max(label).over(w)
    checked = df.withColumn(label, F.when(disagree, F.raise_error(F.lit("labels of one key disagree")).cast(df.schema[label].dataType)).otherwise(F.col(label)))
    return first_per(checked, keys, order)


def ranked(df: DataFrame, order: list[Column], coarse: Column, descending: bool = False) -> DataFrame:
    """df with _rank (from 1) under a total order and _n, the number of rows, without sorting all rows in one task.

    `coarse` never falls (with `descending` never rises) along the order and has few values
    beside the rows: each value's rows are ranked by themselves, and one small table holds
    how many rows come before.
    """
    own = df.withColumn("_coarse", coarse)
    counts = own.groupBy("_coarse").agg(F.count("*").alias("_c"))
    before = W.orderBy(F.desc_nulls_last("_coarse") if descending else F.asc_nulls_first("_coarse")).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("_coarse").alias("_at"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(F.lit(1))).alias("_n"))
    rows = own.withColumn("_rank", F.row_number().over(W.partitionBy("_coarse").orderBy(*order)))
    return rows.join(offsets, F.col("_coarse").eqNullSafe(F.col("_at"))).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_coarse", "_at", "_before")


def chronological_split(df: DataFrame, key: str, sizes: dict[str, int]) -> DataFrame:
    """Splits by the rank of the key's distinct dates; what follows the last size is dropped."""
    keys = ranked(df.select(key).distinct(), [F.col(key)], F.year(key)).drop("_n")
    split, low = None, 0
    for name, n in sizes.items():
        test = (F.col("_rank") > low) & (F.col("_rank") <= low + n)
        split = F.when(test, name) if split is None else split.when(test, name)
        low += n
    return df.join(keys.withColumn("split", split).where("split is not null").drop("_rank"), key)


def hash_split(df: DataFrame, key: str, seed: int, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """train, eval and test by hash order of the key's distinct values: floor(share * n) each, the rest is test.

    All rows of a key fall together, and a rerun gives the same split.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    keys = df.select(key).distinct().withColumn("_h", order)
    placed = ranked(keys, [F.col("_h"), F.col(key)], F.substring("_h", 1, 3))
    a, b = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * shares[1])
    split = F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "eval").otherwise("test")
    return df.join(placed.select(key, split.alias("split")), key)


def hash_role(key: Column) -> Column:
    """sft_only, grpo_only or shared by the key's sha-256 modulo 100."""
    bucket = hex_mod(F.sha2(key, 256), 100)
    return F.when(bucket < 70, "sft_only").when(bucket < 90, "grpo_only").otherwise("shared")


def row_seed(text: Column) -> Column:
    """The first eight bytes of the sha-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def top_share(df: DataFrame, order: list[Column], share: float, coarse: Column, descending: bool = False, cap: int | None = None) -> DataFrame:
    """The first floor(share * n) rows, at most `cap`, under a total order, with `rank`; coarse: see ranked()."""
    most = F.floor(F.col("_n") * share)
    most = F.least(most, F.lit(cap)) if cap is not None else most
    return ranked(df, order, coarse, descending).where(F.col("_rank") <= most).withColumnRenamed("_rank", "rank").drop("_n")


def every_kth(df: DataFrame, order: list[Column], k: int, share: float, coarse: Column) -> DataFrame:
    """Every k-th row under the order, at most floor(share * n) of them; coarse: see ranked()."""
    at = F.col("_rank") - 1
    return ranked(df, order, coarse).where((at % k == 0) & (F.floor(at / k) < F.floor(F.col("_n") * share))).drop("_rank", "_n")


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def quantile_rows(df: DataFrame, by: list[str], order: list[Column], quantiles: list[float]) -> DataFrame:
    """The row of rank round(q (n - 1)) for each quantile, halves up."""
    w = W.partitionBy(*by)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.array(*(F.struct(F.lit(q).alias("quantile"), F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5).alias("at")) for q in quantiles))
    return ranked.withColumn("_q", F.explode(wanted)).where(F.col("_rn") == F.col("_q.at")).withColumn("quantile", F.col("_q.quantile")).drop("_rn", "_n", "_q")


def balanced_schedule(df: DataFrame, label: str, key: str, pattern: list[str], steps: int, seed: str) -> DataFrame:
    """Rows (position, step, label, key): the pattern repeated for `steps`, each class walked in salted hash cycles."""
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    ranked = df.withColumn("_pos", F.row_number().over(W.partitionBy(label).orderBy(order, key)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(label)))
    n, size = len(pattern) * steps, len(pattern)
    slots = df.sparkSession.range(n).select(F.col("id").alias("position"), F.floor(F.col("id") / size).cast("int").alias("step"), F.element_at(F.array(*map(F.lit, pattern)), (F.col("id") % size + 1).cast("int")).alias(label))
    slots = slots.withColumn("_use", F.row_number().over(W.partitionBy(label).orderBy("position")) - 1)
    counts = ranked.select(label, "_n").distinct()
    return slots.join(counts, label).withColumn("_pos", F.col("_use") % F.col("_n")).join(ranked.drop("_n"), [label, "_pos"]).select("position", "step", label, key)


def sample_observations(df: DataFrame, by: list[str], day: str, value: str, months: int, most: int) -> DataFrame:
    """Of the window of `months` up to a series' last day: the last observation of each month, the latest `most`."""
    w = W.partitionBy(*by)
    inside = df.withColumn("_end", F.max(day).over(w)).where(F.col(day) > F.add_months("_end", -months))
    monthly = inside.groupBy(*by, F.trunc(day, "MM").alias("_month")).agg(F.max_by(F.struct(day, value), day).alias("_o"))
    ranked = monthly.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_month"))))
    return ranked.where(F.col("_rn") <= most).select(*by, F.col(f"_o.{day}").alias(day), F.col(f"_o.{value}").alias(value))


def quota_midpoints(df: DataFrame, by: list[str], order: list[Column], quota: int) -> DataFrame:
    """Rows at ranks ((2 i + 1) n) div (2 quota) of each stratum, i below the quota, each once."""
    w = W.partitionBy(*by)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(quota - 1)), lambda i: F.floor((2 * i + 1) * F.col("_n") / (2 * quota)))
    return ranked.where(F.array_contains(at, F.col("_rn").cast("long"))).drop("_rn", "_n")


def greedy_projection(df: DataFrame, group: str, rank: str, cost: str, required: str, budget: int) -> DataFrame:
    """Per group: all rows if they fit the budget; else the required ones, then by rank each that still fits.

    A row that does not fit is skipped and later ones are still tried, which depends on
    what was taken before, so each group runs through a small Python loop.
    """
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)

    def choose(pdf):
        if pdf[cost].sum() <= budget:
            return pdf
        pdf = pdf.sort_values([required, rank], ascending=[False, True], kind="stable")
        left, keep = budget, []
        for must, price in zip(pdf[required], pdf[cost], strict=True):
            take = bool(must) or price <= left
            left -= price if take else 0
            keep.append(take)
        return pdf[keep]

    return df.groupBy(group).applyInPandas(choose, schema)


def expanding_training(df: DataFrame, end: str, start: str) -> DataFrame:
    """(target, n): for each target how many rows ended strictly before it starts.

    Rows are counted by day first, so the running sum goes over days and not over rows.
    """
    ends = df.groupBy(F.date_add(end, 1).alias("_at")).agg(F.count("*").alias("_ended")).where("_at is not null")
    starts = df.select(F.col(start).alias("_at"), F.lit(0).cast("long").alias("_ended"), F.col(start).alias("target")).where("target is not null").distinct()
    days = ends.withColumn("target", F.lit(None).cast(df.schema[start].dataType)).select("_at", "_ended", "target").unionByName(starts)
    w = W.orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    return days.withColumn("n_train", F.sum("_ended").over(w)).where("target is not null").select("target", "n_train")


def balanced_selection(df: DataFrame, group: str, topic: str, salt: str) -> DataFrame:
    """(group, topic): each group in order takes, of its topics, the one taken least so far; ties by the salted hash of group and topic.

    What a group takes depends on all groups before it, so the distinct pairs, and nothing
    else, go through one sequential loop.
    """
    kinds = dict(df.dtypes)
    pairs = df.select(group, topic).where(F.col(topic).isNotNull()).distinct().withColumn("_h", F.sha2(F.concat_ws("|", F.lit(salt), F.col(group).cast("string"), F.col(topic).cast("string")), 256))

    def choose(batches):
        held = [b for b in batches if len(b)]
        used: dict = {}
        if held:
            import pandas as pd

            rows = pd.concat(held).sort_values([group, "_h"])
            out = []
            for g, own in rows.groupby(group, sort=True):
                best = min(zip(own[topic], own["_h"], strict=True), key=lambda x: (used.get(x[0], 0), x[1]))[0]
                used[best] = used.get(best, 0) + 1
                out.append((g, best))
            yield pd.DataFrame(out, columns=[group, topic])

    return pairs.coalesce(1).mapInPandas(choose, f"{group} {kinds[group]}, {topic} {kinds[topic]}")
