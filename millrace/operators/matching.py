"""Joins and matching: validated joins, waterfalls, as-of and range joins, pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key under a total order (what a dictionary built in that order holds)."""
    backwards = [c.desc() for c in order]
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*backwards))).where("_rn = 1").drop("_rn")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that fails, where it runs, on a key that repeats on either side."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(W.partitionBy(*keys))
        fail = F.when(n > 1, F.raise_error(F.lit(f"{side} keys are not unique")).cast("int")).otherwise(F.lit(1))
        return df.withColumn("_unique", fail).where("_unique = 1").drop("_unique")

    return checked(left, "left").join(checked(right, "right"), keys, how)


def key_audit(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """One row: keys of one side only, and pairs whose compared columns differ."""
    a = left.select(*keys, F.struct(*compare).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.struct(*compare).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("_in_b").isNull()).alias("left_only"), F.count_if(F.col("_in_a").isNull()).alias("right_only"), F.count_if(F.col("_in_a") & F.col("_in_b") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatched"))


def waterfall(df: DataFrame, key: str, value: str, sources: list[DataFrame]) -> DataFrame:
    """Fills blank values from the first source that holds the key; `origin` is the source's number, null if none."""
    out = df.withColumn("origin", F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.lit(0)))
    for k, source in enumerate(sources, 1):
        other = source.select(F.col(key), F.col(value).alias("_filled"))
        take = F.col("origin").isNull() & F.col("_filled").isNotNull() & (F.trim("_filled") != "")
        out = out.join(other, key, "left").withColumn(value, F.when(take, F.col("_filled")).otherwise(F.col(value))).withColumn("origin", F.when(take, F.lit(k)).otherwise(F.col("origin"))).drop("_filled")
    return out


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the latest right row on or before (strict: before) its date.

    One sort of both sides together by key and date: no pairs of rows are made, so a key
    with many rows on either side costs its rows and not their product.
    """
    right_rows = right.select(*by, F.col(right_on).alias("_at"), F.struct(F.col(right_on).alias("_when"), *values).alias("_value"), F.lit(None).alias("_left"))
    left_rows = left.select(*by, F.col(left_on).alias("_at"), F.lit(None).cast(right_rows.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_left"))
    both = right_rows.withColumn("_left", F.lit(None).cast(left_rows.schema["_left"].dataType)).unionByName(left_rows)
    rank = F.when(F.col("_left").isNull(), F.lit(1 if strict else 0)).otherwise(F.lit(0 if strict else 1))
    window = W.partitionBy(*by).orderBy("_at", rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_value", F.last("_value", ignorenulls=True).over(window)).where("_left is not null")
    return out.select("_left.*", F.col("_value._when").alias(f"{right_on}_as_of"), *(F.col(f"_value.{v}").alias(v) for v in values))


def rank_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The k-th left row of a key with the key's k-th right row: each right row is used at most once."""
    a = left.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "_k"], "left").drop("_k")


def neighbours(df: DataFrame, by: list[str], order: str, value: str, back: int = 2, ahead: int = 1) -> DataFrame:
    """previous_k and next_k of the non-null observations around each observation."""
    window = W.partitionBy(*by).orderBy(order)
    out = df.where(F.col(value).isNotNull())
    for k in range(1, back + 1):
        out = out.withColumn(f"previous_{k}", F.lag(value, k).over(window))
    for k in range(1, ahead + 1):
        out = out.withColumn(f"next_{k}", F.lead(value, k).over(window))
    return out


def distinct_text(df: DataFrame, key: str, text: str, separator: str = " || ") -> DataFrame:
    """One row per key; several distinct texts are joined in order."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(text)), separator).alias(text), F.countDistinct(text).alias("variants"))
