"""Bootstrap plans as tables: who is drawn where is data, so every metric and model shares the draws.

A plan numbers the units of each stratum and draws as many as there are, with replacement:
position p of draw k takes the unit numbered md5(seed:k:stratum:p) modulo the number of
units.  A draw is the same on every machine and in every run, and a metric is one
equi-join with the plan and one grouped sum, combined before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions of a draw that one row stands for until it is dealt to a task; bits of a key below its block.
POSITIONS, BLOCK_BITS = 8192, 12


def drawn_number(seed: str, draw: Column, stratum: Column, position: Column, n: Column) -> Column:
    bits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), draw.cast("string"), stratum.cast("string"), position.cast("string"))), 1, 12)
    return F.pmod(F.conv(bits, 16, 10).cast("long"), n)


def _numbered(units: DataFrame, unit: str, stratum: str | None) -> tuple[DataFrame, DataFrame]:
    """(at, unit, stratum), the distinct units in order within their stratum, numbered from 0 over all strata; (stratum, first, n): where a stratum's begin, and how many.

    Whole-numbered units are counted in blocks of keys first, so a stratum is not sorted in
    one task.  Tables of units merge: the size of a few columns is estimated far too low,
    and a broadcast would bring them to the driver.
    """
    own = units.select(F.col(unit).alias("unit"), (F.col(stratum).cast("string") if stratum else F.lit("all")).alias("stratum")).where("stratum is not null").distinct()
    whole = isinstance(own.schema["unit"].dataType, T.IntegralType)
    own = own.withColumn("block", F.coalesce(F.shiftright(F.col("unit").cast("long"), BLOCK_BITS), F.lit(2**63 - 1)) if whole else F.lit(0).cast("long"))
    blocks = own.groupBy("stratum", "block").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("stratum").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    strata = blocks.groupBy("stratum").agg(F.sum("rows").alias("n"))
    first = F.coalesce(F.sum("n").over(W.orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    strata = strata.select("stratum", first.alias("first"), "n")
    blocks = blocks.select("stratum", "block", before.alias("before")).hint("merge").join(strata, "stratum")
    place = F.row_number().over(W.partitionBy("stratum", "block").orderBy(F.col("unit").asc_nulls_last())) - 1
    numbered = own.withColumn("place", place).hint("merge").join(blocks, ["stratum", "block"])
    return numbered.select((F.col("first") + F.col("before") + F.col("place")).alias("at"), "unit", "stratum"), strata


def _taken(strata: DataFrame, draws: int, seed: str) -> DataFrame:
    """(at, draw, times) of the units that a draw takes.

    Positions are dealt in chunks over all tasks, and their numbers move once, to where the units of these numbers are joined.
    """
    width = max(1, int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = strata.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(POSITIONS)))))
    low = F.col("chunk") * POSITIONS
    places = chunks.repartition(width, "stratum", "draw", "chunk").withColumn("position", F.explode(F.sequence(low, F.least(F.col("n"), low + POSITIONS) - 1)))
    number = drawn_number(seed, F.col("draw"), F.col("stratum"), F.col("position"), F.col("n"))
    return places.select("draw", (F.col("first") + number).alias("at")).repartition(width, "at").groupBy("at", "draw").agg(F.count("*").alias("times"))


def plan(units: DataFrame, unit: str, stratum: str | None, draws: int, seed: str = "s") -> DataFrame:
    """(draw, stratum, unit, times): how often a draw takes each unit; units are distinct keys, numbered within their stratum."""
    numbered, strata = _numbered(units, unit, stratum)
    return _taken(strata, draws, seed).hint("merge").join(numbered, "at").select("draw", "stratum", "unit", "times")


def stratified_means(values: DataFrame, unit: str, stratum: str, draws: int, metrics: dict[str, Column], seed: str = "s") -> DataFrame:
    """(draw, stratum, metrics): drawn_means by stratum under plan(values, unit, stratum, draws, seed), for many units.

    Their sums are joined before they are drawn, so the plan does not move again.
    """
    numbered, strata = _numbered(values, unit, stratum)
    own = numbered.hint("merge").join(_sums(values, unit, metrics, None), "unit").drop("unit")
    return _means(_taken(strata, draws, seed).hint("merge").join(own, "at"), metrics, ["stratum"])


def unit_means(units: DataFrame, unit: str, stratum: str, draws: int, metrics: dict[str, Column], seed: str = "s") -> DataFrame:
    """As stratified_means, of metrics that are functions of the key `unit` alone; a key counts once."""
    numbered, strata = _numbered(units, unit, stratum)
    own = numbered.select("at", "stratum", *(m.alias(k) for k, m in metrics.items()), F.lit(1).alias("rows"))
    return _means(_taken(strata, draws, seed).hint("merge").join(own, "at"), metrics, ["stratum"])


def _sums(values: DataFrame, unit: str, metrics: dict[str, Column], by: list[str] | None) -> DataFrame:
    rows = values.select(F.col(unit).alias("unit"), *(by or []), *(m.alias(k) for k, m in metrics.items()))
    return rows.groupBy("unit", *(by or [])).agg(*(F.sum(k).alias(k) for k in metrics), F.count("*").alias("rows"))


def _means(met: DataFrame, metrics: dict[str, Column], by: list[str] | None) -> DataFrame:
    return met.groupBy("draw", *(by or [])).agg(*((F.sum(F.col(k) * F.col("times")) / F.sum(F.col("rows") * F.col("times"))).alias(k) for k in metrics))


def drawn_means(values: DataFrame, unit: str, drawn: DataFrame, metrics: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row per draw (and `by`): the mean of each metric over the drawn units' rows."""
    return _means(drawn.join(_sums(values, unit, metrics, by), "unit"), metrics, by)


def interval(draws: DataFrame, metric: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Percentile interval (linear between order statistics) and number of draws."""
    cut = (1 - level) / 2
    return draws.groupBy(*(by or [])).agg(F.percentile(metric, cut).alias("low"), F.percentile(metric, 1 - cut).alias("high"), F.count(metric).alias("draws"))
