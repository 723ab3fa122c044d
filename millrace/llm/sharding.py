"""Weighted rendezvous sharding.

A record's key and each shard's number are hashed together to a uniform u in (0, 1);
the record goes to the shard of greatest -weight / ln(u).  The scores of the other
shards do not change when one is added, so a record moves only into the new one.

Keys that are null are all keyed as one fixed word.  Null texts have no bytes.  Repeated
rows go to one shard and get slots of their own.  Slots number the rows of a shard
without gaps; they follow the order of the settled rows and need no task that holds a
whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .common import settle


def uniform(key: Column, shard: int) -> Column:
    """A 52-bit uniform in (0, 1) of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(f"shard {shard}")), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def pick(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that holds key; shards of weight 0 hold nothing."""
    scores = [F.struct((F.lit(-float(w)) / F.log(uniform(key, k))).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight above 0")
    return F.array_max(F.array(*scores))["shard"]


def shard_rows(documents: DataFrame, weights: list[float], grown: list[float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (under the weights `grown`)."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.col(id_column)
    rows = documents.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        pick(key, weights).cast("int").alias("shard"),
        pick(key, grown).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = settle(rows, "rows")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # One row for each shard and input partition, so a shard's running total stays small.
    before = counts.select("shard", "part", (F.sum("n").over(Win.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Win.partitionBy("shard", "part").orderBy("row")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), "grown_shard")
