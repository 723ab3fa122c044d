"""Queries of sources that need no files of their own, request planning and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from ..sources import files


def s10(spark, d):
    dates = table(spark, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("vintage")).distinct()
    w = W.partitionBy("o_orderpriority").orderBy("vintage")
    chunked = dates.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / 12).cast("int"))
    return chunked.groupBy("o_orderpriority", "chunk").agg(F.count("*").alias("n"), F.min("vintage").alias("first"), F.max("vintage").alias("last"))


def s12(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("observation_date"), F.col("o_totalprice").alias("GDP_20200101"), (F.col("o_totalprice") + 1).alias("GDP_20200201"))
    return files.vintages_long(o, "observation_date", "GDP")


def s14(spark, d):
    for name in ("orders", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(f"millrace_{name}")
    return spark.sql("""
        WITH keys AS (SELECT o_custkey, max(o_orderdate) AS last FROM millrace_orders o LEFT SEMI JOIN millrace_lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o_custkey)
        SELECT o_custkey, count(*) AS n, count_if(o.o_orderdate <=> k.last) AS latest, count(*) FILTER (WHERE o.o_orderstatus IS DISTINCT FROM 'F') AS open
        FROM millrace_orders o JOIN keys k USING (o_custkey) GROUP BY o_custkey""")


def s15(spark, d):
    """Chunks of two years from the first: the chunk is a column, so one scan serves all."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    first = o.agg(F.min("year").alias("first"))
    chunk = F.col("first") + F.floor((F.col("year") - F.col("first")) / 2) * 2
    return o.join(F.broadcast(first)).select("o_orderkey", chunk.cast("int").alias("chunk")).distinct()


def s21(spark, d):
    own = files.checked(table(spark, d, "nation"), [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")])
    return own.groupBy("n_regionkey").agg(F.count("*").alias("n"))


def windows(spark, d):
    """Tumbling event-time windows; the same plan runs on a stream (millrace.streaming)."""
    from ..streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 day").select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"s10_request_chunks": s10, "s12_wide_to_long": s12, "s14_warehouse_extract": s14, "s15_date_chunks": s15, "s21_parquet_scan": s21, "stream_tumbling_windows": windows}

ORACLE_SQL = {
    "s10_request_chunks": "SELECT o_orderpriority, chunk, count(*) AS n, min(v) AS first, max(v) AS last FROM (SELECT o_orderpriority, v, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY v) - 1) // 12)::INT AS chunk FROM (SELECT DISTINCT o_orderpriority, o_orderdate::DATE AS v FROM orders)) GROUP BY ALL",
    "s12_wide_to_long": "SELECT o_orderdate::DATE AS observation_date, DATE '2020-01-01' AS vintage_date, o_totalprice AS value FROM orders UNION ALL SELECT o_orderdate::DATE, DATE '2020-02-01', o_totalprice + 1 FROM orders",
    "s14_warehouse_extract": "WITH keys AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1) SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderdate IS NOT DISTINCT FROM last) AS latest, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open FROM orders JOIN keys USING (o_custkey) GROUP BY ALL",
    "s15_date_chunks": "SELECT DISTINCT o_orderkey, (lo + (year(o_orderdate) - lo) // 2 * 2)::INT AS chunk FROM orders, (SELECT min(year(o_orderdate)) AS lo FROM orders)",
    "s21_parquet_scan": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL",
    "stream_tumbling_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
