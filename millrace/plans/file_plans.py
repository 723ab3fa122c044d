"""Queries that write tables as files, in the shared folder, and read them by the package's sources."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inference as I
from ..operators import resampling as B
from ..session import table
from ..sources import files

NATION = "n_nationkey int, n_name string, n_regionkey int"


def s1(spark, d):
    at = files.scratch(spark)
    files.write_jsonl(table(spark, d, "nation"), f"{at}/nation.jsonl")
    return files.read_jsonl(spark, f"{at}/nation.jsonl", NATION)


def s2(spark, d):
    at = files.scratch(spark)
    rows = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("hash"))
    files.write_jsonl(rows, f"{at}/documents.jsonl", "gzip")
    return files.read_jsonl(spark, f"{at}/documents.jsonl", "doc_id long, lang string, hash string")


def s3(spark, d):
    at = files.scratch(spark)
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    # One document in one file, over several lines: the few regions are its elements.
    rows.agg(F.to_json(F.collect_list(F.struct("n_regionkey", "names")), {"pretty": "true"})).write.text(f"{at}/regions.json")
    got = files.read_json(spark, f"{at}/regions.json", "n_regionkey int, names array<string>")
    return got.select("n_regionkey", F.array_join("names", ",").alias("names"))


def _series(spark, d):
    value = F.when(F.col("c_custkey") % 7 == 0, ".").when(F.col("c_custkey") % 7 == 1, " NA ").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", value.alias("balance"))


def _balances(df):
    return df.groupBy(F.col("c_nationkey").cast("int").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum(files.finite_number(F.col("balance"))), 4).alias("balance"))


def s4(spark, d):
    at = files.scratch(spark)
    _series(spark, d).write.option("header", True).csv(f"{at}/customers.csv")
    return _balances(files.read_any(spark, f"{at}/customers.csv"))


def s23(spark, d):
    at = files.scratch(spark)
    _series(spark, d).write.option("header", True).option("compression", "gzip").csv(f"{at}/customers.csv.gz")
    return _balances(files.read_any(spark, f"{at}/customers.csv.gz"))


def _parted(spark, d):
    at = files.scratch(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for name, where in (("a_train", "o_orderstatus = 'F'"), ("b_validation", "o_orderstatus = 'O'"), ("c_rest", "o_orderstatus = 'P'")):
        files.write_jsonl(o.where(where), f"{at}/{name}.jsonl")
    return at


def s6(spark, d):
    rows = files.with_provenance(spark.read.schema("o_orderkey long, o_orderstatus string").json(f"{_parted(spark, d)}/*.jsonl"))
    return rows.groupBy(F.element_at(F.split("source_file", "/"), -2).alias("file")).agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("status"), F.sum("o_orderkey").alias("keys"))


def s7(spark, d):
    split = files.read_split(spark, _parted(spark, d), "o_orderkey long, o_orderstatus string")
    train, validation = (df.select(F.lit(name).alias("split"), "o_orderkey") for name, df in sorted(split.items()))
    return train.unionByName(validation).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def s8(spark, d):
    at, rows, out = files.scratch(spark), table(spark, d, "nation"), None
    rows.write.json(f"{at}/n.jsonl"), rows.write.parquet(f"{at}/n.parquet"), rows.write.option("header", True).csv(f"{at}/n.csv")
    for kind in ("jsonl", "parquet", "csv"):
        own = files.read_any(spark, f"{at}/n.{kind}", NATION).select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("int").alias("key"), "n_name")
        out = own if out is None else out.unionByName(own)
    return out


def s11(spark, d):
    """Archives of CSV files, one for each priority, with two vintages of its days' orders."""

    @F.pandas_udf("binary")
    def zipped(text: pd.Series) -> pd.Series:
        def pack(t):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("series.csv", "﻿" + t)
            return out.getvalue()

        return text.map(pack)

    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    vintage = F.concat(F.lit("2020010"), F.substring("p", 1, 1))
    late = F.concat(F.lit("2020020"), F.substring("p", 1, 1))
    line = F.concat_ws(",", F.col("day").cast("string"), F.col("n").cast("string"), F.when(F.col("n") % 5 == 0, ".").otherwise((F.col("n") + 0.5).cast("string")))
    text = days.groupBy(vintage.alias("v"), late.alias("w")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("body"))
    archives = text.select(zipped(F.concat(F.lit("date,S_"), "v", F.lit(",S_"), "w", F.lit("\r\n"), "body")).alias("content"))
    return files.zipped_vintages(archives)


def s16(spark, d):
    at = files.scratch(spark)
    files.write_jsonl(table(spark, d, "customer"), f"{at}/customer.jsonl")
    return spark.sql(f"SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS balance FROM json.`{at}/customer.jsonl` WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' ORDER BY balance DESC, c_custkey")


def s17(spark, d):
    at, rows = files.scratch(spark), table(spark, d, "nation")
    files.publish(rows, at, "nation")
    try:
        files.publish(rows.limit(1), at, "nation")
        refused = False
    except Exception as x:
        refused = "PATH_ALREADY_EXISTS" in str(x)
    held = spark.read.json(f"{at}/nation.manifest").agg(F.max("rows").alias("rows"), F.min(F.length("sha256")).cast("long").alias("hash_length"))
    return held.withColumn("refused", F.lit(refused)).crossJoin(spark.read.parquet(f"{at}/nation").agg(F.count("*").alias("kept")))


def s18(spark, d):
    at = files.scratch(spark)
    table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(f"{at}/names")
    return files.fingerprints(spark, f"{at}/names").where("file_name like 'part-%'").select("sha256", "bytes")


def s24(spark, d):
    at = files.scratch(spark)
    files.write_plan(B.plan(table(spark, d, "nation"), "n_nationkey", "n_regionkey", 20), f"{at}/plan")
    return files.read_plan(spark, f"{at}/plan").groupBy("draw").agg(F.count("*").alias("units"), F.sum("times").alias("taken"), F.sum(F.col("times") * F.col("unit")).alias("checksum"))


def t37(spark, d):
    """Release dates from calendar pages: the link of the exact meeting first, then the date that it says it was released on."""
    key, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    link = lambda when, said: F.concat(F.lit('<p><a href="/cal/minutes'), F.date_format(when, "yyyyMMdd"), F.lit('.htm">Minutes</a>'), said, F.lit("</p>\n"))
    said = lambda when: F.concat(F.lit("\n (Released "), F.date_format(when, "MMMM d, yyyy"), F.lit(")"))
    other = link(F.date_add(day, 7), said(F.date_add(day, 30)))
    html = F.when(key == 0, F.concat(other, link(day, said(F.date_add(day, 21))))).when(key == 1, F.concat(link(day, F.lit("")), other)).when(key == 2, other).when(key == 3, F.concat(link(day, said(F.date_add(day, 20))), link(day, said(F.date_add(day, 22))))).otherwise(F.lit("<p>Released January 1, 2000</p>"))
    pages = table(spark, d, "orders").select("o_orderkey", day.alias("day"), html.alias("html"))
    return T.release_evidence(pages, "html", "day").select("o_orderkey", "evidence", "release_date", "lag_days")


def x2(spark, d):
    """Two labellings of a nation's suppliers, swapped unit by unit, with weights that balance two classes."""
    s = table(spark, d, "supplier").withColumn("panel", F.concat_ws(":", "s_nationkey", F.floor(F.col("s_suppkey") / 250)))
    a, b = (F.col("s_suppkey") % 3 == 0).cast("double"), (F.col("s_suppkey") % 2 == 0).cast("double")
    return I.label_swap(s, "panel", "s_suppkey", a, b, F.when(F.col("s_acctbal") > 0, 0.5).otherwise(1.0)).select("panel", F.round("p", 8).alias("p"), "masks")


def s5(spark, d):
    """A workbook of customers' reports by nation, with nulls, texts that need escapes and numbers; written and read."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.max("c_acctbal"), 2).alias("most"))
    name = F.when(F.col("c_nationkey") % 4 == 0, None).otherwise(F.concat(F.lit(" <a & b> "), F.col("c_nationkey").cast("string")))
    at = files.scratch(spark)
    files.write_workbook(c.select(F.col("c_nationkey").cast("long").alias("nation"), name.alias("name"), "n", F.when(F.col("c_nationkey") % 3 != 0, F.col("most")).alias("most")), f"{at}/book")
    return files.read_workbooks(spark.read.parquet(f"{at}/book"), "nation long, name string, n long, most double")


def s13(spark, d):
    """Batches of keys by nation, asked of a source that refuses batches with a bad key; refused ones are halved."""

    def ask(batches):
        for batch in batches:
            for nation, keys in zip(batch["nation"], batch["keys"], strict=True):
                answers = files.bisected(list(keys), lambda b: None if any(k % 37 == 0 for k in b) else b)
                got = [(int(nation), int(k), "unusable" if a is None else "available") for b, a in answers for k in b]
                yield pd.DataFrame(got, columns=["nation", "key", "outcome"])

    groups = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation"), F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("long"))).alias("keys"))
    return groups.select("nation", "keys").mapInPandas(ask, "nation long, key long, outcome string")


def s20(spark, d):
    """Links of the pages that a download would follow: those of the same site, in full."""
    links = files.page_links(table(spark, d, "pages").select("page_id", "url", "html"), "url", "html")
    host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/?#]+)", 1)
    return links.select("page_id", "link", (host(F.col("link")) == host(F.col("url"))).alias("same_site")).distinct()


QUERIES = {
    "s1_jsonl_scan": s1, "s2_jsonl_sink": s2, "s3_json_objects": s3, "s4_csv_series": s4, "s5_workbook": s5, "s6_glob_provenance": s6, "s7_split_discovery": s7, "s8_extension_dispatch": s8, "s11_zip_vintages": s11,
    "s13_request_bisection": s13, "s16_json_sql": s16, "s17_create_only_publish": s17, "s18_fingerprint": s18, "s20_link_index": s20, "s23_gzip_csv": s23, "s24_plan_table": s24, "t37_release_evidence": t37, "x2_label_swap": x2,
}

_BALANCES = "SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal) FILTER (WHERE c_custkey % 7 > 1), 4) AS balance FROM customer GROUP BY ALL"

ORACLE_SQL = {
    "s1_jsonl_scan": "SELECT * FROM nation",
    "s2_jsonl_sink": "SELECT doc_id, lang, md5(text) AS hash FROM documents",
    "s3_json_objects": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY ALL",
    "s4_csv_series": _BALANCES,
    "s23_gzip_csv": _BALANCES,
    "s5_workbook": "SELECT c_nationkey::BIGINT AS nation, CASE WHEN c_nationkey % 4 <> 0 THEN ' <a & b> ' || c_nationkey END AS name, count(*) AS n, CASE WHEN c_nationkey % 3 <> 0 THEN round(max(c_acctbal), 2) END AS most FROM customer GROUP BY c_nationkey",
    "s13_request_bisection": "SELECT c_nationkey::BIGINT AS nation, c_custkey::BIGINT AS key, CASE WHEN c_custkey % 37 = 0 THEN 'unusable' ELSE 'available' END AS outcome FROM customer",
    "s20_link_index": r"""WITH h AS (SELECT DISTINCT page_id, url, trim(unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1))) AS href FROM pages), l AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[^/]*$', '') || href END AS link FROM h WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:)')) SELECT DISTINCT page_id, link, split_part(link, '/', 3) = split_part(url, '/', 3) AS same_site FROM l""",
    "s6_glob_provenance": "SELECT CASE o_orderstatus WHEN 'F' THEN 'a_train' WHEN 'O' THEN 'b_validation' ELSE 'c_rest' END || '.jsonl' AS file, count(*) AS n, min(o_orderstatus) AS status, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL",
    "s7_split_discovery": "SELECT CASE o_orderstatus WHEN 'F' THEN 'train' ELSE 'validation' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL",
    "s8_extension_dispatch": "SELECT kind, n_nationkey AS key, n_name FROM nation, (VALUES ('jsonl'), ('parquet'), ('csv')) t(kind)",
    "s11_zip_vintages": "WITH n AS (SELECT left(o_orderpriority, 1) AS p, o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY ALL) SELECT date, make_date(2020, 1, p::INT) AS vintage_date, n::DOUBLE AS value FROM n UNION ALL SELECT date, make_date(2020, 2, p::INT), n + 0.5::DOUBLE FROM n WHERE n % 5 <> 0",
    "s16_json_sql": "SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS balance FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'",
    "s17_create_only_publish": "SELECT count(*) AS rows, 64::BIGINT AS hash_length, true AS refused, count(*) AS kept FROM nation",
    "s18_fingerprint": "SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS sha256, (sum(length(n_name)) + count(*))::BIGINT AS bytes FROM nation",
    "s24_plan_table": "WITH c AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL), t AS (SELECT draw, n_regionkey, ('0x' || substring(md5('s:' || draw || ':' || n_regionkey || ':' || position), 1, 12))::BIGINT % n AS number FROM c, range(0, 20) r(draw), LATERAL (SELECT unnest(range(0, n)) AS position)), u AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS number FROM nation) SELECT draw::INT AS draw, count(DISTINCT n_nationkey) AS units, count(*) AS taken, sum(n_nationkey)::BIGINT AS checksum FROM t JOIN u USING (n_regionkey, number) GROUP BY ALL",
    "t37_release_evidence": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'released' WHEN 1 THEN 'link only' WHEN 3 THEN 'ambiguous' ELSE 'none' END AS evidence, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 21 END AS release_date, CASE WHEN o_orderkey % 5 = 0 THEN 21 END::INT AS lag_days FROM orders",
    "x2_label_swap": "WITH s AS (SELECT s_nationkey || ':' || (s_suppkey // 250) AS panel, s_suppkey, ((s_suppkey % 3 = 0)::INT - (s_suppkey % 2 = 0)::INT) * CASE WHEN s_acctbal > 0 THEN 0.5 ELSE 1.0 END AS w FROM supplier), i AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY s_suppkey) - 1 AS i FROM s), t AS (SELECT panel, abs(sum(w)) AS t, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT panel, t, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM t), x AS (SELECT m.panel, mask, any_value(t) AS t, abs(sum(CASE WHEN (mask & (1 << i)) = 0 THEN w ELSE -w END)) AS x FROM m JOIN i ON i.panel = m.panel GROUP BY ALL) SELECT panel, round(avg((x >= t - 1e-12)::INT), 8) AS p, count(*) AS masks FROM x GROUP BY ALL",
}
