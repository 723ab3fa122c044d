"""Queries of projections, filters, predicates and normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality_gate as G
from ..session import table


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts built from orders, the same text on both sides."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("For the meeting on **"), day, F.lit("** analyse recent trends in **  "), F.col("o_orderpriority"), F.lit(" ** and related indicators. Use the tone and style of the **"), F.col("o_orderstatus"), F.lit("** section. The rate stands at **"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".25%**.\nProvided data:\n<data>\n"), F.col("o_custkey").cast("string"), F.lit(" \n</data>\nBegin.")).alias("prompt"),
        day.alias("day"),
    )


_PROMPT_SQL = """SELECT o_orderkey, 'For the meeting on **' || strftime(o_orderdate, '%Y-%m-%d') || '** analyse recent trends in **  ' || o_orderpriority || ' ** and related indicators. Use the tone and style of the **' || o_orderstatus || '** section. The rate stands at **' || (o_orderkey % 9)::VARCHAR || '.25%**.' || chr(10) || 'Provided data:' || chr(10) || '<data>' || chr(10) || o_custkey::VARCHAR || ' ' || chr(10) || '</data>' || chr(10) || 'Begin.' AS prompt, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"""


def p1(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("  "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    return table(spark, d, "orders").select("o_orderkey", T.meeting_date(raw).alias("meeting_date"))


def p2(spark, d):
    k, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.concat(F.date_format(day, "yyyy"), F.lit("Q"), F.quarter(day).cast("string")))
        .when(k == 1, F.date_format(day, "yyyy'M'MM"))
        .when(k == 2, F.date_format(day, "yyyyMMdd"))
        .when(k == 3, F.date_format(day, "yyyy-MM-dd HH:mm"))
        .when(k == 4, F.date_format(day, "MMM-yyyy"))
        .otherwise(F.lit("soon"))
    )
    return table(spark, d, "orders").select("o_orderkey", T.parse_date(raw).alias("parsed"))


def p3(spark, d):
    fallback = F.when(F.col("o_orderkey") % 7 == 0, F.lit("given"))
    return _prompts(spark, d).select(
        "o_orderkey",
        T.first_match(F.col("prompt"), T.MEETING_DATE_PATTERNS).alias("meeting_date"),
        T.first_match(F.col("prompt"), T.SECTION_PATTERNS).alias("section_name"),
        T.first_match(F.col("prompt"), T.TOPIC_PATTERNS, fallback).alias("topic"),
        T.first_match(F.col("prompt"), T.RATE_PATTERNS).try_cast("double").alias("current_rate"),
    )


def p4(spark, d):
    return _prompts(spark, d).select("o_orderkey", T.block(F.col("prompt"), "<data>", "</data>").alias("provided_data"), T.last_match(F.col("prompt"), [r"\*\*([^*]+)\*\*"]).alias("last_bold"))


def p5(spark, d):
    p = F.col("prompt")
    meta = _prompts(spark, d).select(T.first_match(p, T.MEETING_DATE_PATTERNS).alias("meeting_date"), T.first_match(p, T.TOPIC_PATTERNS).alias("topic"), T.first_match(p, T.SECTION_PATTERNS).alias("section_name"))
    return meta.groupBy("topic", "section_name").agg(F.min("meeting_date").alias("first_meeting"), F.count("*").alias("n"))


def p6(spark, d):
    return _prompts(spark, d).where(F.col("day") >= "1996-01-01").groupBy(F.substring("day", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def p7(spark, d):
    split = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(split, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_CANON = {"1-urgent": "Urgent", "2-high": "High", "3-medium": "Medium"}


def p8(spark, d):
    raw = F.concat(F.lit(" Itâ€™s Â"), F.col("o_orderpriority"), F.lit("  â€œok \n"))
    return table(spark, d, "orders").select("o_orderkey", T.fix_mojibake(raw).alias("fixed"), T.canonical(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  ")), _CANON).alias("topic"))


def p9(spark, d):
    section = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 4 == 1, F.lit("Videoconference meeting of the day")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", G.abnormal_section(section).alias("abnormal_section"), G.abnormal_topic(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("abnormal_topic"))


def p10(spark, d):
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("intro\n| a | b |\n|---|:--|\n"), F.when(k % 2 == 0, F.lit("| 1 | 2 |\n")).otherwise(F.lit("")), F.lit("text\n"), F.when(k % 3 == 0, F.lit("| c |\n|---|\n| 9 |\n| 8 |\n")).otherwise(F.lit("")), F.when(k % 5 == 0, F.lit("| only |")).otherwise(F.lit("end")))
    return table(spark, d, "orders").select("o_orderkey", T.table_metrics(raw).alias("m")).select("o_orderkey", "m.table_count", "m.data_table_count", "m.header_only_table_count")


def p11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), T.words_count(F.col("text")).cast("long").alias("words"))


def _flagged(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "lang", "source", F.length("text").alias("chars"), T.words_count(F.col("text")).alias("words"), T.count_pattern(F.col("text"), r"\|").alias("pipes"))


_FLAGS = [("header_only_table", "pipes between 1 and 3"), ("abnormal_topic", "lang not in ('en', 'de')"), ("prompt_too_long_chars", "chars > 6000"), ("prompt_too_long_words", "words > 700")]


def p12(spark, d):
    return G.with_flags(_flagged(spark, d), _FLAGS).select("doc_id", F.array_join("quality_flags", ",").alias("flags"))


def p13(spark, d):
    flagged = G.with_flags(_flagged(spark, d), _FLAGS)
    strict = G.gate(flagged, ["abnormal_topic", "prompt_too_long_chars"], missing=F.col("doc_id") % 11 == 0)
    return strict.select("doc_id", F.col("keep"), F.array_join("drop_reasons", ",").alias("drop_reasons"))


def p14(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", G.pre_label(F.col("role"), F.col("text"), ["system"], 50).alias("label"))


def p15(spark, d):
    return table(spark, d, "documents").where(F.length(F.regexp_replace("text", r"\s", "")) > 200).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def p16(spark, d):
    names = {"1-URGENT": "Core", "2-HIGH": "Core", "3-MEDIUM": "Staff"}
    raw = F.concat(F.lit("label: [["), F.col("o_orderpriority"), F.lit("]] and ["), F.col("o_orderstatus"), F.lit("] [[3-MEDIUM]]"))
    found = G.extract_labels(raw, [r"\[\[([^\[\]]+)\]\]"], names)
    return table(spark, d, "orders").select("o_orderkey", found.alias("labels"), G.extract_labels(F.col("o_orderstatus"), [r"\[\[([^\[\]]+)\]\]"], names).alias("none"))


def p17(spark, d):
    lookup = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("section"))
    rows = table(spark, d, "customer").join(F.broadcast(lookup), "c_nationkey", "left").withColumn("section", F.coalesce("section", F.lit("other")))
    return rows.where(~F.col("section").isin("Error", "", "Not-Found")).groupBy("section").agg(F.count("*").alias("n"))


def p18(spark, d):
    name = F.concat(F.lit("fomc_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".html"))
    return table(spark, d, "orders").select("o_orderkey", F.to_date(F.regexp_extract(name, r"(\d{8})", 1), "yyyyMMdd").alias("meeting_date"))


def p19(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit("Raise 25bp")).when(F.col("o_orderkey") % 4 == 1, F.lit(" Cut 50bp")).when(F.col("o_orderkey") % 4 == 2, F.lit("No change")).otherwise(F.lit("maybe"))
    o = table(spark, d, "orders").select(T.coarse_vote(raw).alias("vote"), T.coarse_vote(raw, "").alias("vote_blank"))
    return o.groupBy("vote", "vote_blank").agg(F.count("*").alias("n"))


def p20(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.rate_change_label((F.col("o_orderkey") % 260 - 130).cast("int")).alias("label"))


def p21(spark, d):
    key, boxed = F.col("conv_id") % 4, F.concat(F.lit("\\boxed{ "), "role", F.lit("\n}"))
    raw = F.when(key == 0, F.concat(F.lit("<think>\\boxed{x}</think> so "), boxed, F.lit(" and \\boxed{z}"))).when(key == 1, F.concat(F.lit("<think>"), boxed, F.lit("</think> none"))).when(key == 2, boxed).otherwise(F.concat("text", F.lit("</think>\\boxed{"), F.length("text").cast("string"), F.lit("}")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.boxed_vote(raw).alias("vote"))


def p22(spark, d):
    topics = T.split_top_level(F.concat(F.col("o_orderpriority"), F.lit(", "), F.col("o_orderstatus"), F.lit(", extra (a, b)")))
    have = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "F", "O"]))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_except(topics, have)), "|").alias("missing"))


def p23(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    rendered = F.concat(F.lit("<think>\n"), F.trim("text"), F.lit("\n</think>"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(rendered != F.col("text")).alias("changed"), F.sum(F.length(rendered).cast("long")).alias("chars"))


def p24(spark, d):
    return table(spark, d, "pages").groupBy(F.when(F.col("url").rlike(r"\.pdf$"), "pdf").when(F.col("url").rlike("page"), "page").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


def p25(spark, d):
    o = table(spark, d, "orders")
    reason = F.when(F.col("o_totalprice") < 1000, "small").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_custkey").isNull(), "no customer")
    ledger = G.with_reason(o, reason)
    return ledger.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.min(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("first_hash"))


QUERIES = {
    "p1_meeting_date": p1, "p2_parse_date": p2, "p3_field_extraction": p3, "p4_block_extraction": p4, "p5_prompt_metadata": p5, "p6_scope_filter": p6, "p7_split_filter": p7,
    "p8_canonical_names": p8, "p9_abnormal_predicates": p9, "p10_table_metrics": p10, "p11_length_metrics": p11, "p12_quality_flags": p12, "p13_profile_gate": p13, "p14_pre_label": p14,
    "p15_short_text_filter": p15, "p16_label_extraction": p16, "p17_label_lookup": p17, "p18_date_from_name": p18, "p19_coarse_vote": p19, "p20_rate_change_label": p20, "p21_boxed_vote": p21,
    "p22_missing_indicators": p22, "p23_normalize_sources": p23, "p24_inventory_classes": p24, "p25_exclusion_ledger": p25,
}

_WORDS = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"
_FLAGGED = f"SELECT doc_id, lang, length(text) AS chars, {_WORDS} AS words, length(text) - length(replace(text, '|', '')) AS pipes FROM documents"
_FLAG_SQL = "array_to_string(list_filter([CASE WHEN pipes BETWEEN 1 AND 3 THEN 'header_only_table' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'abnormal_topic' END, CASE WHEN chars > 6000 THEN 'prompt_too_long_chars' END, CASE WHEN words > 700 THEN 'prompt_too_long_words' END], lambda x: x IS NOT NULL), ',')"

ORACLE_SQL = {
    "p1_meeting_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS meeting_date FROM orders",
    "p2_parse_date": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('quarter', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN o_orderdate::DATE WHEN 3 THEN o_orderdate::DATE WHEN 4 THEN date_trunc('month', o_orderdate)::DATE END AS parsed FROM orders",
    "p3_field_extraction": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS meeting_date, o_orderstatus AS section_name, CASE WHEN o_orderkey % 7 = 0 THEN 'given' ELSE o_orderpriority END AS topic, (o_orderkey % 9)::DOUBLE + 0.25 AS current_rate FROM orders",
    "p4_block_extraction": "SELECT o_orderkey, o_custkey::VARCHAR AS provided_data, (o_orderkey % 9)::VARCHAR || '.25%' AS last_bold FROM orders",
    "p5_prompt_metadata": f"SELECT trim(regexp_extract(prompt, 'recent trends in \\*\\*(.*?)\\*\\* and', 1)) AS topic, trim(regexp_extract(prompt, 'style of the \\*\\*(.*?)\\*\\* section', 1)) AS section_name, min(day) AS first_meeting, count(*) AS n FROM ({_PROMPT_SQL}) GROUP BY ALL",
    "p6_scope_filter": "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' GROUP BY ALL",
    "p7_split_filter": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY ALL",
    "p8_canonical_names": "SELECT o_orderkey, 'It’s ' || o_orderpriority || ' “ok' AS fixed, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'Urgent' WHEN '2-high' THEN 'High' WHEN '3-medium' THEN 'Medium' ELSE o_orderpriority END AS topic FROM orders",
    "p9_abnormal_predicates": "SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS abnormal_section, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS abnormal_topic FROM orders",
    "p10_table_metrics": "SELECT o_orderkey, (1 + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0)::INT)::INT AS table_count, ((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT)::INT AS data_table_count, (1 + (o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0)::INT - (o_orderkey % 2 = 0)::INT)::INT AS header_only_table_count FROM orders",
    "p11_length_metrics": f"SELECT doc_id, length(text)::BIGINT AS chars, ({_WORDS})::BIGINT AS words FROM documents",
    "p12_quality_flags": f"SELECT doc_id, {_FLAG_SQL} AS flags FROM ({_FLAGGED})",
    "p13_profile_gate": f"SELECT doc_id, reasons = '' AS keep, reasons AS drop_reasons FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'missing_teacher' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'abnormal_topic' END, CASE WHEN chars > 6000 THEN 'prompt_too_long_chars' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({_FLAGGED}))",
    "p14_pre_label": "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Non-Core' WHEN role = text THEN 'Delete' WHEN length(text) < 50 THEN 'Delete' ELSE '' END AS label FROM conversations",
    "p15_short_text_filter": "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 200",
    "p16_label_extraction": "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Core, Staff' WHEN o_orderpriority = '3-MEDIUM' THEN 'Staff' ELSE o_orderpriority || ', Staff' END AS labels, 'Not-Found' AS none FROM orders",
    "p17_label_lookup": "SELECT coalesce(n_name, 'other') AS section, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey GROUP BY ALL",
    "p18_date_from_name": "SELECT o_orderkey, o_orderdate::DATE AS meeting_date FROM orders",
    "p19_coarse_vote": "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Raise' WHEN 1 THEN 'Cut' WHEN 2 THEN 'No change' ELSE 'Invalid' END AS vote, CASE o_orderkey % 4 WHEN 0 THEN 'Raise' WHEN 1 THEN 'Cut' WHEN 2 THEN 'No change' ELSE '' END AS vote_blank, count(*) AS n FROM orders GROUP BY ALL",
    "p20_rate_change_label": "SELECT o_orderkey, CASE WHEN abs(b) <= 12 THEN 'No change' ELSE (CASE WHEN b > 0 THEN 'Raise ' ELSE 'Cut ' END) || (CASE WHEN abs(b) >= 100 THEN '100' WHEN abs(b) >= 75 THEN '75' WHEN abs(b) >= 50 THEN '50' ELSE '25' END) || 'bp' END AS label FROM (SELECT o_orderkey, o_orderkey % 260 - 130 AS b FROM orders)",
    "p21_boxed_vote": "SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN '' WHEN 3 THEN length(text)::VARCHAR ELSE role END AS vote FROM conversations",
    "p22_missing_indicators": "SELECT o_orderkey, array_to_string(list_sort(list_filter([o_orderpriority, o_orderstatus, 'extra (a, b)'], lambda x: x NOT IN ('1-URGENT', '2-HIGH', 'F', 'O'))), '|') AS missing FROM orders",
    "p23_normalize_sources": "SELECT role, count(*) AS n, count(*) FILTER (WHERE '<think>' || chr(10) || trim(text) || chr(10) || '</think>' <> text) AS changed, sum(length(trim(text)) + 17)::BIGINT AS chars FROM conversations WHERE role = 'assistant' GROUP BY role",
    "p24_inventory_classes": "SELECT CASE WHEN regexp_matches(url, '\\.pdf$') THEN 'pdf' WHEN regexp_matches(url, 'page') THEN 'page' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY ALL",
    "p25_exclusion_ledger": "SELECT CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_custkey IS NULL THEN 'no customer' ELSE 'accepted' END AS reason, count(*) AS n, min(sha256(o_orderkey::VARCHAR)) AS first_hash FROM orders GROUP BY ALL",
}
