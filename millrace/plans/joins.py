"""Queries of joins and matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import matching as M
from ..session import table


def j1(spark, d):
    masters = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lines = M.keep_last(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity"), ["o_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")])
    return masters.join(lines, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def j2(spark, d):
    teachers = table(spark, d, "labels").select("doc_id", F.lit("done").alias("status"))
    rows = table(spark, d, "documents").select("doc_id", "lang").join(teachers, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return rows.groupBy("lang", "status").agg(F.count("*").alias("n"))


def j3(spark, d):
    return M.one_to_one(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey").groupBy("r_regionkey").agg(F.count("*").alias("nations")), table(spark, d, "region"), ["r_regionkey"]).select("r_name", "nations")


def j4(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("v"))
    b = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).cast("int").alias("v"))
    return M.key_audit(a, b, ["key"], ["v"])


def j5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("answer"))
    first = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("good").alias("answer"))
    second = table(spark, d, "labels").select("doc_id", F.lit("any").alias("answer"))
    return M.waterfall(docs, "doc_id", "answer", [first, second]).groupBy("answer", "origin").agg(F.count("*").alias("n"))


def j6(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("match_key"), "o_custkey", "o_orderstatus")
    return M.rank_match(a, b, ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")], [F.col("match_key")])


def _rates(spark, d):
    """One observation a day and event type: a stand-in for macro series."""
    e = table(spark, d, "events").where("event_type in ('view', 'click', 'purchase')")
    return e.groupBy(F.to_date("ts").alias("obs"), "event_type").agg(F.round(F.max("value"), 4).alias("rate"))


_RATES = "(SELECT ts::DATE AS obs, event_type, round(max(value), 4) AS rate FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)"


def _meetings(spark, d, step=3):
    e = table(spark, d, "events")
    days = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return days.select(F.explode(F.sequence("a", F.date_add("b", 5), F.expr(f"interval {step} days"))).alias("meeting"))


_MEETINGS = "(SELECT unnest(generate_series(a::TIMESTAMP, (b + 5)::TIMESTAMP, INTERVAL {step} DAY))::DATE AS meeting FROM (SELECT min(ts::DATE) AS a, max(ts::DATE) AS b FROM events))"


def _by_type(spark, d, step=3):
    # The meetings are one row, an array, until they are beside each type.
    every = _meetings(spark, d, step).agg(F.array_sort(F.collect_list("meeting")).alias("meetings"))
    types = _rates(spark, d).select("event_type").distinct()
    return types.join(F.broadcast(every)).select(F.explode("meetings").alias("meeting"), "event_type")


def j7(spark, d):
    return M.as_of(_by_type(spark, d), _rates(spark, d), ["event_type"], "meeting", "obs", ["rate"]).select("event_type", "meeting", F.col("obs_as_of").alias("obs"), "rate")


def j8(spark, d):
    cut = _by_type(spark, d).withColumn("cutoff", F.add_months(F.trunc("meeting", "MM"), 0))
    return M.as_of(cut, _rates(spark, d), ["event_type"], "cutoff", "obs", ["rate"]).select("event_type", "meeting", "cutoff", F.col("obs_as_of").alias("obs"), "rate")


def j9(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("obs")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    target = o.select(F.col("obs").alias("target"), F.add_months("obs", -12).alias("year_ago"), F.lit(1).alias("one"))
    return M.as_of(target, o.withColumn("one", F.lit(1)), ["one"], "year_ago", "obs", ["value"]).select("target", F.col("obs_as_of").alias("obs"), "value").where("value is not null")


def j10(spark, d):
    rates = _rates(spark, d).where("event_type = 'click'").select("obs", "rate")
    daily = rates.where(F.dayofmonth("obs") % 4 != 0)
    monthly = rates.groupBy(F.trunc("obs", "MM").alias("month")).agg(F.min("rate").alias("month_rate"))
    m = _meetings(spark, d, 1).withColumn("next_day", F.date_add("meeting", 1)).withColumn("month", F.trunc("meeting", "MM"))
    out = m.join(daily.withColumnRenamed("obs", "next_day"), "next_day", "left").join(monthly, "month", "left")
    return out.select("meeting", F.coalesce("rate", "month_rate").alias("rate"))


def j11(spark, d):
    m = _meetings(spark, d, 7).withColumn("low", F.date_sub("meeting", 10))
    r = _rates(spark, d)
    # A day's rows meet the few windows that cover it by an equi-join on the day.
    days = m.select("meeting", F.explode(F.expr("sequence(date_add(low, 1), meeting)")).alias("obs"))
    return days.join(r, "obs").groupBy("meeting", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 4).alias("total"))


def j12(spark, d):
    n = M.neighbours(_rates(spark, d), ["event_type"], "obs", "rate")
    return _meetings(spark, d).withColumnRenamed("meeting", "obs").join(n, "obs").select("obs", "event_type", "previous_2", "previous_1", "rate", "next_1")


def j13(spark, d):
    full = _by_type(spark, d).join(_rates(spark, d).withColumnRenamed("obs", "meeting"), ["meeting", "event_type"], "left")
    return full.groupBy("meeting").agg(F.count("rate").alias("series"), F.when(F.count("rate") == 3, "complete").otherwise("excluded").alias("status"))


def j14(spark, d):
    horizons = spark.createDataFrame([(h, c) for h in (1, 2) for c in ("calendar", "trading")], "horizon int, convention string")
    ledger = _meetings(spark, d).join(F.broadcast(horizons))
    r = _rates(spark, d).where("event_type = 'view'").select("obs", "rate")
    ledger = ledger.withColumn("obs", F.expr("date_add(meeting, horizon)")).join(r, "obs", "left")
    return ledger.select("meeting", "horizon", "convention", F.when(F.col("rate").isNull(), "missing").otherwise("ok").alias("status"), "rate")


def j15(spark, d):
    contracts = table(spark, d, "lineitem").groupBy(F.last_day("l_shipdate").alias("last_trade")).agg(F.count("*").alias("volume"))
    m = _o_months(spark, d)
    # Contracts are few (one a month), so the ranked list is joined by its position.
    ranked = contracts.withColumn("pos", F.row_number().over(W.orderBy("last_trade")))
    first = M.as_of(m.withColumn("one", F.lit(1)), ranked.withColumn("one", F.lit(1)), ["one"], "day", "last_trade", ["pos"], strict=True).select("day", F.coalesce("pos", F.lit(0)).alias("before"))
    return first.join(ranked, ranked.pos == first.before + 2).select("day", "last_trade", "volume")


def _o_months(spark, d):
    return table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("day")).distinct()


def j16(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    full = v.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_quantity").alias("full_value"))
    masked = v.where("l_linenumber > 1")
    paired = masked.join(full, "l_orderkey", "left")
    return paired.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("full_value").isNull()).alias("uncovered"), F.round(F.sum(F.col("full_value") - F.col("l_quantity")), 2).alias("delta"))


def j17(spark, d):
    k = F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("id:"), F.col("o_orderkey").cast("string"))), F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", k.alias("row_key"))


def j18(spark, d):
    return M.distinct_text(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


def j19(spark, d):
    g = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(True).alias("has_text"))
    r = table(spark, d, "labels").select("doc_id", F.lit(True).alias("has_reference"))
    e = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("has_evidence"))
    every = g.join(r, "doc_id", "full").join(e, "doc_id", "full")
    status = F.when(F.col("has_text").isNull(), "no generation").when(F.col("has_reference").isNull(), "no reference").when(F.col("has_evidence").isNull(), "no evidence").otherwise("scored")
    return every.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def j20(spark, d):
    lab = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"), F.col("o_orderstatus").alias("label_topic"), F.col("o_orderpriority").alias("excerpt"))
    rows = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("source_index"), F.col("l_linestatus").alias("topic"))
    joined = rows.join(lab, "source_index", "left")
    return joined.groupBy(F.when(F.col("topic") == F.col("label_topic"), "labeled").otherwise("fallback").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("excerpt").alias("excerpts"))


def j21(spark, d):
    rows = M.keep_last(table(spark, d, "conversations"), ["conv_id", "role"], [F.col("turn"), F.col("text")])
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), F.md5("text")).alias("part")))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("document"))


def j22(spark, d):
    grid = table(spark, d, "nation").where("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(grid, "c_nationkey", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.trim("c_name") == "").alias("blank"))


def j23(spark, d):
    """Texts that are equal once normalised: each with the smallest id of its class and their number; classes meet by hash and are told apart by the text."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("t"))
    own = docs.groupBy("lang", F.xxhash64("t").alias("h"), "t").agg(F.min("doc_id").alias("official_id"), F.count("*").alias("n")).where("n > 1")
    return docs.withColumn("h", F.xxhash64("t")).join(own, ["lang", "h", "t"]).select("doc_id", "official_id", "n")


def j24(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 3).alias("split"))
    s = lambda k: o.where(F.col("split") == k).select("day").distinct()
    rows = [s(a).intersect(s(b)).agg(F.lit(f"{a}-{b}").alias("pair"), F.count("*").alias("shared")) for a, b in ((0, 1), (0, 2), (1, 2))]
    return rows[0].union(rows[1]).union(rows[2])


QUERIES = {
    "j1_keep_last_join": j1, "j2_left_join_status": j2, "j3_one_to_one_join": j3, "j4_key_audit": j4, "j5_waterfall_join": j5, "j6_rank_match": j6, "j7_as_of_join": j7, "j8_lagged_as_of": j8,
    "j9_year_comparable_as_of": j9, "j10_daily_then_monthly": j10, "j11_trailing_range_join": j11, "j12_neighbour_window": j12, "j13_complete_cases": j13, "j14_calendar_ledger": j14, "j15_live_contract": j15,
    "j16_full_masked_pairing": j16, "j17_row_key": j17, "j18_reference_index": j18, "j19_three_way_alignment": j19, "j20_positional_labels": j20, "j21_section_assembly": j21, "j22_reference_view": j22, "j23_text_match": j23, "j24_split_overlap": j24,
}

_TYPES = f"(SELECT DISTINCT event_type FROM {_RATES})"
_GRID = f"(SELECT meeting, event_type FROM {_MEETINGS.format(step=3)} CROSS JOIN {_TYPES})"

ORACLE_SQL = {
    "j1_keep_last_join": "SELECT o_orderstatus, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM orders JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1) ON l_orderkey = o_orderkey GROUP BY ALL",
    "j2_left_join_status": "SELECT lang, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'done' END AS status, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY ALL",
    "j3_one_to_one_join": "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "j4_key_audit": "SELECT count(*) FILTER (WHERE b.key IS NULL) AS left_only, count(*) FILTER (WHERE a.key IS NULL) AS right_only, count(*) FILTER (WHERE a.key IS NOT NULL AND b.key IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS mismatched FROM (SELECT c_custkey AS key, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS key, c_nationkey + (c_custkey % 5 = 0)::INT AS v FROM customer WHERE c_custkey % 4 <> 0) b ON a.key = b.key",
    "j5_waterfall_join": "SELECT answer, origin, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 <> 0 THEN lang WHEN quality = 1 THEN 'good' WHEN quality IS NOT NULL THEN 'any' ELSE '' END AS answer, CASE WHEN doc_id % 3 <> 0 THEN 0 WHEN quality = 1 THEN 1 WHEN quality IS NOT NULL THEN 2 END AS origin FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL",
    "j6_rank_match": "WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS match_key, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1) SELECT o_custkey, o_orderstatus, o_orderkey, match_key FROM a LEFT JOIN b USING (o_custkey, o_orderstatus, k)",
    "j7_as_of_join": f"SELECT g.event_type, meeting, obs, rate FROM {_GRID} g ASOF LEFT JOIN {_RATES} r ON g.event_type = r.event_type AND g.meeting >= r.obs",
    "j8_lagged_as_of": f"SELECT g.event_type, meeting, cutoff, obs, rate FROM (SELECT *, date_trunc('month', meeting)::DATE AS cutoff FROM {_GRID}) g ASOF LEFT JOIN {_RATES} r ON g.event_type = r.event_type AND g.cutoff >= r.obs",
    "j9_year_comparable_as_of": "WITH o AS (SELECT o_orderdate::DATE AS obs, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL) SELECT t.target, o.obs, o.value FROM (SELECT obs AS target, (obs - INTERVAL 12 MONTH)::DATE AS year_ago FROM o) t ASOF JOIN o ON t.year_ago >= o.obs",
    "j10_daily_then_monthly": f"WITH r AS (SELECT obs, rate FROM {_RATES} WHERE event_type = 'click'), m AS (SELECT date_trunc('month', obs)::DATE AS month, min(rate) AS month_rate FROM r GROUP BY ALL) SELECT meeting, coalesce(rate, month_rate) AS rate FROM {_MEETINGS.format(step=1)} LEFT JOIN (SELECT * FROM r WHERE day(obs) % 4 <> 0) ON obs = meeting + 1 LEFT JOIN m ON month = date_trunc('month', meeting)::DATE",
    "j11_trailing_range_join": f"SELECT meeting, event_type, count(*) AS n, round(sum(rate), 4) AS total FROM {_MEETINGS.format(step=7)} JOIN {_RATES} ON obs > meeting - 10 AND obs <= meeting GROUP BY ALL",
    "j12_neighbour_window": f"SELECT obs, event_type, previous_2, previous_1, rate, next_1 FROM (SELECT *, lag(rate, 2) OVER w AS previous_2, lag(rate) OVER w AS previous_1, lead(rate) OVER w AS next_1 FROM {_RATES} WINDOW w AS (PARTITION BY event_type ORDER BY obs)) JOIN {_MEETINGS.format(step=3)} ON meeting = obs",
    "j13_complete_cases": f"SELECT meeting, count(rate) AS series, CASE WHEN count(rate) = 3 THEN 'complete' ELSE 'excluded' END AS status FROM {_GRID} g LEFT JOIN {_RATES} r ON r.obs = meeting AND r.event_type = g.event_type GROUP BY meeting",
    "j14_calendar_ledger": f"SELECT meeting, h::INT AS horizon, c AS convention, CASE WHEN rate IS NULL THEN 'missing' ELSE 'ok' END AS status, rate FROM {_MEETINGS.format(step=3)} CROSS JOIN (VALUES (1), (2)) x(h) CROSS JOIN (VALUES ('calendar'), ('trading')) y(c) LEFT JOIN (SELECT obs, rate FROM {_RATES} WHERE event_type = 'view') ON obs = meeting + h",
    "j15_live_contract": "WITH c AS (SELECT last_day(l_shipdate::DATE) AS last_trade, count(*) AS volume FROM lineitem GROUP BY ALL), m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS day FROM orders) SELECT day, last_trade, volume FROM m JOIN c ON last_trade >= day QUALIFY row_number() OVER (PARTITION BY day ORDER BY last_trade) = 2",
    "j16_full_masked_pairing": "SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE f IS NULL) AS uncovered, round(sum(f - l_quantity), 2) AS delta FROM lineitem m LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS f FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) x USING (l_orderkey) WHERE l_linenumber > 1 GROUP BY ALL",
    "j17_row_key": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'id:' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || '|' || o_custkey END AS row_key FROM orders",
    "j18_reference_index": "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ' || ' ORDER BY o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) AS variants FROM orders GROUP BY ALL",
    "j19_three_way_alignment": "SELECT CASE WHEN g IS NULL THEN 'no generation' WHEN r IS NULL THEN 'no reference' WHEN e IS NULL THEN 'no evidence' ELSE 'scored' END AS status, count(*) AS n FROM (SELECT doc_id, 1 AS g FROM documents WHERE doc_id % 2 = 0) FULL JOIN (SELECT doc_id, 1 AS r FROM labels) USING (doc_id) FULL JOIN (SELECT doc_id, 1 AS e FROM documents WHERE doc_id % 3 = 0) USING (doc_id) GROUP BY ALL",
    "j20_positional_labels": "SELECT CASE WHEN l_linestatus = o_orderstatus THEN 'labeled' ELSE 'fallback' END AS status, count(*) AS n, count(DISTINCT o_orderpriority) AS excerpts FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY ALL",
    "j21_section_assembly": "SELECT conv_id, string_agg('## ' || role || chr(10) || md5(text), chr(10) || chr(10) ORDER BY turn) AS document FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1) GROUP BY conv_id",
    "j22_reference_view": "SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE trim(c_name) = '') AS blank FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) GROUP BY ALL",
    "j23_text_match": "WITH t AS (SELECT doc_id, lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, t) AS official_id, count(*) OVER (PARTITION BY lang, t) AS n FROM t QUALIFY count(*) OVER (PARTITION BY lang, t) > 1",
    "j24_split_overlap": "WITH o AS (SELECT DISTINCT o_orderdate::DATE AS day, o_orderkey % 3 AS split FROM orders) SELECT a.split || '-' || b.split AS pair, count(*) AS shared FROM o a JOIN o b ON a.day = b.day AND a.split < b.split GROUP BY ALL",
}
