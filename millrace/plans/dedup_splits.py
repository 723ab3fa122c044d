"""Queries of deduplication, splits, sampling and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import splits as S
from ..session import table


def _o(spark, d):
    return table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))


def flagship(spark, d):
    """One row per day by rank key, lagged action, two-stage mean."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").withColumn("meeting_date", T.meeting_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    one = S.first_per(o, ["meeting_date"], [F.when(F.trim("o_orderpriority") == "", 1).otherwise(0), F.col("o_orderkey")])
    one = one.withColumn("month", F.substring("meeting_date", 1, 7))
    one = one.withColumn("lag_action", F.lag("o_orderstatus", 1, "No change").over(W.partitionBy("month").orderBy("meeting_date")))
    by_action = one.groupBy("month", "lag_action").agg(F.avg("o_totalprice").alias("m"))
    return by_action.groupBy("month").agg(F.count("*").alias("actions"), F.round(F.avg("m"), 4).alias("mean_price"))


def d1(spark, d):
    o = _o(spark, d).withColumn("label", F.dayofweek("day"))
    return S.dedup_agreeing(o, ["day"], "label", [F.when(F.trim("o_orderpriority") == "", 1).otherwise(0), F.col("o_orderkey"), F.md5("o_orderpriority")]).select("day", "o_orderkey", "label")


def d2(spark, d):
    o = _o(spark, d)
    n = o.groupBy("day").agg(F.count("*").alias("deduplicated_from"))
    return S.first_per(o, ["day"], [F.when(F.col("o_orderstatus") == "P", 1).otherwise(0), F.col("o_custkey"), F.col("o_orderkey")]).join(n, "day").select("day", "o_orderkey", "deduplicated_from")


def d3(spark, d):
    return S.first_per(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def d4(spark, d):
    o = _o(spark, d)
    return o.groupBy("day", F.lower("o_orderpriority").alias("topic")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("o_orderkey")), lambda x: x.cast("string")), ",").alias("lineage"), F.count_distinct("o_orderstatus").alias("variants"))


def d5(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count_distinct("value").alias("vals"), F.count("*").alias("n"))
    return e.where("vals > 1").groupBy("event_type").agg(F.count("*").alias("conflicts"), F.sum("n").alias("n"))


def d6(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), (F.min("l_discount") != F.max("l_discount")).alias("conflict"))
    return per.groupBy("n").agg(F.count("*").alias("keys"), F.count_if("conflict").alias("conflicts"))


def d7(spark, d):
    m = _o(spark, d).withColumn("month", F.trunc("day", "MM"))
    return S.chronological_split(m, "month", {"train": 40, "eval": 10, "test": 10}).groupBy("split").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


def d8(spark, d):
    m = _o(spark, d).withColumn("month", F.trunc("day", "MM"))
    return S.hash_split(m, "month", 42).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("month").alias("meetings"))


def d9(spark, d):
    return table(spark, d, "documents").select(S.hash_role(F.col("doc_id").cast("string")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def d10(spark, d):
    o = table(spark, d, "customer").withColumn("h", F.sha2(F.col("c_custkey").cast("string"), 256))
    return S.top_share(o, [F.col("h"), F.col("c_custkey")], 0.8, F.substring("h", 1, 3)).select("c_custkey", F.col("rank").cast("long").alias("rank"))


def d11(spark, d):
    return S.every_kth(table(spark, d, "customer"), [F.col("c_custkey")], 7, 0.1, F.floor(F.col("c_custkey") / 65536)).select("c_custkey", F.lit("sft_mix").alias("tag"))


def d12(spark, d):
    o = table(spark, d, "customer").withColumn("h", F.sha2(F.concat(F.lit("mix"), F.col("c_custkey").cast("string")), 256))
    primary = S.top_share(o, [F.col("h"), F.col("c_custkey")], 0.2, F.substring("h", 1, 3)).withColumn("role", F.lit("primary")).drop("rank")
    rest = o.join(primary.select("c_custkey"), "c_custkey", "left_anti")
    replay = S.top_share(rest, [F.desc("h"), F.col("c_custkey")], 0.1, F.substring("h", 1, 3), True).withColumn("role", F.lit("replay")).drop("rank")
    return primary.unionByName(replay).select("c_custkey", "role")


def d13(spark, d):
    o = _o(spark, d)
    return o.orderBy("day", "o_orderkey", F.md5("o_orderpriority")).select("day", "o_orderkey")


def d14(spark, d):
    return _o(spark, d).select("o_orderkey", "day", F.sha2("o_orderpriority", 256).alias("prompt_hash"), F.lit("after-2009").alias("data_label"))


def d15(spark, d):
    return S.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", "s1|", 25)


def d16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    return S.quantile_rows(docs, ["lang"], [F.col("chars"), F.col("doc_id")], [0.0, 0.5, 1.0]).select("lang", "doc_id", "quantile")


def d17(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "cut").when(F.col("o_orderstatus") == "O", "hold").otherwise("hike").alias("label"))
    pattern = ["hold", "hike", "hold", "cut", "hold", "hike", "hold", "cut"]
    return S.balanced_schedule(rows, "label", "o_orderkey", pattern, 24, "cycle|").select("position", "step", "label", "o_orderkey")


def d18(spark, d):
    from pyspark.sql import Window as W

    s = d17(spark, d).withColumn("seen", F.row_number().over(W.orderBy("position")) - 1)
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("seen") != F.col("position")).alias("out_of_order"))


def d19(spark, d):
    return table(spark, d, "documents").select("doc_id", S.row_seed(F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}"))).cast("string").alias("seed"))


def d20(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_orderpriority")), 256), 1, 24).alias("sample_id"))


def d21(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "nation").select("n_name", F.format_string("qa-after-2009-%05d", F.row_number().over(W.orderBy("n_nationkey"))).alias("qa_id"))


def d22(spark, d):
    want, roster = ["click", "purchase"], ["view", "click", "purchase"]
    e = table(spark, d, "events").where(F.col("event_type").isin([*want, roster[0]]))
    cover = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("contexts"))
    return cover.select("event_type", "contexts", (F.col("event_type") == roster[0]).alias("baseline"))


def d23(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return S.sample_observations(o, ["o_orderstatus"], "day", "value", 24, 25)


def d24(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_sub(day, 10).alias("days"), F.date_sub(day, 21).alias("weeks"), F.add_months(day, -1).alias("months"), F.add_months(day, -6).alias("quarters"), F.add_months(day, -24).alias("years"))


def d25(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return e.where("rn <= 6").select("user_id", "event_id", (F.col("rn") == 1).alias("latest"))


def d26(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("cost"), (F.col("doc_id") % 17 == 0).alias("required"))
    return S.greedy_projection(docs, "source", "doc_id", "cost", "required", 20000).groupBy("source").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def d27(spark, d):
    m = _o(spark, d).groupBy(F.trunc("day", "MM").alias("start")).agg(F.max("day").alias("end"))
    return S.expanding_training(m, "end", "start")


def x8(spark, d):
    return S.balanced_selection(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "x8")


def d28(spark, d):
    o = _o(spark, d).groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"), *(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))
    return o.withColumn("eligible", (F.col("n") >= 30) & (F.least("f", "o", "p") >= 3))


QUERIES = {
    "p1_d1_w1_a4_meeting_panel": flagship,
    "d1_decision_dedup": d1, "d2_counted_dedup": d2, "d3_first_after_sort": d3, "d4_canonical_collapse": d4, "d5_identity_conflict": d5, "d6_key_conflict_profile": d6, "d7_chronological_split": d7,
    "d8_hash_split": d8, "d9_hash_role": d9, "d10_top_share": d10, "d11_replay_stride": d11, "d12_primary_replay": d12, "d13_reproducible_sort": d13, "d14_row_manifest": d14, "d15_seeded_sample": d15,
    "d16_quantile_pick": d16, "d17_balanced_schedule": d17, "d18_schedule_order": d18, "d19_row_seed": d19, "d20_stable_ids": d20, "d21_sequential_ids": d21, "d22_intervention_subset": d22,
    "d23_frequency_sampling": d23, "d24_calendar_lookback": d24, "d25_recent_n": d25, "d26_budgeted_projection": d26, "d27_expanding_window": d27, "d28_eligibility": d28, "x8_balanced_selection": x8,
}

_HOLD = "CASE o_orderstatus WHEN 'F' THEN 'cut' WHEN 'O' THEN 'hold' ELSE 'hike' END"
_SCHEDULE = f"""SELECT position, step, label, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY position) - 1 AS use FROM (SELECT i AS position, (i // 8)::INT AS step, ['hold', 'hike', 'hold', 'cut', 'hold', 'hike', 'hold', 'cut'][i % 8 + 1] AS label FROM range(192) t(i))) JOIN (SELECT o_orderkey, {_HOLD} AS label, row_number() OVER (PARTITION BY {_HOLD} ORDER BY sha256('cycle|' || o_orderkey), o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY {_HOLD}) AS n FROM orders) USING (label) WHERE use % n = pos"""

ORACLE_SQL = {
    "x8_balanced_selection": "WITH RECURSIVE g AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) AS i FROM (SELECT DISTINCT c_nationkey FROM customer)), p AS (SELECT DISTINCT i, c_nationkey, c_mktsegment, sha256('x8|' || c_nationkey || '|' || c_mktsegment) AS h FROM customer JOIN g USING (c_nationkey)), s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used UNION ALL SELECT s.i + 1, list_append(used, (SELECT arg_min(p.c_mktsegment, lpad(len(list_filter(s.used, lambda u: u = p.c_mktsegment))::VARCHAR, 12, '0') || p.h) FROM p WHERE p.i = s.i + 1)) FROM s WHERE s.i < (SELECT max(i) FROM g)) SELECT c_nationkey, used[i] AS c_mktsegment FROM g, (SELECT used FROM s ORDER BY i DESC LIMIT 1)",
    "p1_d1_w1_a4_meeting_panel": "SELECT month, count(*) AS actions, round(avg(m), 4) AS mean_price FROM (SELECT month, lag_action, avg(o_totalprice) AS m FROM (SELECT *, lag(o_orderstatus, 1, 'No change') OVER (PARTITION BY month ORDER BY meeting_date) AS lag_action FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS meeting_date, strftime(o_orderdate, '%Y-%m') AS month FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY (trim(o_orderpriority) = '')::INT, o_orderkey) = 1)) GROUP BY ALL) GROUP BY month",
    "d1_decision_dedup": "SELECT o_orderdate::DATE AS day, min(o_orderkey) AS o_orderkey, min(dayofweek(o_orderdate) + 1)::INT AS label FROM orders GROUP BY 1",
    "d2_counted_dedup": "SELECT day, o_orderkey, deduplicated_from FROM (SELECT o_orderdate::DATE AS day, o_orderkey, count(*) OVER (PARTITION BY o_orderdate::DATE) AS deduplicated_from, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY (o_orderstatus = 'P')::INT, o_custkey, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "d3_first_after_sort": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "d4_canonical_collapse": "SELECT day, topic, array_to_string(list_transform(list_sort(list(o_orderkey)), lambda x: x::VARCHAR), ',') AS lineage, count(DISTINCT o_orderstatus) AS variants FROM (SELECT o_orderdate::DATE AS day, lower(o_orderpriority) AS topic, o_orderkey, o_orderstatus FROM orders) GROUP BY ALL",
    "d5_identity_conflict": "SELECT event_type, count(*) AS conflicts, sum(n)::BIGINT AS n FROM (SELECT event_type, count(DISTINCT value) AS vals, count(*) AS n FROM events GROUP BY user_id, ts::DATE, event_type) WHERE vals > 1 GROUP BY ALL",
    "d6_key_conflict_profile": "SELECT n, count(*) AS keys, count(*) FILTER (WHERE conflict) AS conflicts FROM (SELECT count(*) AS n, min(l_discount) <> max(l_discount) AS conflict FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY n",
    "d7_chronological_split": "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders), r AS (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT month FROM m)) SELECT CASE WHEN k <= 40 THEN 'train' WHEN k <= 50 THEN 'eval' ELSE 'test' END AS split, count(*) AS n, min(month) AS first, max(month) AS last FROM m JOIN r USING (month) WHERE k <= 60 GROUP BY ALL",
    "d8_hash_split": "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders), r AS (SELECT month, row_number() OVER (ORDER BY sha256('42|' || month::VARCHAR), month) AS k, count(*) OVER () AS c FROM (SELECT DISTINCT month FROM m)) SELECT CASE WHEN k <= floor(c * 0.8) THEN 'train' WHEN k <= floor(c * 0.8) + floor(c * 0.1) THEN 'eval' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT month) AS meetings FROM m JOIN r USING (month) GROUP BY ALL",
    "d9_hash_role": "SELECT CASE WHEN b < 70 THEN 'sft_only' WHEN b < 90 THEN 'grpo_only' ELSE 'shared' END AS role, count(*) AS n FROM (SELECT list_reduce(list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT), lambda a, x: (a * 16 + x) % 100) AS b FROM documents) GROUP BY ALL",
    "d10_top_share": "SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256(c_custkey::VARCHAR), c_custkey) AS rank, count(*) OVER () AS n FROM customer) WHERE rank <= floor(0.8 * n)",
    "d11_replay_stride": "SELECT c_custkey, 'sft_mix' AS tag FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) WHERE k % 7 = 0 AND k // 7 < floor(0.1 * n)",
    "d12_primary_replay": "WITH o AS (SELECT c_custkey, sha256('mix' || c_custkey) AS h FROM customer), p AS (SELECT c_custkey FROM (SELECT *, row_number() OVER (ORDER BY h, c_custkey) AS k, count(*) OVER () AS n FROM o) WHERE k <= floor(0.2 * n)), r AS (SELECT c_custkey FROM (SELECT *, row_number() OVER (ORDER BY h DESC, c_custkey) AS k, count(*) OVER () AS n FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM p)) WHERE k <= floor(0.1 * n)) SELECT c_custkey, 'primary' AS role FROM p UNION ALL SELECT c_custkey, 'replay' FROM r",
    "d13_reproducible_sort": "SELECT o_orderdate::DATE AS day, o_orderkey FROM orders ORDER BY 1, 2",
    "d14_row_manifest": "SELECT o_orderkey, o_orderdate::DATE AS day, sha256(o_orderpriority) AS prompt_hash, 'after-2009' AS data_label FROM orders",
    "d15_seeded_sample": "SELECT doc_id FROM documents ORDER BY sha256('s1|' || doc_id), doc_id LIMIT 25",
    "d16_quantile_pick": "SELECT lang, doc_id, q::DOUBLE AS quantile FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) JOIN (VALUES (0.0), (0.5), (1.0)) v(q) ON k = floor(q * (n - 1) + 0.5)",
    "d17_balanced_schedule": _SCHEDULE,
    "d18_schedule_order": "SELECT 192::BIGINT AS n, 0::BIGINT AS out_of_order",
    "d19_row_seed": "SELECT doc_id, ('0x' || substring(sha256('{\"id\":' || doc_id || '}'), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents",
    "d20_stable_ids": "SELECT o_orderkey, substring(sha256(o_orderkey || '|' || o_orderpriority), 1, 24) AS sample_id FROM orders",
    "d21_sequential_ids": "SELECT n_name, printf('qa-after-2009-%05d', row_number() OVER (ORDER BY n_nationkey)) AS qa_id FROM nation",
    "d22_intervention_subset": "SELECT event_type, count(DISTINCT user_id) AS contexts, event_type = 'view' AS baseline FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL",
    "d23_frequency_sampling": "WITH o AS (SELECT o_orderstatus, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL), w AS (SELECT *, max(day) OVER (PARTITION BY o_orderstatus) AS last FROM o), m AS (SELECT * FROM w WHERE day > (last - INTERVAL 24 MONTH)::DATE QUALIFY row_number() OVER (PARTITION BY o_orderstatus, date_trunc('month', day) ORDER BY day DESC) = 1) SELECT o_orderstatus, day, value FROM m QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY day DESC) <= 25",
    "d24_calendar_lookback": "SELECT o_orderkey, o_orderdate::DATE - 10 AS days, o_orderdate::DATE - 21 AS weeks, (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE AS months, (o_orderdate::DATE - INTERVAL 6 MONTH)::DATE AS quarters, (o_orderdate::DATE - INTERVAL 24 MONTH)::DATE AS years FROM orders",
    "d25_recent_n": "SELECT user_id, event_id, rn = 1 AS latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 6",
    "d27_expanding_window": "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS s, max(o_orderdate::DATE) AS e FROM orders GROUP BY 1) SELECT t.s AS target, (SELECT count(*) FROM m WHERE m.e < t.s) AS n_train FROM m t",
    "d28_eligibility": "SELECT year, n, f, o, p, n >= 30 AND least(f, o, p) >= 3 AS eligible FROM (SELECT year(o_orderdate)::INT AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)",
}
