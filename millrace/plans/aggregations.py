"""Queries of aggregations, window functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import table

_LABELS = ["F", "O", "P"]


def _guess(spark, d):
    o = table(spark, d, "orders")
    g = F.when(F.col("o_orderkey") % 4 == 0, "O").when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("truth"), g.alias("guess"))


_GUESS = "(SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus AS truth, CASE WHEN o_orderkey % 4 = 0 THEN 'O' WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS guess FROM orders)"


def a1(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))


def a2(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


def a3(spark, d):
    t = F.col("text")
    flags = F.array_compact(F.array(F.when(F.length(t) > 5000, "long"), F.when(t.contains("@"), "at"), F.when(t.contains("|"), "pipe")))
    return table(spark, d, "documents").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def a4(spark, d):
    li = table(spark, d, "lineitem")
    return M.staged_mean(li, [["l_orderkey", "l_returnflag"], ["l_returnflag"]], "l_quantity").select("l_returnflag", F.round("mean", 6).alias("mean"))


def a5(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value")))
    return M.equal_weight_summary(e, "user_id", "v", ["event_type"]).select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("sd", 6).alias("sd"), "units", "excluded")


def a6(spark, d):
    q = F.percentile("o_totalprice", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(q.alias("q")).select("o_orderstatus", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("mid"), F.round(F.col("q")[2], 4).alias("high"))


def a7(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return n.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("n", -F.col("first"))).alias("mode"))


def a8(spark, d):
    hit = F.avg((F.col("truth") == F.col("guess")).cast("double"))
    g = _guess(spark, d)
    return g.groupBy("truth").agg(F.round(hit, 6).alias("accuracy")).union(g.agg(F.lit("all").alias("truth"), F.round(hit, 6)))


def a9(spark, d):
    return _guess(spark, d).agg(F.count("*").alias("n"), F.count_if(F.trim("guess") == "").alias("invalid"), F.count_if(F.col("truth") == F.col("guess")).alias("exact"))


def a10(spark, d):
    return M.confusion(_guess(spark, d), "truth", "guess", _LABELS)


def a11(spark, d):
    return M.classification(_guess(spark, d), "truth", "guess", [*_LABELS, "none"]).select("n", *(F.round(c, 8).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")))


def a12(spark, d):
    k = (F.col("o_orderkey") % 10) / 20.0
    p = {"F": F.lit(0.5) - k / 2, "O": F.lit(0.5) - k / 2, "P": k}
    return M.probability_metrics(table(spark, d, "orders"), F.col("o_orderstatus"), p).select("n", *(F.round(c, 8).alias(c) for c in ("brier", "log_loss", "true_probability")))


def a13(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    w, every = W.partitionBy("o_orderstatus"), W.partitionBy(F.lit(1))
    joint = (F.sum("n").over(w) / F.sum("n").over(every)) * (F.col("n") / F.sum("n").over(w))
    return n.select("o_orderstatus", "o_orderpriority", F.round(joint, 8).alias("p"))


def a14(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", _LABELS).agg(F.round(F.avg("o_totalprice"), 4))


def a15(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.round("l_extendedprice", 0).alias("y"))
    return M.spearman(li, "x", "y").select(*(F.round(c, 6).alias(c) for c in ("pearson", "spearman", "sign_agreement")))


def a16(spark, d):
    err = F.col("l_extendedprice") - F.col("l_quantity") * 1000
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*M.error_metrics(err, F.stddev_samp("l_extendedprice"))).select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("bias", "mae", "rmse", "scaled_rmse")))


def a17(spark, d):
    return M.k_stability(table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("v")), "l_orderkey", "l_linenumber", "v").select("k", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "max_drift")), "units")


def a18(spark, d):
    o = table(spark, d, "orders")
    scale = o.where("o_orderstatus = 'F'").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return o.join(F.broadcast(scale)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.col("s"), 6).alias("z"))


def a19(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("rz"), F.year(F.min("o_orderdate")).alias("year"))
    return daily.select("day", F.round(F.col("rz") - 0.368 * F.lag("rz").over(W.partitionBy("year").orderBy("day")), 4).alias("shock"))


def a20(spark, d):
    day = F.to_date("o_orderdate")
    end = F.date_add(day, F.pmod(F.lit(4) - F.dayofweek(day), F.lit(7)))
    return table(spark, d, "orders").where(~F.dayofweek("o_orderdate").isin(1, 7)).groupBy(end.alias("week_end")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))


def a21(spark, d):
    v = F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_quantity"))
    li = table(spark, d, "lineitem").select("l_orderkey", v.alias("v"))
    return li.groupBy("l_orderkey").agg(F.count("*").alias("topics"), F.when(F.count("v") == F.count("*"), F.round(F.avg("v"), 6)).alias("complete_mean"), F.round(F.avg(F.coalesce("v", F.lit(0.0))), 6).alias("neutral_mean"))


def a22(spark, d):
    return M.leave_one_out_mean(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal").select("c_nationkey", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "sign_stable")


def a23(spark, d):
    # Slope with one year left out, from sums: no refit needs the rows again.
    li = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("xy"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("xx"))
    w = W.partitionBy(F.lit(1))
    less = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "x", "y", "xy", "xx")}
    slope = (less["xy"] - less["x"] * less["y"] / less["n"]) / (less["xx"] - less["x"] * less["x"] / less["n"])
    return li.select("year", F.round(slope, 4).alias("slope"))


def a24(spark, d):
    docs = table(spark, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_list(F.length("text"))).alias("v"))
    return docs.select("lang", M.quantile_rank(F.col("v"), 0.95, "round").alias("p95_round"), M.quantile_rank(F.col("v"), 0.95, "truncate").alias("p95_truncate"), F.round(M.quantile_rank(F.col("v"), 0.95, "linear"), 6).alias("p95_linear"))


def a25(spark, d):
    t = F.col("text")
    s = table(spark, d, "documents").agg(F.count("*").alias("rows"), F.count_if(F.trim(t) == "").alias("empty"), (F.count("*") - F.count_distinct(F.sha2(t, 256))).alias("duplicates"))
    return s.select("rows", "empty", "duplicates", ((F.col("empty") == 0) & (F.col("duplicates") <= F.col("rows") * 0.2)).alias("passed"))


def w1(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderstatus", 1, "No change").over(w).alias("previous"))


def w2(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.round(100 * F.log(F.col("o_totalprice") / F.lag("o_totalprice").over(w)), 6).alias("log_return"))


def w3(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    full = F.count("*").over(w) == 3
    return table(spark, d, "orders").select("o_orderkey", F.when(full, F.round(F.avg("o_totalprice").over(w), 4)).alias("mean"), F.when(full, F.round(F.stddev_samp("o_totalprice").over(w), 4)).alias("sd"))


def w4(spark, d):
    v = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_totalprice"))
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, d, "orders").select("o_orderkey", F.last(v, ignorenulls=True).over(w).alias("previous_valid"))


def w5(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.midrank(F.col("l_quantity"), ["l_returnflag"]).alias("midrank"))


def w6(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.avg("l_quantity").over(w), 6).alias("running"))


def w7(spark, d):
    w = W.partitionBy("user_id").orderBy("event_type", F.desc("ts"), "event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id")


def w8(spark, d):
    return table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


def l1(spark, d):
    return table(spark, d, "customer").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").select("c_custkey")


def l2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.orderBy("o_orderkey").limit(10).union(o.orderBy(F.desc("o_orderkey")).limit(10))


def l3(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("top"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("bottom"))


def l4(spark, d):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_tax", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_partkey")


def set1(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


def set2(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    rows = [(a.intersect(b), "both"), (a.subtract(b), "left"), (b.subtract(a), "right")]
    out = [x.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for x, n in rows]
    return out[0].union(out[1]).union(out[2])


def set3(spark, d):
    words = F.split("o_orderpriority", "")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_distinct(words), "").alias("letters"))


QUERIES = {
    "a1_value_counts": a1, "a2_count_distinct": a2, "a3_flag_counter": a3, "a4_two_stage_mean": a4, "a5_equal_weight_summary": a5, "a6_quantiles": a6, "a7_mode": a7, "a8_accuracy_by_target": a8,
    "a9_exact_match": a9, "a10_confusion": a10, "a11_classification_metrics": a11, "a12_probability_metrics": a12, "a13_conditional_distribution": a13, "a14_pivot": a14, "a15_correlation": a15,
    "a16_error_metrics": a16, "a17_k_stability": a17, "a18_standardize": a18, "a19_news_shock": a19, "a20_weekly_mean": a20, "a21_completeness": a21, "a22_leave_one_out_mean": a22, "a23_leave_year_out": a23,
    "a24_token_stats": a24, "a25_release_quality": a25, "w1_lag_default": w1, "w2_log_return": w2, "w3_rolling": w3, "w4_previous_valid": w4, "w5_midrank": w5, "w6_running_mean": w6, "w7_first_per_group": w7,
    "w8_last_per_month": w8, "l1_multi_key_sort": l1, "l2_head_tail": l2, "l3_top_per_group": l3, "l4_best_candidate": l4, "set1_union_by_name": set1, "set2_key_sets": set2, "set3_ordered_unique": set3,
}

_W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"

ORACLE_SQL = {
    "a1_value_counts": "SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "a2_count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL",
    "a3_flag_counter": "SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN contains(text, '@') THEN 'at' END, CASE WHEN contains(text, '|') THEN 'pipe' END]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY ALL",
    "a4_two_stage_mean": "SELECT l_returnflag, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY ALL",
    "a5_equal_weight_summary": "SELECT event_type, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_samp(m), 6) AS sd, count(m) AS units, sum(off)::BIGINT AS excluded FROM (SELECT event_type, user_id, avg(v) AS m, count(*) FILTER (WHERE v IS NULL) AS off FROM (SELECT *, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY ALL) GROUP BY ALL",
    "a6_quantiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.025), 4) AS low, round(quantile_cont(o_totalprice, 0.5), 4) AS mid, round(quantile_cont(o_totalprice, 0.975), 4) AS high FROM orders GROUP BY ALL",
    "a7_mode": "SELECT o_custkey, o_orderstatus AS mode FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1",
    "a8_accuracy_by_target": f"SELECT truth, round(avg((truth = guess)::INT), 6) AS accuracy FROM {_GUESS} GROUP BY ALL UNION ALL SELECT 'all', round(avg((truth = guess)::INT), 6) FROM {_GUESS}",
    "a9_exact_match": f"SELECT count(*) AS n, count(*) FILTER (WHERE guess = '') AS invalid, count(*) FILTER (WHERE truth = guess) AS exact FROM {_GUESS}",
    "a10_confusion": f"SELECT truth, count(*) FILTER (WHERE guess = 'F') AS F, count(*) FILTER (WHERE guess = 'O') AS O, count(*) FILTER (WHERE guess = 'P') AS P FROM {_GUESS} WHERE guess <> '' GROUP BY ALL",
    "a11_classification_metrics": f"WITH g AS (SELECT * FROM {_GUESS}), s AS (SELECT l, count(*) FILTER (WHERE truth = l AND guess = l) AS tp, count(*) FILTER (WHERE truth = l) AS t, count(*) FILTER (WHERE guess = l) AS q FROM g, (VALUES ('F'), ('O'), ('P'), ('none')) v(l) GROUP BY l) SELECT (SELECT count(*) FROM g) AS n, (SELECT round(avg((truth = guess)::INT), 8) FROM g) AS accuracy, round(sum(CASE WHEN t > 0 THEN tp / t ELSE 0 END) / 4, 8) AS balanced_accuracy, round(sum(CASE WHEN t + q > 0 THEN 2 * tp / (t + q) ELSE 0 END) / 4, 8) AS macro_f1 FROM s",
    "a12_probability_metrics": "SELECT count(*) AS n, round(avg(pow(a - (s = 'F')::INT, 2) + pow(a - (s = 'O')::INT, 2) + pow(k - (s = 'P')::INT, 2)), 8) AS brier, round(avg(-ln(least(greatest(p, 1e-12), 1 - 1e-12))), 8) AS log_loss, round(avg(p), 8) AS true_probability FROM (SELECT s, k, a, CASE WHEN s = 'P' THEN k ELSE a END AS p FROM (SELECT o_orderstatus AS s, ((o_orderkey % 10) / 20.0)::DOUBLE AS k, (0.5 - (o_orderkey % 10) / 40.0)::DOUBLE AS a FROM orders))",
    "a13_conditional_distribution": "SELECT o_orderstatus, o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 8) AS p FROM orders GROUP BY ALL",
    "a14_pivot": "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY ALL",
    "a15_correlation": "WITH r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT l_quantity AS x, round(l_extendedprice, 0) AS y FROM lineitem)) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg((sign(x) = sign(y))::INT), 6) AS sign_agreement FROM r",
    "a16_error_metrics": "SELECT l_returnflag, round(avg(e), 4) AS bias, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(sqrt(avg(e * e)) / stddev_samp(l_extendedprice), 4) AS scaled_rmse FROM (SELECT *, l_extendedprice - l_quantity * 1000 AS e FROM lineitem) GROUP BY ALL",
    "a17_k_stability": "SELECT k::INT AS k, round(avg(abs(g)), 6) AS mae, round(sqrt(avg(g * g)), 6) AS rmse, round(max(abs(g)), 6) AS max_drift, count(*) AS units FROM (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, avg(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) - avg(v) OVER (PARTITION BY l_orderkey) AS g FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS v FROM lineitem GROUP BY ALL)) GROUP BY k",
    "a18_standardize": "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F')",
    "a19_news_shock": "SELECT day, round(rz - 0.368 * lag(rz) OVER (PARTITION BY year(day) ORDER BY day), 4) AS shock FROM (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS rz FROM orders GROUP BY 1)",
    "a20_weekly_mean": "SELECT (d + ((3 - dayofweek(d) + 7) % 7)::INT)::DATE AS week_end, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM (SELECT o_orderdate::DATE AS d, o_totalprice FROM orders) WHERE dayofweek(d) NOT IN (0, 6) GROUP BY 1",
    "a21_completeness": "SELECT l_orderkey, count(*) AS topics, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS complete_mean, round(avg(coalesce(v, 0)), 6) AS neutral_mean FROM (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS v FROM lineitem) GROUP BY ALL",
    "a22_leave_one_out_mean": "SELECT c_nationkey, round(min(l), 4) AS low, round(max(l), 4) AS high, bool_and(sign(l) = sign(m)) AS sign_stable FROM (SELECT c_nationkey, (sum(c_acctbal) OVER w - c_acctbal) / nullif(count(*) OVER w - 1, 0) AS l, avg(c_acctbal) OVER w AS m FROM customer WINDOW w AS (PARTITION BY c_nationkey)) GROUP BY ALL",
    "a23_leave_year_out": "SELECT y.year::INT AS year, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y JOIN lineitem ON year(l_shipdate) <> y.year GROUP BY ALL",
    "a24_token_stats": "SELECT lang, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1]::INT AS p95_round, v[floor((len(v) - 1) * 0.95)::INT + 1]::INT AS p95_truncate, round(q, 6) AS p95_linear FROM (SELECT lang, list_sort(list(length(text))) AS v, quantile_cont(length(text), 0.95) AS q FROM documents GROUP BY lang)",
    "a25_release_quality": "SELECT rows, empty, duplicates, empty = 0 AND duplicates <= rows * 0.2 AS passed FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) - count(DISTINCT text) AS duplicates FROM documents)",
    "w1_lag_default": f"SELECT o_orderkey, lag(o_orderstatus, 1, 'No change') OVER {_W}) AS previous FROM orders",
    "w2_log_return": f"SELECT o_orderkey, round(100 * ln(o_totalprice / lag(o_totalprice) OVER {_W})), 6) AS log_return FROM orders WHERE o_totalprice > 0",
    "w3_rolling": f"SELECT o_orderkey, CASE WHEN count(*) OVER w = 3 THEN round(avg(o_totalprice) OVER w, 4) END AS mean, CASE WHEN count(*) OVER w = 3 THEN round(stddev_samp(o_totalprice) OVER w, 4) END AS sd FROM orders WINDOW w AS {_W} ROWS 2 PRECEDING)",
    "w4_previous_valid": f"SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END IGNORE NULLS) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_valid FROM orders",
    "w5_midrank": "SELECT l_orderkey, l_linenumber, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0)::DOUBLE AS midrank FROM lineitem",
    "w6_running_mean": "SELECT l_orderkey, l_linenumber, l_partkey, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 6) AS running FROM lineitem",
    "w7_first_per_group": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts DESC, event_id) = 1",
    "w8_last_per_month": "SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderkey AS last_order FROM orders QUALIFY row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "l1_multi_key_sort": "SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    "l2_head_tail": "(SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 10) UNION ALL (SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 10)",
    "l3_top_per_group": "SELECT c_nationkey, last(c_custkey ORDER BY c_acctbal, c_custkey) AS top, first(c_custkey ORDER BY c_acctbal, c_custkey) AS bottom FROM customer GROUP BY ALL",
    "l4_best_candidate": "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_tax, l_linenumber, l_partkey) = 1",
    "set1_union_by_name": "SELECT c_custkey AS key, c_name AS name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
    "set2_key_sets": "SELECT 'both' AS part, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS n UNION ALL SELECT 'left', (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) UNION ALL SELECT 'right', (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer))",
    "set3_ordered_unique": "SELECT o_orderkey, list_reduce(string_split(o_orderpriority, ''), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || x END) AS letters FROM orders",
}
