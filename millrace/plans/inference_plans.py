"""Queries of resampling, tests, regressions, decision baselines, evidence rules and the further selections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import splits as S
from ..operators.stages import reached
from ..session import table


def _effects(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") - 4500.0).alias("effect"))


def i1(spark, d):
    return I.one_sample_t(_effects(spark, d), ["c_nationkey"], "effect").select("c_nationkey", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"))


def i9(spark, d):
    draws = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: (k * 7 + F.col("c_custkey")) % 41 - F.lit(12.0))
    c = table(spark, d, "customer").select("c_custkey", draws.alias("draws"))
    return c.select("c_custkey", F.round(I.bootstrap_p(F.col("draws")), 8).alias("p"), F.round(I.null_centred_p(F.col("draws"), F.lit(9.0)), 8).alias("p_null"))


def i10(spark, d):
    """Nations have few suppliers and all their sign masks; regions have more and fixed draws."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey").withColumn("v", F.round(F.col("s_acctbal") - 4000, 2))
    both = s.select(F.concat(F.lit("nation "), "s_nationkey").alias("panel"), "s_suppkey", "v").unionByName(s.select(F.concat(F.lit("region "), "n_regionkey").alias("panel"), "s_suppkey", "v"))
    return I.sign_flip(both, "panel", "s_suppkey", "v", exact_upto=10, draws=200).select("panel", F.round("p", 8).alias("p"), "masks")


def i11(spark, d):
    o = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 9 == 0, None).otherwise((F.col("c_custkey") % 97) / 970.0).alias("p"))
    return I.holm(o, "p", ["c_nationkey"], ["c_custkey"]).select("c_custkey", F.round("p_adjusted", 10).alias("p_adjusted"))


def i12(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    a, b = m.where("l_returnflag = 'A'"), m.where("l_returnflag = 'N'").select("l_suppkey", F.col("m").alias("parent"))
    return a.join(b, "l_suppkey").agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("m") - F.col("parent")), 8).alias("contrast"))


def i13(spark, d):
    li = table(spark, d, "lineitem").withColumn("row", F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey"))
    return I.ols(li, "l_returnflag", "l_extendedprice", ["l_quantity", "l_discount"], "row", lags=4)


def i14(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"), F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"))
    return li.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _p(spark, d):
    k = F.col("o_orderkey")
    a, b = (k % 5) / 10.0, (k % 4) / 10.0
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.array(a, b, F.lit(1.0) - a - b).alias("p"))


def b2(spark, d):
    o = table(spark, d, "orders")
    majority = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("majority"))
    lag = F.lag("o_orderstatus", 1, "O").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    both = o.withColumn("lag1", lag).join(F.broadcast(majority))
    return both.agg(F.round(F.avg((F.col("majority") == F.col("o_orderstatus")).cast("double")), 8).alias("majority"), F.round(F.avg((F.col("lag1") == F.col("o_orderstatus")).cast("double")), 8).alias("lag1"))


def b3(spark, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice"), F.month("o_orderdate").cast("double").alias("month"))
    o = Imputer(inputCols=["o_totalprice", "month"], outputCols=["x1", "x2"]).fit(o).transform(o)
    o = VectorAssembler(inputCols=["x1", "x2"], outputCol="raw").transform(o)
    o = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(o).transform(o)
    o = StringIndexer(inputCol="o_orderstatus", outputCol="label", stringOrderType="alphabetAsc").fit(o).transform(o)
    fit = LogisticRegression(family="multinomial", regParam=0.01, maxIter=30).fit(o)
    return fit.transform(o).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


def b5(spark, d):
    # Two cumulative probabilities in order: where they cross, both become their mean.
    a, b = F.col("p")[0], F.col("p")[0] + F.col("p")[1] - 0.35
    low, high = F.when(a <= b, a).otherwise((a + b) / 2), F.when(a <= b, b).otherwise((a + b) / 2)
    return _p(spark, d).select("o_orderkey", F.round(low, 8).alias("cut"), F.round(high - low, 8).alias("hold"), F.round(1 - high, 8).alias("hike"))


def b7(spark, d):
    day, n = F.dayofmonth("o_orderdate"), F.dayofmonth(F.last_day("o_orderdate"))
    monthly, current = 5 + (F.col("o_orderkey") % 40) / 100.0, F.lit(5.1)
    post = (n * monthly - day * current) / (n - day)
    o = table(spark, d, "orders").where(n > day).select("o_orderkey", (F.round(100 * (post - current), 6) + 0.0).alias("bp"))
    return o.select("o_orderkey", "bp", I.move_probabilities(F.col("bp")).alias("m")).select("o_orderkey", "bp", "m.low", F.round("m.p_low", 8).alias("p_low"), F.round("m.p_high", 8).alias("p_high"))


def b8(spark, d):
    return _p(spark, d).select("o_orderkey", I.argmax_label(["cut", "hold", "hike"], F.col("p")).alias("label"))


def b11(spark, d):
    p = F.array(F.lit(1.0) + F.col("o_orderkey") % 3, F.lit(2.0), F.col("o_orderkey") % 5 + F.lit(0.0))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    o = table(spark, d, "orders").select("o_orderstatus", (p[0] / total).alias("a"), (p[2] / total).alias("c"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("a"), 8).alias("cut"), F.round(F.avg("c"), 8).alias("hike"))


def b12(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("leaks"))


def e1(spark, d):
    o = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_totalprice"), "l_orderkey", "left")
    reason = F.when(F.col("o_orderdate").isNull(), "unknown order").when(F.col("l_shipdate") < F.col("o_orderdate"), "before cutoff").when(F.col("l_extendedprice") > F.col("o_totalprice"), "above total")
    return o.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def e2(spark, d):
    # Facts k depend on k div 2; missing roots spread to everything above them, round by round.
    facts = table(spark, d, "customer").select(F.col("c_custkey").alias("fact"), F.floor(F.col("c_custkey") / 2).alias("operand"))
    return reached(facts, "operand", "fact", facts.where("fact % 10 = 3").select("fact")).agg(F.count("*").alias("missing"), F.sum("fact").alias("total"))


def e4(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.xxhash64("c_name", "c_nationkey").alias("h"))
    b = table(spark, d, "customer").select("c_custkey", F.xxhash64("c_name", F.when(F.col("c_custkey") % 20 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))).alias("h"))
    return a.exceptAll(b).select("c_custkey")


def e6(spark, d):
    want = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("expected"))
    have = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("actual"))
    return want.join(have, "source", "left").select("source", "expected", F.coalesce("actual", F.lit(0)).alias("actual"), (F.coalesce("actual", F.lit(0)) >= F.col("expected")).alias("complete"))


def x4(spark, d):
    o = table(spark, d, "orders")
    a, b = F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 3 == 1
    n = o.groupBy("o_orderpriority").agg(F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"), F.count_if(a & b).alias("n_both")).withColumn("p", I.mcnemar(F.col("a_only"), F.col("b_only")))
    out = I.holm(n.withColumn("panel", F.lit(1)), "p", ["panel"], ["o_orderpriority"])
    return out.select("o_orderpriority", "a_only", "b_only", "n_both", F.round("p", 8).alias("p"), F.round("p_adjusted", 8).alias("p_adjusted"))


def x6(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("step")).agg(F.avg("value").alias("m"))
    w = W.orderBy("step").rowsBetween(-4, 0)
    return s.select("step", F.round(F.avg("m").over(w), 6).alias("mean"), F.when(F.count("*").over(w) == 5, F.round(F.stddev_samp("m").over(w) / F.sqrt(F.lit(5.0)), 6)).alias("se"))


def x7(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    w = W.partitionBy("o_orderpriority").orderBy("month")
    out = o.select("o_orderpriority", "month", "v", *(F.round(F.col("v") - F.lag("v", k).over(w), 2).alias(f"change_{k}") for k in (1, 3, 6, 12)), F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("month"))).alias("rn"))
    return out.where("rn = 1").drop("rn")


def x9(spark, d):
    return S.quota_midpoints(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey")


def x12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    w = W.partitionBy("lang")
    ranked = docs.withColumn("rn", F.row_number().over(w.orderBy("chars", "doc_id")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rn") == F.floor((F.col("n") - 1) / 2)).select("lang", "doc_id")


def x14(spark, d):
    key = F.struct((F.col("c_acctbal") > 0).alias("eligible"), F.round("c_acctbal", -3).alias("reward"), (-F.col("c_nationkey")).alias("cap"), (-F.col("c_custkey")).alias("step"))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", key).alias("winner"))


def x15(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"), F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("winner"), F.max(F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal"))).alias("fixed"), F.max_by("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.struct("s_acctbal", "s_suppkey"))).alias("fixed_key"))
    return s.select("s_nationkey", F.when(F.col("fixed") >= F.col("best") * 0.95, F.col("fixed_key")).otherwise(F.col("winner")).alias("selected"))


def x18(spark, d):
    """Numbers of whole texts against those of a rewritten one, as multisets: how many are missing and how many new."""
    numbers = lambda c: F.explode(F.regexp_extract_all(c, F.lit(r"([-+]?\d+)"), F.lit(1)))
    c = table(spark, d, "documents").select("doc_id", "text", F.replace(F.replace("text", F.lit("17"), F.lit("18")), F.lit("-"), F.lit(" ")).alias("again"))
    a = c.select("doc_id", numbers("text").alias("v")).groupBy("doc_id", "v").agg(F.count("*").alias("a"))
    b = c.select("doc_id", numbers("again").alias("v")).groupBy("doc_id", "v").agg(F.count("*").alias("b"))
    n, m = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return a.join(b, ["doc_id", "v"], "full").groupBy("doc_id").agg(F.sum(F.greatest(n - m, F.lit(0))).alias("missing"), F.sum(F.greatest(m - n, F.lit(0))).alias("unsupported"))


def x21(spark, d):
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Raise ").when(F.col("o_orderkey") % 3 == 1, "Cut ").otherwise("Hold "), (F.col("o_orderkey") % 5 * 25).cast("string"), F.lit("bp"))
    m = lambda k: F.regexp_extract(raw, r"^(Raise|Cut) (25|50|75|100)bp$", k)
    return table(spark, d, "orders").select("o_orderkey", F.nullif(m(1), F.lit("")).alias("direction"), F.nullif(m(2), F.lit("")).cast("int").alias("bp"))


def x22(spark, d):
    train = table(spark, d, "orders").where("year(o_orderdate) < 1996").select("o_custkey").distinct()
    test = table(spark, d, "orders").where("year(o_orderdate) >= 1996")
    return test.join(train, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("overlap"))


def x24(spark, d):
    raw = F.concat(F.lit("rates rose [E12], then fell [E3; E4]. "), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace(raw, r"\s*\[E\d+(?:; E\d+)*\]", "").alias("clean"))


QUERIES = {
    "i1_one_sample_t": i1, "i9_bootstrap_p": i9, "i10_sign_flip": i10, "i11_holm": i11, "i12_contrast": i12, "i13_ols_hac": i13, "i14_ols_slope": i14,
    "b2_majority_lag": b2, "b3_multinomial_logit": b3, "b5_isotonic": b5, "b7_futures_moves": b7, "b8_argmax": b8, "b11_market_normalize": b11, "b12_information_set": b12,
    "e1_point_in_time": e1, "e2_missing_operands": e2, "e4_overlay_diff": e4, "e6_resume_state": e6,
    "x4_mcnemar": x4, "x6_trailing_se": x6, "x7_series_changes": x7, "x9_midpoint_quota": x9, "x12_median_rank": x12, "x14_ranked_candidate": x14, "x15_tolerance_winner": x15, "x18_number_multiset": x18, "x21_label_move": x21, "x22_train_overlap": x22, "x24_strip_evidence": x24,
}

_P = "(SELECT o_orderkey, (o_orderkey % 5) / 10 AS a, (o_orderkey % 4) / 10 AS b, 1 - (o_orderkey % 5) / 10 - (o_orderkey % 4) / 10 AS c FROM orders)"
_NUM = lambda s: f"unnest(regexp_extract_all({s}, '[-+]?[0-9]+'))"

_REWRITTEN = "replace(replace(text, '17', '18'), '-', ' ')"

ORACLE_SQL = {
    "x4_mcnemar": "WITH n AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_custkey % 3 <> 1) AS a_only, count(*) FILTER (WHERE o_custkey % 3 = 1 AND o_orderkey % 3 <> 0) AS b_only, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_custkey % 3 = 1) AS n_both FROM orders GROUP BY ALL), t AS (SELECT o_orderpriority, a_only + b_only AS n, unnest(range(0, least(a_only, b_only) + 1)) AS i FROM n), p AS (SELECT o_orderpriority, least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) AS p FROM t GROUP BY ALL), h AS (SELECT *, least(1, p * (count(*) OVER () + 1 - row_number() OVER (ORDER BY p, o_orderpriority))) AS q FROM n JOIN p USING (o_orderpriority)) SELECT o_orderpriority, a_only, b_only, n_both, round(p, 8) AS p, round(max(q) OVER (ORDER BY p, o_orderpriority), 8) AS p_adjusted FROM h",
    "x15_tolerance_winner": "WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS r, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 5 = 0) DESC, s_acctbal DESC, s_suppkey DESC) AS f FROM supplier), b AS (SELECT s_nationkey, max(s_acctbal) FILTER (WHERE r = 1) AS best, max(s_suppkey) FILTER (WHERE r = 1) AS winner, max(s_acctbal) FILTER (WHERE f = 1 AND s_suppkey % 5 = 0) AS fixed, max(s_suppkey) FILTER (WHERE f = 1 AND s_suppkey % 5 = 0) AS k FROM s GROUP BY ALL) SELECT s_nationkey, CASE WHEN fixed >= best * 0.95 THEN k ELSE winner END AS selected FROM b",
    "b7_futures_moves": "WITH o AS (SELECT o_orderkey, day(o_orderdate) AS d, day(last_day(o_orderdate)) AS n, 5 + (o_orderkey % 40) / 100 AS m FROM orders), p AS (SELECT o_orderkey, round(100 * ((n * m - d * 5.1::DOUBLE) / (n - d) - 5.1::DOUBLE), 6) + 0 AS bp FROM o WHERE n > d), q AS (SELECT o_orderkey, bp, greatest(-100, least(100, bp)) AS w FROM p) SELECT o_orderkey, bp, (floor(w / 25) * 25)::INT AS low, round(1 - (w - floor(w / 25) * 25) / 25, 8) AS p_low, round((w - floor(w / 25) * 25) / 25, 8) AS p_high FROM q",
    "i1_one_sample_t": "SELECT c_nationkey, count(*) AS n, round(avg(e), 6) AS mean, CASE WHEN stddev_samp(e) <> 0 THEN round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 6) END AS t FROM (SELECT c_nationkey, c_acctbal - 4500 AS e FROM customer) GROUP BY ALL",
    "i9_bootstrap_p": "SELECT c_custkey, round(least(1.0, 2 * (least(len(list_filter(d, lambda x: x <= 0)), len(list_filter(d, lambda x: x >= 0))) + 1) / 41), 8)::DOUBLE AS p, round((1 + len(list_filter(d, lambda x: abs(x - 9) >= 9))) / 41, 8)::DOUBLE AS p_null FROM (SELECT c_custkey, list_transform(range(1, 41), lambda k: (k * 7 + c_custkey) % 41 - 12) AS d FROM customer)",
    "i10_sign_flip": "WITH b AS (SELECT s_suppkey, s_nationkey, n_regionkey, round(s_acctbal - 4000, 2) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey), s AS (SELECT *, count(*) OVER (PARTITION BY panel) AS n, row_number() OVER (PARTITION BY panel ORDER BY s_suppkey) - 1 AS i FROM (SELECT 'nation ' || s_nationkey AS panel, s_suppkey, v FROM b UNION ALL SELECT 'region ' || n_regionkey, s_suppkey, v FROM b)), t AS (SELECT panel, n, abs(sum(v)) AS t FROM s GROUP BY ALL), e AS (SELECT panel, t, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM t WHERE n <= 10), x AS (SELECT e.panel, e.mask, any_value(t) AS t, abs(sum(CASE WHEN (e.mask & (1 << i)) = 0 THEN v ELSE -v END)) AS x FROM e JOIN s ON s.panel = e.panel GROUP BY ALL), m AS (SELECT s.panel, k, any_value(t) AS t, abs(sum(CASE WHEN substring(md5(k || ':' || s_suppkey), 1, 1) < '8' THEN v ELSE -v END)) AS x FROM s JOIN t ON t.panel = s.panel, range(0, 200) r(k) WHERE s.n > 10 GROUP BY ALL) SELECT panel, round(avg((x >= t - 1e-9)::INT), 8) AS p, count(*) AS masks FROM x GROUP BY ALL UNION ALL SELECT panel, round((1 + count(*) FILTER (WHERE x >= t - 1e-9)) / (count(*) + 1), 8), count(*) FROM m GROUP BY ALL",
    "i11_holm": "SELECT c_custkey, CASE WHEN p IS NOT NULL THEN round(max(least(1.0, (m - k) * p)) OVER (PARTITION BY c_nationkey ORDER BY k NULLS LAST ROWS UNBOUNDED PRECEDING), 10) END::DOUBLE AS p_adjusted FROM (SELECT *, count(p) OVER (PARTITION BY c_nationkey) AS m, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY c_nationkey ORDER BY p NULLS LAST, c_custkey) - 1 END AS k FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 97) / 970 END AS p FROM customer))",
    "i12_contrast": "WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT count(*) AS pairs, round(avg(a.m - b.m), 8) AS contrast FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'N'",
    "i14_ols_slope": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY ALL",
    "b2_majority_lag": "WITH m AS (SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) SELECT round(avg((o_orderstatus = s)::INT), 8) AS majority, round(avg((o_orderstatus = l)::INT), 8) AS lag1 FROM (SELECT o_orderstatus, lag(o_orderstatus, 1, 'O') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders), m",
    "b5_isotonic": f"SELECT o_orderkey, round(lo, 8)::DOUBLE AS cut, round(hi - lo, 8)::DOUBLE AS hold, round(1 - hi, 8)::DOUBLE AS hike FROM (SELECT o_orderkey, CASE WHEN a <= a + b - 0.35 THEN a ELSE (a + a + b - 0.35) / 2 END AS lo, CASE WHEN a <= a + b - 0.35 THEN a + b - 0.35 ELSE (a + a + b - 0.35) / 2 END AS hi FROM {_P})",
    "b8_argmax": f"SELECT o_orderkey, CASE WHEN (a >= g - 1e-12)::INT + (b >= g - 1e-12)::INT + (c >= g - 1e-12)::INT = 1 THEN CASE WHEN a >= g - 1e-12 THEN 'cut' WHEN b >= g - 1e-12 THEN 'hold' ELSE 'hike' END END AS label FROM (SELECT *, greatest(a, b, c) AS g FROM {_P})",
    "b11_market_normalize": "SELECT o_orderstatus, count(*) AS n, round(avg(a / (a + 2 + c)), 8) AS cut, round(avg(c / (a + 2 + c)), 8) AS hike FROM (SELECT o_orderstatus, 1 + o_orderkey % 3 AS a, o_orderkey % 5 AS c FROM orders) GROUP BY ALL",
    "b12_information_set": "SELECT count(*) AS n, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS leaks FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "e1_point_in_time": "SELECT CASE WHEN o_orderdate IS NULL THEN 'unknown order' WHEN l_shipdate < o_orderdate THEN 'before cutoff' WHEN l_extendedprice > o_totalprice THEN 'above total' ELSE 'valid' END AS reason, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL",
    "e2_missing_operands": "WITH RECURSIVE f AS (SELECT c_custkey AS fact, c_custkey // 2 AS operand FROM customer), g(fact) AS (SELECT fact FROM f WHERE fact % 10 = 3 UNION SELECT f.fact FROM f JOIN g ON f.operand = g.fact) SELECT count(*) AS missing, sum(fact)::BIGINT AS total FROM g",
    "e4_overlay_diff": "SELECT c_custkey FROM customer WHERE c_custkey % 20 = 0",
    "e6_resume_state": "SELECT source, count(*) AS expected, count(l.doc_id) AS actual, count(l.doc_id) >= count(*) AS complete FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY ALL",
    "x6_trailing_se": "SELECT step, round(avg(m) OVER w, 6) AS mean, CASE WHEN count(*) OVER w = 5 THEN round(stddev_samp(m) OVER w / sqrt(5), 6) END AS se FROM (SELECT ts::DATE AS step, avg(value) AS m FROM events GROUP BY 1) WINDOW w AS (ORDER BY step ROWS 4 PRECEDING)",
    "x7_series_changes": "SELECT * FROM (SELECT p AS o_orderpriority, month, v, round(v - lag(v, 1) OVER w, 2) AS change_1, round(v - lag(v, 3) OVER w, 2) AS change_3, round(v - lag(v, 6) OVER w, 2) AS change_6, round(v - lag(v, 12) OVER w, 2) AS change_12 FROM (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL) WINDOW w AS (PARTITION BY p ORDER BY month)) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY month DESC) = 1",
    "x9_midpoint_quota": "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k IN (n // 10, 3 * n // 10, 5 * n // 10, 7 * n // 10, 9 * n // 10)",
    "x12_median_rank": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k = (n - 1) // 2",
    "x14_ranked_candidate": "SELECT c_mktsegment, c_custkey AS winner FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal > 0 DESC, round(c_acctbal, -3) DESC, c_nationkey, c_custkey) = 1",
    "x18_number_multiset": f"WITH a AS (SELECT doc_id, v, count(*) AS a FROM (SELECT doc_id, {_NUM('text')} AS v FROM documents) GROUP BY ALL), b AS (SELECT doc_id, v, count(*) AS b FROM (SELECT doc_id, {_NUM(_REWRITTEN)} AS v FROM documents) GROUP BY ALL) SELECT doc_id, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS missing, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS unsupported FROM a FULL JOIN b USING (doc_id, v) GROUP BY ALL",
    "x21_label_move": "SELECT o_orderkey, CASE WHEN ok THEN CASE o_orderkey % 3 WHEN 0 THEN 'Raise' ELSE 'Cut' END END AS direction, CASE WHEN ok THEN (o_orderkey % 5 * 25)::INT END AS bp FROM (SELECT o_orderkey, o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 0 AS ok FROM orders)",
    "x22_train_overlap": "SELECT o_orderstatus, count(*) AS overlap FROM orders WHERE year(o_orderdate) >= 1996 AND o_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) < 1996) GROUP BY ALL",
    "x24_strip_evidence": "SELECT o_orderkey, 'rates rose, then fell. ' || o_orderpriority AS clean FROM orders",
}
