"""Queries of fitted and published decision baselines, stage plans and report snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as B
from ..operators import stages as S
from ..session import table
from ..sources import files

CLASSES = ["cut", "hold", "hike"]


def _inputs():
    k = F.col("o_orderkey")
    return (k % 9 - 4) / 8.0, (k % 41 - 20) / 10.0, k % 53, k % 3 != 0


def b6(spark, d):
    """Hazard of a change and probabilities of its five sizes, over previous changes, spreads and durations by id."""
    previous, spread, weeks, meeting = _inputs()
    hazard = B.change_hazard(weeks, spread, meeting)
    rows = table(spark, d, "orders").select("o_orderkey", F.round(hazard, 8).alias("hazard"), B.action_probabilities(hazard, previous, spread).alias("p"))
    return rows.select("o_orderkey", "hazard", *(F.round(F.col("p")[k], 8).alias(name) for k, name in enumerate(("cut_50", "cut_25", "hold", "hike_25", "hike_50"))))


def _labelled(spark, d):
    """Classes that follow price and date loosely, so that a fit has something to find and no class is certain."""
    noise = F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 250.0 - 2
    x1, x2 = F.col("o_totalprice") / 100000, F.dayofyear("o_orderdate") / 366.0
    score = x1 - 2 * x2 + noise
    label = F.when(score < -0.8, "cut").when(score > 1.2, "hike").otherwise("hold")
    return table(spark, d, "orders").select("o_orderkey", x1.alias("x1"), x2.alias("x2"), label.alias("label"))


def b4_probit(spark, d):
    rows = _labelled(spark, d)
    beta, cuts = B.fit_ordered_probit(rows, "label", CLASSES, ["x1", "x2"])
    p = rows.select("o_orderkey", "label", B.ordered_probit_probabilities(["x1", "x2"], beta, cuts).alias("p"))
    return p.select("o_orderkey", "label", *(F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(CLASSES)))


def b4_forest(spark, d):
    rows = _labelled(spark, d)
    train, test = rows.where("o_orderkey % 4 <> 0"), rows.where("o_orderkey % 4 = 0")
    p = B.cumulative_forest(train, test, "label", CLASSES, ["x1", "x2"], trees=50)
    return p.select("o_orderkey", "label", *(F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(CLASSES)))


def e7(spark, d):
    """A plan of 25 stages with an unknown need and a cycle; some are sealed, two of them over what has changed since."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("stage"), F.col("n_name").alias("content"))
    needs = F.array_compact(F.array(F.when(F.col("stage") > 0, F.floor(F.col("stage") / 2)), F.when(F.col("stage") > 4, F.col("stage") - 3), F.when(F.col("stage") == 16, 99), F.when(F.col("stage") == 19, 21)))
    edges = n.select("stage", F.explode(needs.cast("array<int>")).alias("needs"))
    first = S.plan_stages(n.withColumn("sealed", F.lit(None).cast("string")), edges).where("stage < 6 or stage in (8, 9)").select("stage", F.when(F.col("stage").isin(4, 9), F.lit("changed")).otherwise(F.col("seal")).alias("sealed"))
    return S.plan_stages(n.join(first, "stage", "left"), edges)


def e5(spark, d):
    """A release of three splits against a manifest with a wrong count, a wrong hash, another schema and a split that is not there."""
    rows = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", F.length("o_orderpriority").alias("tokens"))
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(rows.columns))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    true = rows.groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("hash"))
    is_f, is_o = F.col("split") == "F", F.col("split") == "O"
    stated = true.where("split <> 'P'").select("split", (F.col("rows") + F.when(is_f, 1).otherwise(0)).alias("rows"), F.when(is_o, "0").otherwise(F.col("hash")).alias("hash"), F.when(is_o, "o_orderkey").otherwise(",".join(sorted(rows.columns))).alias("columns"))
    extra = spark.createDataFrame([("X", 5, "1", "o_orderkey")], "split string, rows long, hash string, columns string")
    return S.release_faults(rows, stated.unionByName(extra), "o_orderstatus", "o_orderkey", "tokens", 14)


def s22(spark, d):
    """Two report tables as a SQLite snapshot that is written, read and asked in SQL."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("audited"), F.count_if(F.col("c_acctbal") > 0).alias("passed"))
    report = c.select("c_nationkey", "audited", "passed", F.when(F.col("c_nationkey") % 5 != 0, F.col("passed") / F.col("audited")).alias("rate"))
    at = files.scratch(spark)
    files.sqlite_snapshot({"headline": report}).write.parquet(f"{at}/snapshot")
    return files.sqlite_rows(spark.read.parquet(f"{at}/snapshot"), "SELECT c_nationkey AS nation, audited, audited - passed AS failed, round(rate, 6) AS rate FROM headline WHERE passed > 0", "nation long, audited long, failed long, rate double")


QUERIES = {"b4_ordered_probit": b4_probit, "b4_ordinal_forest": b4_forest, "b6_hazard_actions": b6, "e5_release_faults": e5, "e7_stage_plan": e7, "s22_sqlite_snapshot": s22}


def _normal(x: str) -> str:
    """The normal distribution by Simpson's rule, apart from the approximation that the engine uses."""
    h = f"(({x}) / 2000)"
    inner = f"list_sum(list_transform(range(1, 2000), lambda i: (CASE i % 2 WHEN 1 THEN 4 ELSE 2 END) * exp(-((i * {h}) ** 2) / 2)))"
    return f"(0.5 + {h} / 3 * (1 + exp(-(({x}) ** 2) / 2) + {inner}) / sqrt(2 * pi()))"


_INDEX = f"({B.CONSTANT}::DOUBLE + {B.DURATION}::DOUBLE * weeks + ({B.MEETING_WEEK}::DOUBLE) * meeting + ({B.ABSOLUTE_SPREAD}::DOUBLE) * abs(spread))"
_NEEDS = "SELECT n_nationkey AS stage, unnest(list_filter([CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END, CASE WHEN n_nationkey > 4 THEN n_nationkey - 3 END, CASE WHEN n_nationkey = 16 THEN 99 END, CASE WHEN n_nationkey = 19 THEN 21 END], lambda x: x IS NOT NULL)) AS needs FROM nation"
_HASH = "('0x' || substring(sha256(o_orderkey || '|' || o_orderpriority || '|' || o_orderstatus || '|' || length(o_orderpriority)), 1, 12))::BIGINT"

ORACLE_SQL = {
    "b6_hazard_actions": f"WITH i AS (SELECT o_orderkey, (o_orderkey % 9 - 4) / 8.0::DOUBLE AS previous, (o_orderkey % 41 - 20) / 10.0::DOUBLE AS spread, o_orderkey % 53 AS weeks, (o_orderkey % 3 <> 0)::INT AS meeting FROM orders), x AS (SELECT *, {_INDEX} AS x, {B.MARK_PREVIOUS}::DOUBLE * previous + {B.MARK_SPREAD}::DOUBLE * spread AS eta FROM i), h AS (SELECT *, CASE WHEN weeks > 0 THEN 1 / CASE WHEN x <= 1 THEN 1.0001::DOUBLE WHEN x <= 1.1 THEN 1.0001::DOUBLE + 0.2::DOUBLE * (x - 1) ** 2 / (0.01::DOUBLE + (x - 1) ** 2) ELSE x + 0.0001::DOUBLE END END AS h FROM x), e AS (SELECT eta, {', '.join(f'{_normal(f"({t})::DOUBLE - eta")} AS c{k}' for k, t in enumerate(B.MARK_THRESHOLDS))} FROM (SELECT DISTINCT eta FROM h)) SELECT o_orderkey, round(h, 8) AS hazard, round(h * c0, 8) AS cut_50, round(h * (c1 - c0), 8) AS cut_25, round(h * (c2 - c1) + 1 - h, 8) AS hold, round(h * (c3 - c2), 8) AS hike_25, round(h * (1 - c3), 8) AS hike_50 FROM h JOIN e USING (eta)",
    "e5_release_faults": f"WITH f AS (SELECT o_orderstatus AS split, count(*) AS n, count(DISTINCT o_orderkey) AS ids, sum({_HASH})::VARCHAR AS hash, max(length(o_orderpriority)) AS most FROM orders GROUP BY ALL), m AS (SELECT split, CASE split WHEN 'F' THEN n + 1 ELSE n END AS rows, CASE split WHEN 'O' THEN '0' ELSE hash END AS stated, split <> 'O' AS same FROM f WHERE split <> 'P' UNION ALL SELECT 'X', 5, '1', false) SELECT coalesce(m.split, f.split) AS split, coalesce(n, 0) AS rows, array_to_string(list_filter([CASE WHEN m.rows IS NULL THEN 'unexpected split' END, CASE WHEN n IS NULL THEN 'missing split' END, CASE WHEN m.rows <> n THEN 'row count' END, CASE WHEN ids <> n THEN 'repeated id' END, CASE WHEN stated <> hash THEN 'hash' END, CASE WHEN NOT same THEN 'schema' END, CASE WHEN most > 14 THEN 'tokens' END], lambda x: x IS NOT NULL), ',') AS faults FROM m FULL JOIN f ON m.split = f.split",
    "e7_stage_plan": f"WITH RECURSIVE e AS ({_NEEDS}), c AS (SELECT * FROM e UNION SELECT c.stage, e.needs FROM c JOIN e ON c.needs = e.stage), f AS (SELECT k AS stage, name, count(needs) AS n, coalesce(bool_or(needs = 99), false) AS unknown, coalesce(bool_or(needs = k), false) AS cycle, coalesce(bool_or(needs IN (SELECT stage FROM c WHERE stage = needs)), false) AS behind, sha256(array_to_string(list_concat([k || '=' || name], coalesce(list(DISTINCT needs || CASE WHEN p.n_name IS NULL THEN '' ELSE '=' || p.n_name END ORDER BY needs || CASE WHEN p.n_name IS NULL THEN '' ELSE '=' || p.n_name END) FILTER (WHERE needs IS NOT NULL), [])), chr(10))) AS seal FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) LEFT JOIN c ON c.stage = k LEFT JOIN nation p ON p.n_nationkey = needs GROUP BY k, name), o AS (SELECT *, CASE WHEN unknown OR cycle OR behind THEN 'invalid' WHEN stage IN (4, 9) THEN 'stale' WHEN stage < 6 OR stage = 8 THEN 'sealed' END AS own FROM f), w AS (SELECT e.stage, bool_or(coalesce(o.own, '') <> 'sealed') AS waits FROM e JOIN o ON o.stage = e.needs GROUP BY e.stage) SELECT o.stage::INT AS stage, row_number() OVER (ORDER BY n, o.stage)::INT AS position, seal, coalesce(own, CASE WHEN coalesce(waits, false) THEN 'blocked' ELSE 'ready' END) AS state, array_to_string(list_filter([CASE WHEN unknown THEN 'unknown need' END, CASE WHEN cycle THEN 'cycle' END], lambda x: x IS NOT NULL), ',') AS faults FROM o LEFT JOIN w USING (stage)",
    "s22_sqlite_snapshot": "SELECT c_nationkey::BIGINT AS nation, count(*) AS audited, count(*) FILTER (WHERE NOT c_acctbal > 0) AS failed, CASE WHEN c_nationkey % 5 <> 0 THEN round(count(*) FILTER (WHERE c_acctbal > 0) / count(*), 6) END AS rate FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (WHERE c_acctbal > 0) > 0",
}
