"""Queries of the remaining selections, audits and baselines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions import text as T
from ..operators import matching as M
from ..operators import splits as S
from ..operators import verification as V
from ..session import table


def b1(spark, d):
    """Feature table: as-of values of two series and the lagged action."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", F.lit(1).alias("one"))
    a = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.to_date("l_shipdate").alias("obs")).agg(F.round(F.sum("l_quantity"), 2).alias("a")).withColumn("one", F.lit(1))
    out = M.as_of(o, a, ["one"], "day", "obs", ["a"])
    return out.select("o_orderkey", "a", F.lag("o_orderstatus", 1, "No change").over(W.partitionBy(F.year("day")).orderBy("day", "o_orderkey")).alias("previous"))


def b13(spark, d):
    """Contract panel: per month the price of the h-th live contract, h 1 and 2."""
    c = table(spark, d, "lineitem").groupBy(F.last_day("l_shipdate").alias("last_trade")).agg(F.round(F.avg("l_extendedprice"), 4).alias("price"))
    w = W.orderBy("last_trade")
    return c.select(F.col("last_trade"), "price", F.lead("last_trade", 1).over(w).alias("next_trade"), F.lead("price", 1).over(w).alias("next_price"))


# What is put behind a candidate's reasoning, by the customer's key.
_DEFECTS = ["", " <|im_end|>", " It fell due to rain.", " The FOMC decided so.", " It was 12,345.75 before.", " x" * 30, " And so on"]


def e3(spark, d):
    """Customers' cards with their orders as evidence; cards and candidates have defects by id."""
    k, key = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, d, "orders")
    evidence = o.select(k.alias("card"), F.when(key % 61 == 0, "").otherwise(F.concat(F.lit("e"), key)).alias("evidence_id"), F.when(key % 47 == 0, "short").otherwise(F.sha2(key.cast("string"), 256)).alias("sha256"), F.to_date("o_orderdate").alias("observed"), F.when(key % 53 != 0, key * 1.5).alias("value"))
    c, low = F.col("c_custkey"), F.col("low")
    added = F.element_at(F.array(*map(F.lit, _DEFECTS)), (c % len(_DEFECTS) + 1).cast("int"))
    said = F.concat(F.lit("Demand rose to "), F.coalesce((low * 3 / 2).cast("decimal(18,1)").cast("string"), F.lit("nothing")), F.lit(" units in the last month of the year."))
    cards = table(spark, d, "customer").select("c_custkey").join(o.groupBy(k.alias("c_custkey")).agg(F.min(key).alias("low")), "c_custkey", "left")
    cutoff = F.when(c % 29 != 0, F.make_date(F.lit(1999), F.lit(1), F.lit(1))).alias("cutoff")
    cited = F.when(c % 7 == 0, F.array(F.lit("e-1"))).when(low.isNotNull(), F.array(F.concat(F.lit("e"), low)))
    rows = cards.select(c.alias("card"), F.concat(said, added).alias("reasoning"), F.when(c % 5 == 0, said).otherwise(F.lit("Demand rose.")).alias("final"), cited.alias("cited"), cutoff)
    got = V.verify_candidates(rows, evidence, most_reasoning=30)
    return got.select("card", F.array_join("codes", ",").alias("codes"), F.round("coverage", 8).alias("coverage"), F.size("unsupported").alias("unsupported"))


def x3(spark, d):
    a, b = F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 0
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"), F.count_if(~a & ~b).alias("neither"))


def x10(spark, d):
    """Mandatory rows first, then salted hash order, up to the quota of each cell; excluded customers never."""
    banned = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(banned, "o_custkey", "left_anti")
    order = [F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(1), F.sha2(F.concat(F.lit("salt|"), F.col("o_orderkey").cast("string")), 256)]
    ranked = o.withColumn("rn", F.row_number().over(W.partitionBy("o_orderpriority", "o_orderstatus").orderBy(*order)))
    return ranked.where("rn <= 7").select("o_orderkey", "o_orderpriority", "o_orderstatus")


def x11(spark, d):
    """Quota proportional to a topic's size, one at least; picks spread evenly over time."""
    o = table(spark, d, "orders").withColumn("n", F.count("*").over(W.partitionBy("o_orderpriority"))).withColumn("all", F.count("*").over(W.partitionBy(F.lit(1))))
    o = o.withColumn("quota", F.greatest(F.lit(1), F.floor(F.col("n") * 40 / F.col("all")))).withColumn("rn", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")) - 1)
    hit = F.floor((F.col("rn") + 1) * F.col("quota") / F.col("n")) > F.floor(F.col("rn") * F.col("quota") / F.col("n"))
    return o.where(hit).select("o_orderpriority", "o_orderkey")


def x13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    return S.quantile_rows(docs, ["lang"], [F.col("chars"), F.col("doc_id")], [0.1, 0.3, 0.5, 0.7, 0.9]).select("lang", "doc_id").distinct()


def x16(spark, d):
    raw = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " million").when(F.col("o_orderkey") % 3 == 1, " billion").otherwise(" thousand"))
    unit = F.when(raw.contains("billion"), 1e9).when(raw.contains("million"), 1e6).when(raw.contains("thousand"), 1e3).otherwise(1.0)
    return table(spark, d, "orders").select("o_orderkey", (F.regexp_extract(raw, r"(\d+)", 1).cast("double") * unit).alias("dollars"))


def x17(spark, d):
    squeeze, plain = lambda c: F.lower(T.squeeze(c)), lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    key, a = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    b = F.when(key == 0, a).when(key == 1, F.concat(F.lit("  "), F.upper(a), F.lit(" "))).when(key == 2, F.concat(F.replace(a, F.lit("-"), F.lit(", ")), F.lit("."))).when(key == 3, F.concat(a, F.lit(" x"))).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(a == b).alias("raw"), F.count_if(squeeze(a) == squeeze(b)).alias("normalized"), F.count_if(plain(a) == plain(b)).alias("unpunctuated"), F.count_if(F.contains(squeeze(b), squeeze(a))).alias("contained"))


def x19(spark, d):
    r = F.concat(F.md5("text"), F.when(F.col("conv_id") % 3 == 0, "</think>").otherwise(""), F.when(F.col("conv_id") % 4 == 0, "\n# head\n- item").otherwise(""))
    bad = F.array_compact(F.array(F.when(F.regexp_count(r, F.lit("</think>")) != 1, F.lit("delimiter")), F.when(r.rlike(r"(?m)^# "), F.lit("heading")), F.when(r.rlike(r"(?m)^- "), F.lit("list"))))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(bad, ",").alias("failures"))


def x20(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    best = n.groupBy("o_orderpriority").agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("majority"), (F.max("n") / F.sum("n")).alias("share"))
    return best.select("o_orderpriority", "majority", F.round("share", 8).alias("share"))


def x23(spark, d):
    """Scored rows and a later increment that scores some of them again: the increment's score holds."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    base = li.where("l_linenumber <= 3").select(*keys, F.col("l_quantity").alias("score"))
    more = li.where("l_linenumber >= 3").select(*keys, (F.col("l_quantity") + F.col("l_tax")).alias("score"))
    return base.join(more, keys, "left_anti").unionByName(more).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("mean"))


def r6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.repetition_penalty(F.col("text"), 4, -0.5), 8).alias("reward"))


def r10(spark, d):
    passed = (F.col("l_linenumber") % 2 == 0).cast("double")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(passed), 8).alias("pass_rate"), F.min(passed).alias("all_passed"))


def r14(spark, d):
    """Judge replies read as JSON: points over their maximum; a reply that cannot be read, or out of range, scores 0."""
    key = F.col("o_orderkey")
    reply = F.when(key % 9 == 0, "no json").when(key % 9 == 1, F.concat(F.lit('{"points": '), (key % 50).cast("string"), F.lit(', "max": 40}'))).otherwise(F.concat(F.lit('{"points": '), (key % 36).cast("string"), F.lit(', "max": 36}')))
    x = F.from_json(reply, "points double, max double")
    answer = F.when((x["points"] >= 0) & (x["points"] <= x["max"]), x["points"] / x["max"]).otherwise(0.0)
    return table(spark, d, "orders").select("o_orderkey", F.round(answer, 8).alias("answer"), F.round(0.5 * answer + 0.5 * (F.col("o_custkey") % 11) / 10.0, 8).alias("combined"))


def t26(spark, d):
    up, down = T.count_pattern(F.col("text"), r"(?i)\b(?:rose|up)\b"), T.count_pattern(F.col("text"), r"(?i)\b(?:fell|down)\b")
    pick = lambda key, words: F.element_at(F.array(*map(F.lit, words)), (F.col(key) % len(words) + 1).cast("int"))
    text = F.concat(F.lit("Prices "), pick("o_orderkey", ["rose", "fell", "held", "went UP"]), F.lit("; rates "), pick("o_custkey", ["upheld", "slid Down", "fell.", "stood", "rosey"]))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", F.when((up > 0) & (down > 0), "mixed").when(up > 0, "up").when(down > 0, "down").otherwise("none").alias("direction"))


def t29(spark, d):
    """A neutral block of as many tokens as the text has: sentences of fixed words, the last one cut to fit."""
    n = F.size(T.tokens(F.col("text")))
    words = F.array(*map(F.lit, ["no", "data", "is", "given", "here."]))
    block = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(words, ((i - 1) % 5 + 1).cast("int"))), " ")).otherwise("")
    rows = table(spark, d, "documents").select("doc_id", n.alias("n"), block.alias("block"))
    return rows.select("doc_id", (F.size(T.tokens(F.col("block"))) == F.col("n")).alias("matched"), F.length("block").alias("chars"), F.md5("block").alias("hash"))


QUERIES = {
    "b1_feature_table": b1, "b13_contract_panel": b13, "e3_candidate_codes": e3, "x3_discordance": x3, "x10_quota_fill": x10, "x11_proportional_sample": x11, "x13_length_buckets": x13,
    "x16_monetary_scale": x16, "x17_copy_metrics": x17, "x19_structure_gate": x19, "x20_majority_value": x20, "x23_increment_union": x23, "r6_repetition": r6, "r10_pass_rates": r10, "r14_judge_scores": r14, "t26_directions": t26, "t29_neutral_block": t29,
}

# The same rules over joined rows of evidence.
_E3 = f"""
WITH e AS (SELECT o_custkey AS card, CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'e' || o_orderkey END AS id, o_orderkey % 47 <> 0 AS hashed, o_orderdate::DATE AS observed, CASE WHEN o_orderkey % 53 <> 0 THEN o_orderkey * 1.5::DOUBLE END AS value, o_orderkey FROM orders),
g AS (SELECT card, min(o_orderkey) AS low, count(*) AS n, count(DISTINCT id) FILTER (WHERE id <> '') AS ids, bool_and(hashed) AS hashed, max(observed) AS last, bool_or(value IS NULL) AS blank FROM e GROUP BY ALL),
c AS (SELECT c_custkey AS card, low, n, ids, hashed, last, blank, CASE WHEN c_custkey % 29 <> 0 THEN DATE '1999-01-01' END AS cutoff, 'Demand rose to ' || coalesce((low * 1.5)::DECIMAL(18,1)::VARCHAR, 'nothing') || ' units in the last month of the year.' AS said, {[*_DEFECTS]!r}[c_custkey % {len(_DEFECTS)} + 1] AS added, CASE WHEN c_custkey % 7 = 0 THEN 'e-1' ELSE 'e' || low END AS cited FROM customer LEFT JOIN g ON card = c_custkey),
t AS (SELECT *, said || added AS r, CASE WHEN card % 5 = 0 THEN said ELSE 'Demand rose.' END AS f FROM c),
v AS (SELECT t.*, lower(' ' || r || chr(10) || f || ' ') AS whole, e.id IS NOT NULL AS found, e.value AS allowed FROM t LEFT JOIN e ON e.card = t.card AND e.id = t.cited),
u AS (SELECT *, len(list_filter([CASE WHEN low IS NOT NULL THEN low * 1.5::DOUBLE END, CASE WHEN card % {len(_DEFECTS)} = 4 THEN 12345.75 END, CASE WHEN card % 5 = 0 AND low IS NOT NULL THEN low * 1.5::DOUBLE END], lambda x: x IS NOT NULL AND NOT coalesce(abs(x - allowed) <= greatest(1e-6, abs(allowed) * 1e-6), false)))::INT AS unsupported FROM v)
SELECT card, unsupported, coalesce(round(CASE WHEN ids > 0 AND found THEN 1 / ids ELSE 0 END, 8), 0)::DOUBLE AS coverage, array_to_string(list_filter([CASE WHEN cutoff IS NULL THEN 'fact_card_invalid_cutoff' END, CASE WHEN n IS NULL THEN 'fact_card_empty_evidence' END, CASE WHEN ids < n THEN 'fact_card_duplicate_or_empty_evidence_id' END, CASE WHEN NOT hashed THEN 'fact_card_invalid_source_hash' END, CASE WHEN last > cutoff THEN 'fact_card_post_cutoff_observation' END, CASE WHEN blank THEN 'fact_card_evidence_without_numeric_value' END, CASE WHEN contains(whole, '<|im_end|>') THEN 'candidate_forbidden_model_token' END, CASE WHEN len(regexp_extract_all(r, '[A-Za-z0-9]+')) > 30 THEN 'candidate_reasoning_too_long' END, CASE WHEN cited IS NOT NULL AND NOT found THEN 'candidate_unknown_evidence_id' END, CASE WHEN unsupported > 0 THEN 'candidate_unsupported_numeric_claim' END, CASE WHEN contains(whole, 'fomc decided') THEN 'candidate_external_policy_or_event' END, CASE WHEN contains(whole, ' due to ') THEN 'candidate_unlicensed_causal_claim' END, CASE WHEN contains(r, f) AND f = said THEN 'candidate_reasoning_final_duplication' END], lambda x: x IS NOT NULL), ',') AS codes FROM u
"""

ORACLE_SQL = {
    "e3_candidate_codes": _E3,
    "r6_repetition": "SELECT doc_id, round(CASE WHEN len(g) > len(list_distinct(g)) THEN (1 - len(list_distinct(g)) / len(g)) * -0.5 ELSE 0 END, 8)::DOUBLE AS reward FROM (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) ELSE [] END AS g FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents))",
    "b1_feature_table": "WITH a AS (SELECT l_shipdate::DATE AS obs, round(sum(l_quantity), 2) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderstatus FROM orders) SELECT o_orderkey, a.a, lag(o_orderstatus, 1, 'No change') OVER (PARTITION BY year(day) ORDER BY day, o_orderkey) AS previous FROM o ASOF LEFT JOIN a ON o.day >= a.obs",
    "b13_contract_panel": "SELECT last_trade, price, lead(last_trade) OVER (ORDER BY last_trade) AS next_trade, lead(price) OVER (ORDER BY last_trade) AS next_price FROM (SELECT last_day(l_shipdate::DATE) AS last_trade, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1)",
    "x3_discordance": "SELECT o_orderstatus, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM (SELECT o_orderstatus, o_orderkey % 3 = 0 AS a, o_custkey % 2 = 0 AS b FROM orders) GROUP BY ALL",
    "x10_quota_fill": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY (o_orderkey % 50 <> 0)::INT, sha256('salt|' || o_orderkey)) <= 7",
    "x11_proportional_sample": "SELECT o_orderpriority, o_orderkey FROM (SELECT *, greatest(1, floor(n * 40 / total)) AS quota FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders)) WHERE floor((k + 1) * quota / n) > floor(k * quota / n)",
    "x13_length_buckets": "SELECT DISTINCT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) JOIN (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(q) ON k = floor(q * (n - 1) + 0.5)",
    "x16_monetary_scale": "SELECT o_orderkey, o_custkey * CASE o_orderkey % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e9 ELSE 1e3 END AS dollars FROM orders",
    "x17_copy_metrics": "WITH p AS (SELECT o_orderpriority, o_orderpriority AS a, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN '  ' || upper(o_orderpriority) || ' ' WHEN 2 THEN replace(o_orderpriority, '-', ', ') || '.' WHEN 3 THEN o_orderpriority || ' x' ELSE o_orderstatus END AS b FROM orders), q AS (SELECT *, lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) AS y FROM p) SELECT o_orderpriority, count(*) FILTER (WHERE a = b) AS raw, count(*) FILTER (WHERE x = y) AS normalized, count(*) FILTER (WHERE regexp_replace(x, '[^a-z0-9]', '', 'g') = regexp_replace(y, '[^a-z0-9]', '', 'g')) AS unpunctuated, count(*) FILTER (WHERE contains(y, x)) AS contained FROM q GROUP BY ALL",
    "x19_structure_gate": "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN conv_id % 3 <> 0 THEN 'delimiter' END, CASE WHEN conv_id % 4 = 0 THEN 'heading' END, CASE WHEN conv_id % 4 = 0 THEN 'list' END], lambda x: x IS NOT NULL), ',') AS failures FROM conversations",
    "x20_majority_value": "SELECT o_orderpriority, o_orderstatus AS majority, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 8) AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus DESC) = 1",
    "x23_increment_union": "SELECT l_linenumber, count(*) AS n, round(avg(CASE WHEN l_linenumber >= 3 THEN l_quantity + l_tax ELSE l_quantity END), 8) AS mean FROM lineitem GROUP BY ALL",
    "r10_pass_rates": "SELECT l_orderkey, round(avg((l_linenumber % 2 = 0)::INT), 8) AS pass_rate, min((l_linenumber % 2 = 0)::INT)::DOUBLE AS all_passed FROM lineitem GROUP BY ALL",
    "r14_judge_scores": "SELECT o_orderkey, round(a, 8)::DOUBLE AS answer, round(0.5 * a + 0.5 * (o_custkey % 11) / 10, 8)::DOUBLE AS combined FROM (SELECT o_orderkey, o_custkey, CASE WHEN p <= m THEN p / m ELSE 0 END AS a FROM (SELECT o_orderkey, o_custkey, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.points')::DOUBLE END AS p, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.max')::DOUBLE END AS m FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'no json' WHEN o_orderkey % 9 = 1 THEN '{\"points\": ' || (o_orderkey % 50) || ', \"max\": 40}' ELSE '{\"points\": ' || (o_orderkey % 36) || ', \"max\": 36}' END AS r FROM orders)))",
    "t26_directions": "SELECT o_orderkey, CASE WHEN u AND w THEN 'mixed' WHEN u THEN 'up' WHEN w THEN 'down' ELSE 'none' END AS direction FROM (SELECT o_orderkey, regexp_matches(t, '\\b(rose|up)\\b') AS u, regexp_matches(t, '\\b(fell|down)\\b') AS w FROM (SELECT o_orderkey, lower('Prices ' || ['rose', 'fell', 'held', 'went UP'][o_orderkey % 4 + 1] || '; rates ' || ['upheld', 'slid Down', 'fell.', 'stood', 'rosey'][o_custkey % 5 + 1]) AS t FROM orders))",
    "t29_neutral_block": "SELECT doc_id, len(regexp_extract_all(b, '[a-z0-9]+')) = n AS matched, length(b)::INT AS chars, md5(b) AS hash FROM (SELECT doc_id, n, array_to_string(list_transform(range(0, n), lambda i: ['no', 'data', 'is', 'given', 'here.'][i % 5 + 1]), ' ') AS b FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents))",
}
