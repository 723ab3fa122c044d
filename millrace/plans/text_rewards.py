"""Queries of text scalars, structured responses, rewards and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions import text as T
from ..session import table


def _c(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def _response(spark, d):
    k, t = F.col("conv_id") % 5, F.md5("text")
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n<answer>\n"), F.col("role"), F.lit("\n</answer>")))
        .when(k == 1, F.concat(F.lit("<|channel>thought\n"), t, F.lit("<channel|>"), F.col("role")))
        .when(k == 2, F.concat(t, F.lit("\n</think>\n"), F.col("role")))
        .when(k == 3, F.concat(F.lit("<think>"), t, F.lit("</think> no tags <|channel>")))
        .otherwise(F.concat(F.lit("  "), t))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", raw.alias("response"))


def t1(spark, d):
    return _response(spark, d).select("conv_id", "turn", R.parse(F.col("response")).alias("p")).select("conv_id", "turn", "p.*")


def t2(spark, d):
    return _response(spark, d).select("conv_id", "turn", R.candidate(F.col("response")).alias("candidate"))


def t3(spark, d):
    p = R.parse(F.col("response"))
    return _response(spark, d).where("conv_id % 5 = 1").select("conv_id", "turn", R.render_xml(p["reasoning"], p["answer"]).alias("xml"))


def t4(spark, d):
    p = R.parse(F.col("response"))
    return _response(spark, d).where("conv_id % 5 in (0, 2)").select("conv_id", "turn", F.length(p["reasoning"]).alias("think"), F.length(p["answer"]).alias("answer"))


def t5(spark, d):
    template = F.lit("On {day} about {topic}:\n{data}\n\n")
    out = template
    for mark, value in (("{day}", F.date_format("o_orderdate", "yyyy-MM-dd")), ("{topic}", F.col("o_orderpriority")), ("{data}", F.col("o_custkey").cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return table(spark, d, "orders").select("o_orderkey", F.concat(T.strip(out), F.lit("\n")).alias("prompt"))


def t6(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", F.struct("n_nationkey", F.concat_ws("", F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |")).alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.groupBy("n_regionkey").agg(F.concat(F.lit("| key | name |\n|-----|------|\n"), body).alias("markdown"))


def t7(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.sha1(t).alias("sha1"), F.sha2(F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"lang":"'), "lang", F.lit('"}')), 256).alias("json_hash"))


def t8(spark, d):
    title = T.strip(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("paragraphs"))


def t9(spark, d):
    paras = F.regexp_extract_all("html", F.lit(r"(?is)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(paras).alias("position", "raw"))
    text = T.squeeze(F.regexp_replace("raw", r"<[^>]*>", " "))
    return rows.select("page_id", "position", F.md5(text).alias("paragraph")).where(text != "")


def t10(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("text")), 8))).alias("g"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("text")), 8))).alias("g"))
    return docs.join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def t11(spark, d):
    c = _c(spark, d)
    a = c.where("turn = 0").select("conv_id", T.ngrams(T.tokens(F.col("text")), 2).alias("a"))
    b = c.where("turn = 1").select("conv_id", T.ngrams(T.tokens(F.col("text")), 2).alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_distinct("a")).alias("own"))


def t12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.repetition_penalty(F.col("text"), 3, -1.0), 8).alias("penalty"))


def t13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.repetition_rate(T.tokens(F.col("text")), 3), 8).alias("rate"))


def t14(spark, d):
    key = F.col("o_orderkey")
    ids = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.when(key % 4 == 0, i % 20).when(key % 4 == 1, i % 40).when(key % 4 == 2, F.when(i < 40, i + key).otherwise(i % 17)).otherwise((i * i + key) % 101))
    return table(spark, d, "orders").select("o_orderkey", T.periodic_tail(ids).alias("periodic"))


def t15(spark, d):
    rate = T.repetition_rate(T.tokens(F.col("text")), 4)
    bad = F.array_compact(F.array(F.when(rate >= 0.5, F.lit("repetition")), F.when(F.length("text") > 8000, F.lit("cap")), F.when(~F.trim("text").endswith("."), F.lit("eos"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(bad, ",").alias("failures"), (F.size(bad) == 0).alias("valid"))


_STOP = ["the", "and", "of", "to", "in", "que", "les", "der", "die"]


def t16(spark, d):
    bag = lambda c: F.array_distinct(F.filter(T.tokens(c), lambda w: (F.length(w) > 2) & ~w.isin(*_STOP)))
    c = _c(spark, d)
    a, b = c.where("turn = 0").select("conv_id", bag(F.col("text")).alias("a")), c.where("turn = 1").select("conv_id", bag(F.col("text")).alias("b"))
    return a.join(b, "conv_id").select("conv_id", F.round(T.jaccard(F.col("a"), F.col("b")), 8).alias("jaccard"))


def t20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.polarity(T.tokens(F.col("text")), ["the", "and", "que"], ["of", "les", "der"]), 8).alias("polarity"))


def t21(spark, d):
    hawk, dove, n = T.count_pattern(F.col("text"), r"\bthe\b"), T.count_pattern(F.col("text"), r"\bof\b"), F.size(T.tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.when(n > 0, F.round((hawk - dove) / n, 8)).alias("stance"))


def t22(spark, d):
    raw = F.concat(F.lit("rates of "), F.format_number(F.col("o_totalprice"), 2), F.lit(" and -3.5% or "), F.col("o_custkey").cast("string"))
    found = F.regexp_extract_all(raw, F.lit(r"([-+]?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", F.size(found).alias("n"), F.replace(found[0], F.lit(",")).cast("double").alias("first"))


def t23(spark, d):
    claims = F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"), F.lit(7.0))
    support = F.array(F.round("o_totalprice", 0), F.col("o_custkey").cast("double") + 0.005, F.col("o_orderkey").cast("double"))
    held = F.filter(claims, lambda c: F.exists(support, lambda s: F.abs(c - s) <= F.greatest(F.lit(0.01), F.abs(s) * 0.001)))
    return table(spark, d, "orders").select("o_orderkey", F.round(F.size(held) / F.size(claims), 8).alias("grounding"))


def t24(spark, d):
    v = F.col("o_totalprice").cast("decimal(18,4)")
    return table(spark, d, "orders").select("o_orderkey", (F.round(v, 1) == F.round(F.round(v, 2), 1)).alias("same"), F.round(v, 1).cast("double").alias("shown"))


def t25(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").agg(F.count_if(F.abs(v * (1 + 1e-7) - v) <= F.greatest(F.lit(1.0), F.abs(v)) * 1e-6).alias("supported"), F.count("*").alias("n"))


def t27(spark, d):
    r = F.col("response")
    ordered = (F.instr(r, "<think>") < F.instr(r, "</think>")) & (F.instr(r, "</think>") < F.instr(r, "<answer>"))
    bad = F.array_compact(F.array(F.when(~ordered, F.lit("order")), F.when(F.length(r) > 90, F.lit("long")), F.when(r.contains("channel"), F.lit("forbidden"))))
    return _response(spark, d).select("conv_id", "turn", F.array_join(bad, ",").alias("failures"))


def t28(spark, d):
    a = F.concat(F.lit("head "), F.col("o_orderpriority"), F.lit(" tail"))
    b = F.when(F.col("o_orderkey") % 4 == 0, "head  tail").when(F.col("o_orderkey") % 4 == 1, "head tail").when(F.col("o_orderkey") % 4 == 2, "head  tale").otherwise(F.concat(F.lit("head "), F.substr("o_orderpriority", F.lit(3)), F.lit(" tail")))
    n = lambda x, y: F.aggregate(F.sequence(F.lit(1), F.least(F.length(x), F.length(y))), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))), i).otherwise(s))
    prefix = n(a, b)
    suffix = F.least(n(F.reverse(a), F.reverse(b)), F.length(b) - prefix)
    whole = prefix + suffix == F.length(b)
    return table(spark, d, "orders").select("o_orderkey", whole.alias("single_deletion"), F.when(whole, F.substr(a, prefix + 1, F.length(a) - F.length(b))).alias("deleted"))


def t30(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.split_top_level(F.concat(F.lit("GDP (real, yearly), "), F.col("o_orderpriority"), F.lit(",CPI"))), "|").alias("parts"))


def t32(spark, d):
    """Windows of 64 tokens every 48 with their weight, each token counting 1 / its coverage: of two windows that share a token each has half."""
    size, stride = 64, 48
    n = F.size(T.tokens(F.col("text")))
    docs = table(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0")
    rows = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride))).alias("low")).withColumn("high", F.least(F.col("low") + size, F.col("n")))
    before = F.when(F.col("low") > 0, F.greatest(F.lit(0), F.least(F.col("low") - stride + size, F.col("n")) - F.col("low"))).otherwise(0)
    after = F.greatest(F.lit(0), F.col("high") - F.col("low") - stride)
    return rows.select("doc_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round(F.col("high") - F.col("low") - (before + after) / 2.0, 6).alias("weight"))


def t33(spark, d):
    n = T.words_count(F.col("text"))
    return table(spark, d, "documents").select(F.when(n + 200 <= 512, "fits").when(n <= 512, "no room").otherwise("too long").alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


def t34(spark, d):
    r = F.col("response")
    a, b = T.strip(F.substring_index(r, "</think>", 1)), T.strip(F.substring_index(r, "</think>", -1))
    ok = (F.regexp_count(r, F.lit("</think>")) == 1) & (a != "") & (b != "")
    return _response(spark, d).where(ok).select("conv_id", "turn", b.alias("answer"))


def t35(spark, d):
    """What becomes of a completion: cut at the length limit, without a boundary, without an answer, or scored."""
    r, p = F.col("response"), R.parse(F.col("response"))
    cut = (F.length(r) > 80) & ~r.endswith("</answer>")
    status = F.when(cut, "length").when(p["format"].isin("plain", "mixed"), "no boundary").when(p["answer"] == "", "no answer").otherwise("scored")
    return _response(spark, d).groupBy(status.alias("status"), "role").agg(F.count("*").alias("n"))


def _json(spark, d):
    k = F.col("o_orderkey") % 6
    move = F.when(k == 0, '{"direction":"hike","magnitude_bp":25}').when(k == 1, '{"direction":"cut","magnitude_bp":50}').when(k == 2, '{"direction":"hold","magnitude_bp":0}').when(k == 3, '```json\n{"direction":"hold","magnitude_bp":0}\n```').when(k == 4, '{"direction":"hike","magnitude_bp":25,"x":1}').otherwise("hike 25")
    return table(spark, d, "orders").select("o_orderkey", move.alias("completion"), F.when(F.col("o_orderstatus") == "F", "hike").when(F.col("o_orderstatus") == "O", "cut").otherwise("hold").alias("direction"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(50).alias("bp"))


def t36(spark, d):
    x = R.decision(F.col("completion"))
    return _json(spark, d).select("o_orderkey", x["direction"].alias("direction"), x["magnitude_bp"].alias("magnitude_bp"))


def r1(spark, d):
    return _response(spark, d).select("conv_id", "turn", R.format_reward(F.col("response")).alias("reward"))


def r2(spark, d):
    return _response(spark, d).select("conv_id", "turn", R.tag_count_reward(F.col("response")).alias("reward"))


def r3(spark, d):
    raw = F.concat(F.lit("First, x\n- "), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "\nFinally, y").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", F.round(R.steps_reward(raw), 8).alias("reward"))


def r4(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey")
    n = F.col("o_orderkey") % 100
    return table(spark, d, "orders").select("o_orderkey", F.round(R.length_reward(n, F.col("o_orderstatus") == "F", F.min(n).over(w), F.max(n).over(w)), 8).alias("reward"))


def r5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(R.cosine_reward(F.col("o_orderkey") % 1500, F.col("o_orderstatus") == "F", 1000), 8).alias("reward"))


def r7(spark, d):
    vote = T.boxed_vote(F.concat(F.lit("x</think>\\boxed{"), F.col("o_orderstatus"), F.lit("}")))
    return table(spark, d, "orders").agg(F.sum((vote == "F").cast("double")).alias("accuracy"), F.sum(vote.isin("F", "O").cast("double")).alias("format"))


def r8(spark, d):
    raw = F.concat(F.lit("<think>a</think><answer>"), F.when(F.col("o_orderkey") % 2 == 0, "```py\nx\n```").otherwise("x"), F.lit("</answer>"))
    p = R.parse(raw)
    return table(spark, d, "orders").select("o_orderkey", F.when(p["well_formed"] & p["answer"].rlike(r"(?s)```.*```"), 1.0).otherwise(0.0).alias("reward"))


def r11(spark, d):
    x = R.decision(F.col("completion"))
    return _json(spark, d).select("o_orderkey", F.round(R.decision_reward(x["direction"], x["magnitude_bp"], F.col("direction"), F.col("bp")), 8).alias("reward"))


def r12(spark, d):
    return _json(spark, d).select("o_orderkey", F.round(R.fenced_decision_reward(F.col("completion"), F.col("direction"), F.col("bp")), 8).alias("reward"))


def r13(spark, d):
    """The six parts from the text itself: label, words with digits, a closing stop, length, repetition and shouted words."""
    w, raw = T.tokens(F.col("text")), F.split(F.col("text"), " ")
    n = F.size(w)
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    digits = share(F.size(F.filter(w, lambda x: x.rlike("[0-9]"))))
    shout = F.size(F.filter(raw, lambda x: x.endswith("!!"))) / F.size(raw)
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    score = R.grounded(F.col("quality").cast("double"), digits, F.col("text").endswith(".").cast("double"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(600) - n) / 300.0)), 1 - T.repetition_rate(w, 3), shout)
    return docs.select("doc_id", F.round(score, 8).alias("reward"))


def r15(spark, d):
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    quote = F.concat(F.substring("text", 3, 9), F.when(F.col("doc_id") % 3 == 0, "ZZZ").otherwise(""))
    return table(spark, d, "documents").select("doc_id", squeeze(F.col("text")).contains(squeeze(quote)).alias("valid"))


def r16(spark, d):
    """Both reward versions recomputed over the same completions, and where the later one pays more or less."""
    x = R.decision(F.col("completion"))
    rows = _json(spark, d).select(F.col("direction").alias("target"), R.decision_reward(x["direction"], x["magnitude_bp"], F.col("direction"), F.col("bp")).alias("old"), R.fenced_decision_reward(F.col("completion"), F.col("direction"), F.col("bp")).alias("new"))
    change = F.col("new") - F.col("old")
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("old"), 8).alias("old"), F.round(F.avg("new"), 8).alias("new"), F.count_if(change > 0).alias("better"), F.count_if(change < 0).alias("worse"))


def r17(spark, d):
    n, rep = T.words_count(F.col("text")), T.repetition_rate(T.tokens(F.col("text")), 4)
    return table(spark, d, "documents").select("doc_id", F.round(R.concision(n, rep, 300, 600), 8).alias("concision"))


def v1(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def v2(spark, d):
    parts = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("k", "x"))
    mean = parts.groupBy("label", "k").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    return mean.select("label", "k", F.round("m", 6).alias("mean"))


def v3(spark, d):
    """Each vector, its next as the masked one, and the one after that as the target: similarities, their difference and distances."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    rows = e.join(other(1, "masked"), "vec_id").join(other(2, "target"), "vec_id")
    rows = rows.select("vec_id", R.cosine(F.col("embedding"), F.col("target")).alias("f"), R.cosine(F.col("masked"), F.col("target")).alias("m"), R.cosine(F.col("embedding"), F.col("masked")).alias("s"))
    return rows.select("vec_id", F.round(F.col("f") - F.col("m"), 6).alias("delta"), F.round(1 - F.col("f"), 6).alias("distance_full"), F.round(1 - F.col("m"), 6).alias("distance_masked"), F.round(1 - F.col("s"), 6).alias("self_distance"))


def v4(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    distinct = t.select("text").distinct().withColumn("score", F.size(T.tokens(F.col("text"))))
    return t.join(distinct, "text").select("doc_id", "score")


def v5(spark, d):
    """What a line adds to its order's largest price: the value of all lines less that of all others."""
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    li = table(spark, d, "lineitem").withColumn("place", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("l_extendedprice").over(order), F.lit(0.0)))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.when(F.col("place") == 1, F.col("l_extendedprice") - F.col("next")).otherwise(0.0), 4).alias("marginal"))


def v6(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.var_samp("l_quantity").alias("v"), F.count("*").cast("double").alias("n"))
    b = q.where("l_returnflag = 'N'").select(F.col("m").alias("bm"), F.col("v").alias("bv"), F.col("n").alias("bn"))
    j = q.where("l_returnflag <> 'N'").join(F.broadcast(b))
    se = F.col("v") / F.col("n") + F.col("bv") / F.col("bn")
    df = se * se / (F.pow(F.col("v") / F.col("n"), 2) / (F.col("n") - 1) + F.pow(F.col("bv") / F.col("bn"), 2) / (F.col("bn") - 1))
    return j.select("l_returnflag", F.round((F.col("m") - F.col("bm")) / F.col("bm") * 100, 6).alias("delta_percent"), F.round((F.col("m") - F.col("bm")) / F.sqrt(se), 6).alias("t"), F.round(df, 3).alias("df"))


QUERIES = {
    "t1_parse_response": t1, "t2_candidate": t2, "t3_render_response": t3, "t4_segments": t4, "t5_prompt_render": t5, "t6_markdown_table": t6, "t7_hashes": t7, "t8_html_fields": t8, "t9_html_paragraphs": t9,
    "t10_shared_windows": t10, "t11_ngram_overlap": t11, "t12_repetition_penalty": t12, "t13_repetition_rate": t13, "t14_periodic_tail": t14, "t15_degeneration": t15, "t16_lexical_jaccard": t16, "t20_polarity": t20,
    "t21_lexicon_stance": t21, "t22_numbers": t22, "t23_grounding": t23, "t24_display_precision": t24, "t25_numeric_support": t25, "t27_format_check": t27, "t28_single_deletion": t28, "t30_top_level_split": t30,
    "t32_window_cover": t32, "t33_token_budget": t33, "t34_answer_projection": t34, "t35_completion_policy": t35, "t36_decision_json": t36, "r1_format": r1, "r2_tag_count": r2, "r3_steps": r3, "r4_length": r4,
    "r5_cosine": r5, "r7_rate_accuracy": r7, "r8_code_format": r8, "r11_decision_v2": r11, "r12_decision_v3": r12, "r13_grounded": r13, "r15_violation_quotes": r15, "r16_reward_replay": r16, "r17_concision": r17,
    "v1_cosine": v1, "v2_mean_pooling": v2, "v3_leave_one_out": v3, "v4_distinct_text_cache": v4, "v5_marginal": v5, "v6_welch": v6,
}

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_R = "SELECT conv_id, turn, role, md5(text) AS t, conv_id % 5 AS k FROM conversations"
_GRAM = lambda w, n: f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string(list_slice({w}, i, i + {n} - 1), ' ')) ELSE [] END"
_J = "SELECT o_orderkey, o_orderkey % 6 AS k, CASE o_orderstatus WHEN 'F' THEN 'hike' WHEN 'O' THEN 'cut' ELSE 'hold' END AS td, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 50 END AS tb FROM orders"
_SCORE = lambda d, b: f"(0.05 + CASE WHEN {d} = td THEN 0.45 + 0.30 * greatest(0, 1 - abs({b} - tb) / 100) ELSE 0 END + CASE WHEN {d} = td AND {b} = tb THEN 0.2 ELSE 0 END)"
_STRICT = f"CASE k WHEN 0 THEN {_SCORE(chr(39) + 'hike' + chr(39), 25)} WHEN 1 THEN {_SCORE(chr(39) + 'cut' + chr(39), 50)} WHEN 2 THEN {_SCORE(chr(39) + 'hold' + chr(39), 0)} ELSE 0 END"

ORACLE_SQL = {
    "r17_concision": f"SELECT doc_id, round(greatest(0, least(1, (600 - n) / 300)) * (1 - least(1, 4 * CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END)), 8)::DOUBLE AS concision FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, {_GRAM('w', 4)} AS g FROM (SELECT doc_id, text, {_TOK} AS w FROM documents))",
    "t14_periodic_tail": "SELECT o_orderkey, len(list_filter(range(16, 34), lambda p: l[101 - p:100] = l[101 - 2 * p:100 - p] AND l[101 - p:100] = l[101 - 3 * p:100 - 2 * p])) > 0 AS periodic FROM (SELECT o_orderkey, list_transform(range(0, 100), lambda i: CASE o_orderkey % 4 WHEN 0 THEN i % 20 WHEN 1 THEN i % 40 WHEN 2 THEN CASE WHEN i < 40 THEN i + o_orderkey ELSE i % 17 END ELSE (i * i + o_orderkey) % 101 END) AS l FROM orders)",
    "t1_parse_response": f"SELECT conv_id, turn, CASE WHEN k IN (0, 1, 2) THEN t ELSE '' END AS reasoning, CASE WHEN k IN (0, 1, 2) THEN role WHEN k = 3 THEN '<think>' || t || '</think> no tags <|channel>' ELSE t END AS answer, ['xml', 'channel', 'boundary', 'mixed', 'plain'][k + 1] AS format, k <= 2 AS well_formed FROM ({_R})",
    "t2_candidate": f"SELECT conv_id, turn, CASE k WHEN 0 THEN role WHEN 1 THEN '<|channel>thought' || chr(10) || t || '<channel|>' || role WHEN 2 THEN t || chr(10) || '</think>' || chr(10) || role WHEN 3 THEN '<think>' || t || '</think> no tags <|channel>' ELSE t END AS candidate FROM ({_R})",
    "t3_render_response": f"SELECT conv_id, turn, '<think>' || chr(10) || t || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || role || chr(10) || '</answer>' AS xml FROM ({_R}) WHERE k = 1",
    "t4_segments": f"SELECT conv_id, turn, 32::INT AS think, length(role)::INT AS answer FROM ({_R}) WHERE k IN (0, 2)",
    "t5_prompt_render": "SELECT o_orderkey, 'On ' || strftime(o_orderdate, '%Y-%m-%d') || ' about ' || o_orderpriority || ':' || chr(10) || o_custkey || chr(10) AS prompt FROM orders",
    "t6_markdown_table": "SELECT n_regionkey, '| key | name |' || chr(10) || '|-----|------|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY ALL",
    "t7_hashes": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, sha256('{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS json_hash FROM documents",
    "t8_html_fields": "SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), chr(10) || chr(9) || chr(13) || ' ') AS title, len(regexp_extract_all(html, '(?i)<p[ >]'))::INT AS paragraphs FROM pages",
    "t9_html_paragraphs": "SELECT page_id, (i - 1)::INT AS position, md5(x) AS paragraph FROM (SELECT page_id, i, trim(regexp_replace(regexp_replace(p[i], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(?: [^>]*)?>(.*?)</p>', 1) AS p FROM pages))) WHERE x <> ''",
    "t10_shared_windows": f"WITH b AS (SELECT item_id, unnest(list_distinct({_GRAM('w', 8)})) AS g FROM (SELECT item_id, {_TOK} AS w FROM benchmark)), d AS (SELECT doc_id, unnest(list_distinct({_GRAM('w', 8)})) AS g FROM (SELECT doc_id, {_TOK} AS w FROM documents)) SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY ALL",
    "t11_ngram_overlap": f"WITH c AS (SELECT conv_id, turn, {_GRAM('w', 2)} AS g FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)) SELECT a.conv_id, len(list_intersect(a.g, b.g))::INT AS shared, len(list_distinct(a.g))::INT AS own FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1",
    "t12_repetition_penalty": f"SELECT doc_id, round(CASE WHEN len(g) > len(list_distinct(g)) THEN (1 - len(list_distinct(g)) / len(g)) * -1.0 ELSE 0 END, 8)::DOUBLE AS penalty FROM (SELECT doc_id, {_GRAM('w', 3)} AS g FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents))",
    "t13_repetition_rate": f"SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END, 8)::DOUBLE AS rate FROM (SELECT doc_id, {_GRAM('w', 3)} AS g FROM (SELECT doc_id, {_TOK} AS w FROM documents))",
    "t15_degeneration": f"SELECT doc_id, f AS failures, f = '' AS valid FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN len(g) > 0 AND 1 - len(list_distinct(g)) / len(g) >= 0.5 THEN 'repetition' END, CASE WHEN length(text) > 8000 THEN 'cap' END, CASE WHEN NOT ends_with(trim(text), '.') THEN 'eos' END], lambda x: x IS NOT NULL), ',') AS f FROM (SELECT doc_id, text, {_GRAM('w', 4)} AS g FROM (SELECT doc_id, text, {_TOK} AS w FROM documents)))",
    "t16_lexical_jaccard": "WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'of', 'to', 'in', 'que', 'les', 'der', 'die'))) AS w FROM conversations) SELECT a.conv_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 8)::DOUBLE AS jaccard FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1",
    "t20_polarity": f"SELECT doc_id, round((p - n) / greatest(1, p + n), 8)::DOUBLE AS polarity FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'que'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'les', 'der'))) AS n FROM (SELECT doc_id, {_TOK} AS w FROM documents))",
    "t21_lexicon_stance": f"SELECT doc_id, CASE WHEN len(w) > 0 THEN round((len(regexp_extract_all(text, '\\bthe\\b')) - len(regexp_extract_all(text, '\\bof\\b'))) / len(w), 8) END AS stance FROM (SELECT doc_id, text, {_TOK} AS w FROM documents)",
    "t22_numbers": "SELECT o_orderkey, 3::INT AS n, round(o_totalprice, 2) AS first FROM orders",
    "t23_grounding": "SELECT o_orderkey, round(((a OR b1 OR c1)::INT + (a2 OR b2 OR c2)::INT + (a3 OR b3 OR c3)::INT) / 3, 8)::DOUBLE AS grounding FROM (SELECT o_orderkey, abs(p - s1) <= greatest(0.01, abs(s1) * 0.001) AS a, abs(p - s2) <= greatest(0.01, abs(s2) * 0.001) AS b1, abs(p - s3) <= greatest(0.01, abs(s3) * 0.001) AS c1, abs(c - s1) <= greatest(0.01, abs(s1) * 0.001) AS a2, abs(c - s2) <= greatest(0.01, abs(s2) * 0.001) AS b2, abs(c - s3) <= greatest(0.01, abs(s3) * 0.001) AS c2, abs(7 - s1) <= greatest(0.01, abs(s1) * 0.001) AS a3, abs(7 - s2) <= greatest(0.01, abs(s2) * 0.001) AS b3, abs(7 - s3) <= greatest(0.01, abs(s3) * 0.001) AS c3 FROM (SELECT o_orderkey, o_totalprice AS p, o_custkey::DOUBLE AS c, round(o_totalprice, 0) AS s1, o_custkey::DOUBLE + 0.005 AS s2, o_orderkey::DOUBLE AS s3 FROM orders))",
    "t24_display_precision": "SELECT o_orderkey, round(v, 1) = round(round(v, 2), 1) AS same, round(v, 1)::DOUBLE AS shown FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18, 4) AS v FROM orders)",
    "t25_numeric_support": "SELECT count(*) FILTER (WHERE abs(o_totalprice * (1 + 1e-7) - o_totalprice) <= greatest(1.0, abs(o_totalprice)) * 1e-6) AS supported, count(*) AS n FROM orders",
    "t27_format_check": f"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN k <> 0 THEN 'order' END, CASE WHEN (CASE k WHEN 0 THEN 69 + length(role) WHEN 1 THEN 58 + length(role) WHEN 2 THEN 42 + length(role) WHEN 3 THEN 67 ELSE 34 END) > 90 THEN 'long' END, CASE WHEN k IN (1, 3) THEN 'forbidden' END], lambda x: x IS NOT NULL), ',') AS failures FROM ({_R})",
    "t28_single_deletion": "SELECT o_orderkey, k IS NOT NULL AS single_deletion, CASE WHEN k IS NOT NULL THEN substr(a, k + 1, length(a) - length(b)) END AS deleted FROM (SELECT o_orderkey, a, b, list_max(list_filter(range(0, length(b) + 1), lambda k: left(a, k) || right(a, length(b) - k) = b)) AS k FROM (SELECT o_orderkey, 'head ' || o_orderpriority || ' tail' AS a, CASE o_orderkey % 4 WHEN 0 THEN 'head  tail' WHEN 1 THEN 'head tail' WHEN 2 THEN 'head  tale' ELSE 'head ' || substr(o_orderpriority, 3) || ' tail' END AS b FROM orders))",
    "t30_top_level_split": "SELECT o_orderkey, 'GDP (real, yearly)|' || o_orderpriority || '|CPI' AS parts FROM orders",
    "t32_window_cover": f"WITH n AS (SELECT doc_id, len({_TOK}) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, n, 48)) AS low FROM n WHERE n > 0), x AS (SELECT doc_id, low, least(low + 64, n) AS high, unnest(range(low, least(low + 64, n))) AS i FROM w), c AS (SELECT doc_id, i, count(*) AS c FROM x GROUP BY ALL) SELECT doc_id, low, high, round(sum(1.0 / c), 6)::DOUBLE AS weight FROM x JOIN c USING (doc_id, i) GROUP BY ALL",
    "t33_token_budget": "SELECT CASE WHEN n + 200 <= 512 THEN 'fits' WHEN n <= 512 THEN 'no room' ELSE 'too long' END AS gate, count(*) AS n FROM (SELECT CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n FROM documents) GROUP BY 1",
    "t34_answer_projection": f"SELECT conv_id, turn, CASE k WHEN 0 THEN '<answer>' || chr(10) || role || chr(10) || '</answer>' WHEN 2 THEN role ELSE 'no tags <|channel>' END AS answer FROM ({_R}) WHERE k IN (0, 2, 3)",
    "t35_completion_policy": f"SELECT CASE WHEN len > 80 AND k <> 0 THEN 'length' WHEN k IN (3, 4) THEN 'no boundary' WHEN role = '' THEN 'no answer' ELSE 'scored' END AS status, role, count(*) AS n FROM (SELECT role, k, CASE k WHEN 0 THEN 69 + length(role) WHEN 1 THEN 58 + length(role) WHEN 2 THEN 42 + length(role) WHEN 3 THEN 67 ELSE 34 END AS len FROM ({_R})) GROUP BY ALL",
    "t36_decision_json": f"SELECT o_orderkey, CASE k WHEN 0 THEN 'hike' WHEN 1 THEN 'cut' WHEN 2 THEN 'hold' END AS direction, (CASE k WHEN 0 THEN 25 WHEN 1 THEN 50 WHEN 2 THEN 0 END)::INT AS magnitude_bp FROM ({_J})",
    "r1_format": f"SELECT conv_id, turn, (k <= 2)::INT::DOUBLE AS reward FROM ({_R})",
    "r2_tag_count": f"SELECT conv_id, turn, [1.0, 0.0, 0.25, 0.5, 0.0][k + 1]::DOUBLE AS reward FROM ({_R})",
    "r3_steps": "SELECT o_orderkey, round((2 + (o_orderkey % 2 = 0)::INT) / 3, 8)::DOUBLE AS reward FROM orders",
    "r4_length": "SELECT o_orderkey, round(CASE WHEN hi = lo THEN 0 WHEN o_orderstatus = 'F' THEN 0.5 - (n - lo) / (hi - lo) ELSE least(0, 0.5 - (n - lo) / (hi - lo)) END, 8)::DOUBLE AS reward FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 100 AS n, min(o_orderkey % 100) OVER (PARTITION BY o_custkey) AS lo, max(o_orderkey % 100) OVER (PARTITION BY o_custkey) AS hi FROM orders)",
    "r5_cosine": "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 0.5 + 0.25 * w ELSE -0.5 - 0.25 * w END, 8) AS reward FROM (SELECT *, 1 + cos((o_orderkey % 1500) * pi() / 1000) AS w FROM orders)",
    "r7_rate_accuracy": "SELECT sum((o_orderstatus = 'F')::INT)::DOUBLE AS accuracy, sum((o_orderstatus IN ('F', 'O'))::INT)::DOUBLE AS format FROM orders",
    "r8_code_format": "SELECT o_orderkey, (o_orderkey % 2 = 0)::INT::DOUBLE AS reward FROM orders",
    "r11_decision_v2": f"SELECT o_orderkey, round({_STRICT}, 8)::DOUBLE AS reward FROM ({_J})",
    "r12_decision_v3": f"SELECT o_orderkey, round(CASE WHEN k = 3 THEN 0.25 * ({_SCORE(chr(39) + 'hold' + chr(39), 0)} - 0.05) ELSE {_STRICT} END, 8)::DOUBLE AS reward FROM ({_J})",
    "r13_grounded": f"SELECT doc_id, round(0.5 * quality + 0.25 * CASE WHEN n > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / n ELSE 0 END + 0.15 * ends_with(text, '.')::INT + 0.05 * greatest(0, least(1, (600 - n) / 300)) + 0.05 * (1 - CASE WHEN len(g) > 0 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END) - least(0.5, len(list_filter(string_split(text, ' '), lambda x: ends_with(x, '!!'))) / len(string_split(text, ' '))), 8)::DOUBLE AS reward FROM (SELECT doc_id, quality, text, w, len(w) AS n, {_GRAM('w', 3)} AS g FROM (SELECT doc_id, quality, text, {_TOK} AS w FROM documents JOIN labels USING (doc_id)))",
    "r15_violation_quotes": "SELECT doc_id, contains(lower(regexp_replace(text, '\\s', '', 'g')), lower(regexp_replace(substring(text, 3, 9) || CASE WHEN doc_id % 3 = 0 THEN 'ZZZ' ELSE '' END, '\\s', '', 'g'))) AS valid FROM documents",
    "r16_reward_replay": f"SELECT target, count(*) AS n, round(avg(o), 8) AS old, round(avg(w), 8) AS new, count(*) FILTER (WHERE w > o) AS better, count(*) FILTER (WHERE w < o) AS worse FROM (SELECT td AS target, ({_STRICT})::DOUBLE AS o, (CASE WHEN k = 3 THEN 0.25 * ({_SCORE(chr(39) + 'hold' + chr(39), 0)} - 0.05) ELSE {_STRICT} END)::DOUBLE AS w FROM ({_J})) GROUP BY ALL",
    "v1_cosine": "SELECT a.vec_id, round(list_dot_product(a.e, b.e) / greatest(1e-6, sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1",
    "v2_mean_pooling": "SELECT label, (i - 1)::INT AS k, round(sum(x * w) / sum(w), 6) AS mean FROM (SELECT label, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL",
    "v3_leave_one_out": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT a.vec_id, list_dot_product(a.e, c.e) / greatest(1e-6, sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(c.e, c.e))) AS f, list_dot_product(b.e, c.e) / greatest(1e-6, sqrt(list_dot_product(b.e, b.e)) * sqrt(list_dot_product(c.e, c.e))) AS m, list_dot_product(a.e, b.e) / greatest(1e-6, sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2) SELECT vec_id, round(f - m, 6) AS delta, round(1 - f, 6) AS distance_full, round(1 - m, 6) AS distance_masked, round(1 - s, 6) AS self_distance FROM r",
    "v4_distinct_text_cache": f"SELECT doc_id, len({_TOK})::INT AS score FROM documents",
    "v5_marginal": "SELECT l_orderkey, l_linenumber, l_partkey, round(max(l_extendedprice) OVER (PARTITION BY l_orderkey) - coalesce(greatest(max(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 0), 4) AS marginal FROM lineitem",
    "v6_welch": "WITH q AS (SELECT l_returnflag, avg(l_quantity) AS m, var_samp(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT a.l_returnflag, round((a.m - b.m) / b.m * 100, 6) AS delta_percent, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df FROM q a, q b WHERE b.l_returnflag = 'N' AND a.l_returnflag <> 'N'",
}
