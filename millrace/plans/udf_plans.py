"""Queries of comparisons that run in Arrow-batched Python, and of contamination marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_udfs as U
from ..session import table


def _pairs(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return c.where("turn = 0").select("conv_id", F.col("text").alias("a")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("b")), "conv_id")


def t8u(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(U.html_sections("html")).alias("r"))
    return rows.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.count_distinct("r.section").alias("sections"))


def t10u(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(U.leakage_words("text")).alias("tokens"))


def t17(spark, d):
    return _pairs(spark, d).select("conv_id", F.round(U.rouge_l_f1("a", "b"), 8).alias("rouge_l"))


def t18(spark, d):
    return _pairs(spark, d).select("conv_id", F.round(U.sequence_ratio("a", "b"), 8).alias("ratio"))


# What is put behind a turn's text, by conv_id % 12; 10 is the first turn itself, 11 the text again.
_ADDED = ["", " See ev-1a2b.", " An evidence citation.", " </think>", ' "x', "\nPlan:", "\n- x", " Let's see.", " We should verify it.", " “y", None, None]


def t19(spark, d):
    """Marks of second turns with a defect by id, against the first turn as their source."""
    k = F.col("conv_id") % 12
    added = F.element_at(F.array(*(F.lit(x) for x in _ADDED)), (k + 1).cast("int"))
    draft = F.concat("b", F.when(k == 10, F.concat(F.lit(" "), "a")).when(k == 11, F.concat(F.lit(". "), "b")).otherwise(added))
    return _pairs(spark, d).select("conv_id", F.array_join(U.contamination(draft, {"source": F.col("a")}), ",").alias("hits"))


def t31(spark, d):
    parts = table(spark, d, "documents").select("doc_id", U.chunks_udf(40)("text").alias("c"))
    return parts.select("doc_id", F.size("c").alias("chunks"))


def v7(spark, d):
    """ROUGE-L of the two turns' chunks of 40 words, weighted by their length."""
    return U.chunk_weighted(_pairs(spark, d), "conv_id", "a", "b", 40, U.rouge_l_f1).select("conv_id", "pairs", F.round("score", 8).alias("score"))


QUERIES = {"t8_html_sections": t8u, "t10_leakage_tokens": t10u, "t17_rouge_l": t17, "t18_sequence_ratio": t18, "t19_contamination": t19, "t31_sentence_chunks": t31, "v7_chunk_weighted": v7}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_%$.-]+', ' ', 'g'))"


_CASES = " ".join(f"WHEN {k} THEN {_q(x)}" for k, x in enumerate(_ADDED) if x is not None)
_DRAFTS = f"SELECT a.conv_id, a.text AS a, b.text || CASE a.conv_id % 12 {_CASES} WHEN 10 THEN ' ' || a.text ELSE '. ' || b.text END AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1"
_MARKS = ", ".join(f"CASE WHEN regexp_matches(t, {_q(p)}) THEN {_q(name)} END" for name, p in U.CONTAMINATION.items())
_LONG = f"list_filter(list_transform(string_split(regexp_replace(t, {_q(U.SENTENCE_END)}, '\\1' || chr(10), 'g'), chr(10)), lambda s: {_norm('s')}), lambda s: len(string_split(s, ' ')) >= 5)"
_COUNT = "len(t) - len(replace(t, '{}', ''))"

ORACLE_SQL = {
    "t19_contamination": f"WITH d AS ({_DRAFTS}), l AS (SELECT *, {_LONG} AS s FROM d) SELECT conv_id, array_to_string(list_sort(list_filter([{_MARKS}, CASE WHEN ({_COUNT.format(chr(34))}) % 2 = 1 OR {_COUNT.format('“')} <> {_COUNT.format('”')} THEN 'unmatched_quote' END, CASE WHEN length({_norm('a')}) >= 80 AND contains({_norm('t')}, {_norm('a')}) THEN 'quoted_or_repeated:source' END, CASE WHEN len(s) > len(list_distinct(s)) THEN 'duplicate_sentence' END], lambda x: x IS NOT NULL)), ',') AS hits FROM l",
}
