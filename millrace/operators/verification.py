"""Reason codes of fact cards and of the candidates that cite them.

A card is its rows of evidence; they are gathered per card, whose evidence is a prompt's
worth, and every check is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Marks of model templates, numbers, words, and terms that a candidate may not bring in by itself.
MODEL_TOKEN = r"(?i)<\|(?:im_start|im_end|endoftext|assistant|user|system)[^>]*>|</?think>|```"
NUMBER = r"(?:^|[^A-Za-z0-9_+-])([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?"
POLICY_TERMS = ["asset purchase", "balance sheet runoff", "forward guidance", "fiscal stimulus", "pandemic", "recession", "trade war", "bank failure", "policy rate was raised", "policy rate was cut", "committee decided", "fomc decided"]
CAUSAL = [" because ", " caused by ", " due to ", " driven by ", " reflecting ", " as a result of "]
SENTENCE_WORDS = 8


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def claims(c: Column) -> Column:
    """Numbers of a text, thousands marks dropped."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def supported(claim: Column, value: Column) -> Column:
    """Equal but for a millionth, of the value or absolute."""
    return F.abs(claim - value) <= F.greatest(F.lit(1e-6), F.abs(value) * 1e-6)


def _long_sentences(c: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(c), r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.size(words(s)) >= SENTENCE_WORDS)


def verify_candidates(candidates: DataFrame, evidence: DataFrame, most_reasoning: int = 1024, most_final: int = 512) -> DataFrame:
    """(card, codes, coverage, unsupported) of candidates(card, reasoning, final, cited, cutoff) with evidence(card, evidence_id, sha256, observed, value).

    codes is in a fixed order, each once, empty for a valid candidate; coverage is the share of
    the card's ids that are cited; unsupported holds the numbers that no cited value supports.
    A null text is empty, null citations are none, and a card without a cutoff is invalid.
    """
    e = evidence.groupBy("card").agg(F.collect_list(F.struct(F.trim(F.coalesce("evidence_id", F.lit(""))).alias("id"), F.lower(F.trim(F.coalesce("sha256", F.lit("")))).alias("hash"), "observed", F.col("value").cast("double").alias("value"))).alias("e"))
    none = F.array().cast("array<string>")
    rows = candidates.join(e, "card", "left").select("card", F.struct(F.coalesce("reasoning", F.lit("")).alias("r"), F.coalesce("final", F.lit("")).alias("f"), F.array_distinct(F.coalesce("cited", none)).alias("cited"), "cutoff", F.coalesce("e", F.array().cast(e.schema["e"].dataType)).alias("e")).alias("s"))

    def derived(s):
        both = F.concat_ws("\n", s.r, s.f)
        ids = F.transform(s.e, lambda x: x.id)
        allowed = F.transform(F.filter(s.e, lambda x: F.array_contains(s.cited, x.id) & x.value.isNotNull()), lambda x: x.value)
        return F.struct(both.alias("both"), F.concat(F.lit(" "), F.lower(both), F.lit(" ")).alias("low"), F.array_distinct(F.filter(ids, lambda x: x != "")).alias("known"), allowed.alias("allowed"))

    def judged(s, t, unsupported):
        contains = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda x: t.low.contains(x))
        tests = {
            "fact_card_invalid_cutoff": s.cutoff.isNull(),
            "fact_card_empty_evidence": F.size(s.e) == 0,
            "fact_card_duplicate_or_empty_evidence_id": F.size(t.known) < F.size(s.e),
            "fact_card_invalid_source_hash": F.exists(s.e, lambda x: ~x.hash.rlike("^[0-9a-f]{64}$")),
            "fact_card_post_cutoff_observation": F.exists(s.e, lambda x: F.coalesce(x.observed > s.cutoff, F.lit(False))),
            "fact_card_evidence_without_numeric_value": F.exists(s.e, lambda x: x.value.isNull() | F.isnan(x.value)),
            "candidate_forbidden_model_token": t.both.rlike(MODEL_TOKEN),
            "candidate_encoding_error": t.both.rlike("[\\x00�]"),
            "candidate_reasoning_too_long": F.size(words(s.r)) > most_reasoning,
            "candidate_final_too_long": F.size(words(s.f)) > most_final,
            "candidate_unknown_evidence_id": F.size(F.array_except(s.cited, t.known)) > 0,
            "candidate_unsupported_numeric_claim": F.size(unsupported) > 0,
            "candidate_external_policy_or_event": contains(POLICY_TERMS),
            "candidate_unlicensed_causal_claim": contains(CAUSAL),
            "candidate_reasoning_final_duplication": F.arrays_overlap(_long_sentences(s.r), _long_sentences(s.f)),
        }
        codes = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
        coverage = F.when(F.size(t.known) == 0, 0.0).otherwise(F.size(F.array_intersect(s.cited, t.known)) / F.size(t.known))
        return F.struct(codes.alias("codes"), coverage.alias("coverage"), unsupported.alias("unsupported"))

    def found(s, t):
        return let(F.filter(claims(t.both), lambda c: ~F.exists(t.allowed, lambda v: supported(c, v))), lambda u: judged(s, t, u))

    # Bound once each: every test uses them.
    return rows.select("card", let(F.col("s"), lambda s: let(derived(s), lambda t: found(s, t))).alias("v")).select("card", "v.codes", "v.coverage", "v.unsupported")
