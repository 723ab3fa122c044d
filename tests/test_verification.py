"""Reason codes of cards and candidates by hand."""

import datetime

from pyspark.sql import functions as F

from millrace.operators import verification as V

DAY = datetime.date(2020, 1, 1)
GOOD = "ab" * 32


def test_claims(spark):
    df = spark.createDataFrame([("Rose 1,234.5 to -3, x12 not 0.25% or 7-8",), (None,), ("",)], "t string")
    assert [r.c for r in df.select(V.claims(F.col("t")).alias("c")).collect()] == [[1234.5, -3.0, 0.25, 7.0], None, []]


def test_codes(spark):
    evidence = [("ok", "e1", GOOD, DAY, 2.5), ("ok", "e2", GOOD, DAY, 10.0), ("bad", "e1", "zz", DAY, None), ("bad", "e1", GOOD, datetime.date(2021, 1, 1), 1.0), ("cite", "e1", GOOD, DAY, 2.5)]
    rows = [
        ("ok", "Rates were 2.5 percent.", "Rates held.", ["e1", "e1"], DAY),
        ("bad", "Nothing to say.", None, None, DAY),
        ("cite", "It was 2.5 because of a Recession </think>", "x " * 6, ["e9"], DAY),
        ("none", "one two three four five six seven eight. Next", "One two three four five six seven eight.", [], None),
    ]
    df = spark.createDataFrame(rows, "card string, reasoning string, final string, cited array<string>, cutoff date")
    got = {r.card: r for r in V.verify_candidates(df, spark.createDataFrame(evidence, "card string, evidence_id string, sha256 string, observed date, value double"), most_final=5).collect()}
    assert got["ok"].codes == [] and got["ok"].coverage == 0.5 and got["ok"].unsupported == []
    assert got["bad"].codes == ["fact_card_duplicate_or_empty_evidence_id", "fact_card_invalid_source_hash", "fact_card_post_cutoff_observation", "fact_card_evidence_without_numeric_value"]
    assert got["cite"].codes == ["candidate_forbidden_model_token", "candidate_final_too_long", "candidate_unknown_evidence_id", "candidate_unsupported_numeric_claim", "candidate_external_policy_or_event", "candidate_unlicensed_causal_claim"]
    assert got["none"].codes == ["fact_card_invalid_cutoff", "fact_card_empty_evidence", "candidate_final_too_long", "candidate_reasoning_final_duplication"] and got["none"].coverage == 0.0
