"""Hand-computed values of the Python text comparisons and statistics."""

import math

from millrace.operators import inference as I
from millrace.operators import text_udfs as U


def test_rouge_and_lcs():
    assert abs(U.rouge_l("a b c", "a x c") - 2 / 3) < 1e-12
    assert U.rouge_l("", "a") == 0.0 and U.lcs_length(list("abcbdab"), list("bdcaba")) == 4


def test_leakage_tokens():
    assert U.leakage_tokens("Don’t STRASSE­ﬁn_x") == ["don't", "strassefin", "x"]


def test_html_rows():
    assert U.html_rows("<h2>A &amp; B</h2><p>one <b>two</b></p><p> </p><strong>C</strong><p>three") == [("A & B", "one two"), ("C", "three")]


def test_sentence_chunks():
    assert U.sentence_chunks("One two. Three four five. Six.", 5) == ["One two. Three four five.", "Six."]
    assert U.sentence_chunks("", 5) == [] and U.sentence_chunks(None, 5) == []


def test_t_distribution():
    assert abs(I.t_p_value(2.0, 10) - 0.07338803) < 1e-7
    assert abs(I.t_p_value(0.0, 5) - 1) < 1e-12


def test_holm_and_mcnemar(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (2, "a", 0.04), (3, "a", 0.03), (4, "a", None)], "k int, f string, p double")
    got = {r.k: r.p_adjusted for r in I.holm(df, "p", ["f"], ["k"]).collect()}
    assert got[4] is None and all(math.isclose(got[k], v) for k, v in {1: 0.03, 2: 0.06, 3: 0.06}.items())
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(2, 8)], "a long, b long").select(I.mcnemar(F.col("a"), F.col("b")).alias("p")).first()
    assert math.isclose(row.p, 2 * (1 + 10 + 45) / 1024)


def test_ols_recovers_a_line(spark):
    rows = [("g", 1.25 + 2.5 * x - 0.75 * (x % 3), float(x), float(x % 3), x) for x in range(20)]
    got = {r.term: r.beta for r in I.ols(spark.createDataFrame(rows, "g string, y double, x double, c double, o int"), "g", "y", ["x", "c"], "o", 4).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in {"const": 1.25, "x": 2.5, "c": -0.75}.items())
