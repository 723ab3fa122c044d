"""Operators whose queries have no SQL, or whose edge cases the tables do not hold, against values by hand."""

import collections
import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import inference as I
from millrace.operators import resampling as B
from millrace.operators import splits as S
from millrace.operators import text_udfs as U
from millrace.operators.stages import reached
from millrace.plans import inference_plans
from millrace.sources import files


def test_greedy_projection(spark):
    rows = [("a", 1, 5, False), ("a", 2, 9, False), ("a", 3, 4, False), ("a", 4, 7, True), ("b", 1, 3, False), ("b", 2, 3, False)]
    df = spark.createDataFrame(rows, "g string, rank int, cost long, required boolean")
    got = S.greedy_projection(df, "g", "rank", "cost", "required", 16).collect()
    # The required 7 first; then 5 fits, 9 does not, 4 does.  All of b fit.
    assert sorted((r.g, r["rank"]) for r in got) == [("a", 1), ("a", 3), ("a", 4), ("b", 1), ("b", 2)]


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("same text", "same text"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(U.sequence_ratio("a", "b")).collect()] == [0.75, 1.0, 0.0, 1.0]


def test_sentence_chunks():
    assert U.sentence_chunks("One two. Three four five! Six.", 4) == ["One two.", "Three four five! Six."]
    assert U.sentence_chunks("a b c d e f. g.", 3) == ["a b c d e f.", "g."] and U.sentence_chunks(None, 3) == []


def test_mcnemar(spark):
    pairs = [(0, 0), (3, 1), (1, 3), (10, 10), (900, 1000), (0, 1200)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(I.mcnemar(F.col("a"), F.col("b"))).collect()]
    want = [1.0 if a + b == 0 else min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) for a, b in pairs]
    assert all(abs(x - y) <= 1e-9 * max(y, 1e-300) or abs(x - y) < 1e-300 for x, y in zip(got, want, strict=True))


def test_sign_flip_either_way(spark):
    rows = [("few", k, v) for k, v in enumerate([3.0, -1.0, 2.0, 4.0])] + [("many", k, 1.0 + k % 3) for k in range(20)] + [("null", k, (-1.0) ** k) for k in range(20)]
    got = {r.g: r for r in I.sign_flip(spark.createDataFrame(rows, "g string, k int, v double"), "g", "k", "v", exact_upto=10, draws=300).collect()}
    want = sum(abs(sum(s * v for s, v in zip(signs, [3, -1, 2, 4], strict=True))) >= 8 for signs in itertools.product((1, -1), repeat=4)) / 16
    assert got["few"].p == want and got["few"].masks == 16
    assert got["many"].p < 0.02 and got["null"].p == 1.0 and got["many"].masks == 300


def test_ranked_is_a_global_rank(spark):
    rows = [(k * 37 % 101, None if k % 50 == 0 else k % 7) for k in range(100)]
    df = spark.createDataFrame(rows, "v int, c int").repartition(5)
    got = {r.v: (r._rank, r._n) for r in S.ranked(df, [F.col("v")], F.floor(F.col("v") / 10)).collect()}
    assert got == {v: (k, 100) for k, v in enumerate(sorted(v for v, _ in rows), 1)}
    down = {r.v: r._rank for r in S.ranked(df, [F.desc("v")], F.floor(F.col("v") / 10), True).collect()}
    assert down == {v: 101 - k for v, (k, _) in got.items()}
    assert S.ranked(df.limit(0), [F.col("v")], F.col("v")).count() == 0


def test_plans(spark):
    units = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(0, 0)], "u int, s int")
    plan = B.plan(units, "u", "s", 30)
    rows = plan.collect()
    taken = {}
    for r in rows:
        taken[r.draw, r.stratum] = taken.get((r.draw, r.stratum), 0) + r.times
        assert str(r.unit % 2) == r.stratum
    assert set(taken.values()) == {5} and len(taken) == 60
    assert sorted(map(tuple, rows)) == sorted(map(tuple, B.plan(units.repartition(3), "u", "s", 30).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, B.plan(units, "u", "s", 30, "other").collect()))


@pytest.mark.parametrize("of", ["plan", "unit_means", "stratified_means"])
def test_plans_of_many_units(spark, of):
    """Several blocks of keys and chunks of positions, against md5 by hand; no table of units goes through the driver."""
    units = spark.range(20_000).selectExpr("id * 7 - 60000 AS u", "IF(id < 12000, 'a', IF(id < 19999, 'b', NULL)) AS s", "double(id % 3) AS v")
    keys = {"a": [k * 7 - 60000 for k in range(12_000)], "b": [k * 7 - 60000 for k in range(12_000, 19_999)]}
    number = lambda d, s, p: int(hashlib.md5(f"s:{d}:{s}:{p}".encode()).hexdigest()[:12], 16) % len(keys[s])
    taken = {(d, s): collections.Counter(keys[s][number(d, s, p)] for p in range(len(keys[s]))) for d in range(2) for s in keys}
    value = {"unit_means": lambda u: u % 5, "stratified_means": lambda u: (u + 60000) // 7 % 3}
    if of == "plan":
        got = B.plan(units, "u", "s", 2)
        assert {(r.draw, r.stratum, r.unit): r.times for r in got.collect()} == {(*k, u): n for k, c in taken.items() for u, n in c.items()}
    else:
        got = B.unit_means(units, "u", "s", 2, {"m": F.pmod("unit", F.lit(5)).cast("double")}) if of == "unit_means" else B.stratified_means(units, "u", "s", 2, {"m": F.col("v")})
        want = {k: sum(value[of](u) * n for u, n in c.items()) / sum(c.values()) for k, c in taken.items()}
        assert {(r.draw, r.stratum): r.m for r in got.collect()} == pytest.approx(want)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_plan_files(spark, tmp_path):
    plan = B.plan(spark.range(5).withColumnRenamed("id", "u"), "u", None, 4)
    files.write_plan(plan, f"{tmp_path}/plan")
    assert sorted(map(tuple, files.read_plan(spark, f"{tmp_path}/plan").collect())) == sorted(map(tuple, plan.collect()))
    with pytest.raises(Exception):
        files.write_plan(plan, f"{tmp_path}/plan")
    plan.limit(1).write.mode("append").parquet(f"{tmp_path}/plan")
    with pytest.raises(ValueError):
        files.read_plan(spark, f"{tmp_path}/plan")


def test_zipped_vintages(spark):
    import io
    import zipfile

    def pack(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.csv", text)
        return bytearray(out.getvalue())

    first = pack("﻿date,S_20200101,S_20200201\r\n2019-01-01,1.5,.\r\n2019-02-01,2,3\r\n")
    df = spark.createDataFrame([(first,), (pack("date,S_20200101\n2019-01-01,1.5\n"),)], "content binary")
    got = sorted((str(r.date), str(r.vintage_date), r.value) for r in files.zipped_vintages(df).collect())
    assert got == [("2019-01-01", "2020-01-01", 1.5), ("2019-02-01", "2020-01-01", 2.0), ("2019-02-01", "2020-02-01", 3.0)]
    with pytest.raises(Exception, match="two values"):
        files.zipped_vintages(df.union(spark.createDataFrame([(pack("date,S_20200101\n2019-01-01,9\n"),)], "content binary"))).collect()


def test_release_evidence(spark):
    page = '<p><a href="/x/minutes20250129.htm">Minutes</a> (Released February 19, 2025)</p><p><a href="/x/minutes20250319.htm">M</a> (Released April 9, 2025)</p>'
    df = spark.createDataFrame([(page, "2025-01-29"), (page, "2025-03-19"), (page, "2025-05-07"), (None, "2025-01-29")], "html string, d string").withColumn("day", F.to_date("d"))
    got = [(r.evidence, str(r.release_date), r.lag_days) for r in T.release_evidence(df, "html", "day").collect()]
    assert got[:3] == [("released", "2025-02-19", 21), ("released", "2025-04-09", 21), ("none", "None", None)]
    assert got[3][1:] == ("None", None)


def test_label_swap(spark):
    rows = [("a", k, float(x), float(y)) for k, (x, y) in enumerate([(1, 0), (1, 0), (0, 0), (1, 0)])]
    got = I.label_swap(spark.createDataFrame(rows, "g string, u int, x double, y double"), "g", "u", F.col("x"), F.col("y")).first()
    assert got.p == 0.25 and got.masks == 16


def test_reached(spark):
    # Several operands of a fact, a cycle (6, 7), a row twice, nulls, and a root that no edge names.
    rows = [(1, 2), (2, 3), (2, 3), (9, 3), (3, 4), (6, 7), (7, 6), (4, 6), (8, 10), (None, 8), (8, None)]
    edges = spark.createDataFrame(rows, "operand long, fact long")
    got = lambda *roots: sorted(r.fact for r in reached(edges, "operand", "fact", spark.createDataFrame([(k,) for k in roots], "fact long")).collect())
    assert got(2, 11, None) == [2, 3, 4, 6, 7, 11]
    assert got(7) == [6, 7] and got(9, 9) == [3, 4, 6, 7, 9] and got() == []


def test_missing_operands_of_many_facts(spark, tmp_path):
    # A recursive query ends with an error beyond a million rows, which it reaches before as many facts.
    n = 600_000
    spark.range(n).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    gone = [False] * n
    for k in range(n):
        gone[k] = k % 10 == 3 or gone[k // 2]
    want = [k for k in range(n) if gone[k]]
    assert tuple(inference_plans.e2(spark, str(tmp_path)).first()) == (len(want), sum(want))


def test_flips_of_large_groups(spark):
    # 40 units have 2**40 masks: by hand from the binomial, and with different sizes from those of smaller ones.
    rows = [("same", k, 1.0 if k < 30 else -1.0) for k in range(40)] + [("zeros", k, float(k < 2)) for k in range(40)] + [("powers", k, 2.0**k) for k in range(24)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, u int, x double")
    got = {r.g: r for r in I.label_swap(df, "g", "u", F.col("x"), F.lit(0.0)).collect()}
    assert got["same"].p == pytest.approx(sum(math.comb(40, k) for k in range(41) if abs(40 - 2 * k) >= 20) / 2**40, rel=1e-12)
    assert (got["same"].masks, got["zeros"].p, got["powers"].p, got["powers"].masks) == (2**40, 0.5, 2 / 2**24, 2**24)
    assert (got["none"].p, got["none"].masks) == (1.0, 1)


def test_flip_share():
    rng = random.Random(5)
    for n in (0, 1, 2, 5, 9, 11):
        for values in ([rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(n)], [round(rng.uniform(-5000, 5000), 2) for _ in range(n)]):
            t = abs(sum(values))
            want = sum(abs(sum(s * v for s, v in zip(signs, values, strict=True))) >= t - 1e-9 for signs in itertools.product((1, -1), repeat=n)) / 2**n
            assert I.flip_share(values) == want
    assert [I.flip_share([math.nan, 1.0]), I.flip_share([math.inf, 1.0]), I.flip_share([math.inf, -math.inf, 1.0])] == [1.0, 1.0, 0.5]


def test_balanced_selection(spark):
    rows = [(g, t) for g in range(12) for t in ("x", "y", "z")] + [(50, "x"), (51, "x"), (52, None), (60, "y"), (60, "x")]
    got = {r.g: r.t for r in S.balanced_selection(spark.createDataFrame(rows, "g int, t string"), "g", "t", "s").collect()}
    assert sorted(list(got.values())[:12]).count("x") == 4 and got[50] == got[51] == "x" and got[60] == "y" and 52 not in got
