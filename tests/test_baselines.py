"""Baselines, shared-draw regressions, stage plans, marks of drafts and snapshots, against values by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import baselines as B
from millrace.operators import inference as I
from millrace.operators import resampling as R
from millrace.operators import stages as S
from millrace.operators import text_udfs as U
from millrace.sources import files


def test_normal_cdf(spark):
    xs = [-9.0, -7.5, -7.0, -3.0, -1e-9, 0.0, 0.3, 1.96, 5.0, 7.1, 12.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(B.normal_cdf(F.col("x"))).collect()]
    assert all(abs(g - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14 for g, x in zip(got, xs, strict=True))
    assert spark.createDataFrame([(None,)], "x double").select(B.normal_cdf(F.col("x"))).first()[0] is None


def test_hazard(spark):
    rows = spark.createDataFrame([(4.0, 1.0, True), (4.0, 0.0, False), (100.0, 3.7, False), (0.0, 1.0, True), (20.0, 4.0, True)], "w double, s double, m boolean")
    got = [r[0] for r in rows.select(B.change_hazard(F.col("w"), F.col("s"), F.col("m"))).collect()]
    index = [30.390652 + 0.067460919 * w - 23.045727 * m - 8.2087573 * abs(s) for w, s, m in [(4, 1, 1), (4, 0, 0), (100, 3.7, 0)]]
    want = [1 / 1.0001 if x <= 1 else 1 / (x + 0.0001) for x in index]
    assert got[3] is None and all(abs(a - b) < 1e-12 for a, b in zip(got[:3], want, strict=True)) and abs(got[4] - 1 / 1.0001) < 1e-12
    p = rows.select(B.action_probabilities(F.lit(0.25), F.col("s"), F.col("s")).alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-12 and min(r.p) >= 0 and r.p[2] >= 0.75 for r in p)


def _likelihood(x, y, beta, cuts):
    phi = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    level = np.column_stack([np.zeros(len(y)), phi(np.array(cuts) - (x @ np.array(beta))[:, None]), np.ones(len(y))])
    return np.log(level[np.arange(len(y)), y + 1] - level[np.arange(len(y)), y]).sum()


def test_ordered_probit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 2)) * [1.0, 30.0] + [5.0, 100.0]
    y = np.searchsorted([1.0, 2.5], x @ [0.8, -0.02] - 0.5 + rng.normal(size=1500))
    df = spark.createDataFrame([(float(a), float(b), "abc"[c]) for (a, b), c in zip(x, y, strict=True)], "u double, v double, c string").repartition(3)
    beta, cuts = B.fit_ordered_probit(df, "c", ["a", "b", "c"], ["u", "v"])
    assert abs(beta[0] - 0.8) < 0.12 and abs(beta[1] + 0.02) < 0.004 and abs(cuts[1] - cuts[0] - 1.5) < 0.15
    # No small step from the fit is better.
    best = _likelihood(x, y, beta, cuts)
    for k in range(4):
        for step in (-1e-3, 1e-3):
            at = np.array([*beta, *cuts])
            at[k] *= 1 + step
            assert _likelihood(x, y, at[:2], at[2:]) < best
    p = np.array([r.p for r in df.select(B.ordered_probit_probabilities(["u", "v"], beta, cuts).alias("p")).collect()])
    assert np.allclose(p.sum(1), 1) and np.allclose(p.mean(0), np.bincount(y) / 1500, atol=0.01)
    for bad in ([(1.0, 1.0, "z")], [(None, 1.0, "a")], [(math.nan, 1.0, "a")]):
        with pytest.raises(ValueError):
            B.fit_ordered_probit(df.union(spark.createDataFrame(bad, df.schema)), "c", ["a", "b", "c"], ["u", "v"])
    with pytest.raises(ValueError):
        B.fit_ordered_probit(df.where("c <> 'b'"), "c", ["a", "b", "c"], ["u", "v"])


def test_cumulative_forest(spark):
    rows = spark.createDataFrame([(float(k), "abc"[min(2, k // 40)]) for k in range(120)], "x double, c string")
    got = {r.x: r.p for r in B.cumulative_forest(rows, rows, "c", ["a", "b", "c"], ["x"], trees=10).collect()}
    assert got[5.0][0] > 0.9 and got[60.0][1] > 0.9 and got[110.0][2] > 0.9
    assert all(abs(sum(p) - 1) < 1e-9 and min(p) >= -1e-12 for p in got.values())
    crossed = spark.range(1).select(B.projected_classes(F.lit(0.2), F.lit(0.6)).alias("p")).first().p
    assert np.allclose(crossed, [0.6, 0.0, 0.4])


def test_beta_bootstrap(spark):
    rng = np.random.default_rng(2)
    rows = [(arm, k // 3, float(2 + 3 * x - z + rng.normal()), float(x), float(z), float(k % 5)) for arm in ("a", "b") for k in range(24) for x, z in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "arm string, block int, y double, x double, lag double, control double")
    drawn = R.plan(df, "block", None, 4)
    got = {(r.draw, r.arm): r for r in I.beta_bootstrap(df, "arm", "y", ["x", "lag", "control"], "block", drawn).collect()}
    times = {(r.draw, r.unit): r.times for r in drawn.collect()}
    assert len(got) == 8
    for (draw, arm), r in got.items():
        own = [t for t in rows if t[0] == arm for _ in range(times.get((draw, t[1]), 0))]
        x = np.array([[1, *t[3:]] for t in own])
        want = np.linalg.lstsq(x, np.array([t[2] for t in own]), rcond=None)[0]
        assert r.status == "ok" and r.n == 24 and np.allclose(r.betas, want)
    flat = I.beta_bootstrap(df.withColumn("lag", F.col("x") * 2), "arm", "y", ["x", "lag"], "block", drawn).collect()
    assert {r.status for r in flat} == {"rank deficient"} and all(r.betas is None for r in flat)


def test_stage_plan(spark):
    stages = spark.createDataFrame([(k, f"c{k}", None) for k in range(8)] + [(7, "again", None)], "stage int, content string, sealed string")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (3, 1), (4, 5), (5, 4), (6, 5), (7, 9)], "stage int, needs int")
    first = {r.stage: r for r in S.plan_stages(stages, edges).collect()}
    assert [first[k].state for k in range(8)] == ["ready", "blocked", "blocked", "blocked", "invalid", "invalid", "invalid", "invalid"]
    assert first[4].faults == "cycle" and first[6].faults == "" and first[7].faults == "repeated stage,unknown need"
    assert first[0].position < first[1].position < first[2].position < first[3].position
    kept = spark.createDataFrame([(k, f"c{k}", first[k].seal if k < 2 else None) for k in range(4)], stages.schema)
    own = edges.where("stage < 4")
    assert [r.state for r in sorted(S.plan_stages(kept, own).collect(), key=lambda r: r.stage)] == ["sealed", "sealed", "ready", "blocked"]
    changed = kept.withColumn("content", F.when(F.col("stage") == 0, "new").otherwise(F.col("content")))
    assert [r.state for r in sorted(S.plan_stages(changed, own).collect(), key=lambda r: r.stage)] == ["stale", "stale", "blocked", "blocked"]
    assert S.plan_stages(stages.limit(0), edges.limit(0)).count() == 0


def test_contamination(spark):
    source = "the committee judged that risks to growth and to prices were roughly in balance over the year ahead"
    texts = ["Growth was firm.", "As ev-12af shows.", "Evidence citations follow", "a </think> b", 'He said "x', "a “b", "Plan:\nx", "## Steps\nx", "- item one", "The output is long", f"So: {source.upper()}!", "Growth was firm in all of May. Then it fell. Growth was firm in all of May.", None, "A note. A note.", "Let's see"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.c for r in df.select("k", U.contamination(F.col("t"), {"minutes": F.lit(source)}).alias("c")).collect()}
    want = {1: ["evidence_id"], 2: ["ev_citation_phrase", "meta:citation_process"], 3: ["control_marker"], 4: ["unmatched_quote"], 5: ["unmatched_quote"], 6: ["heading"], 7: ["heading"], 8: ["bullet_marker"], 9: ["meta:transport_or_role"], 10: ["quoted_or_repeated:minutes"], 11: ["duplicate_sentence"], 14: ["meta:self_narration"]}
    assert {k: v for k, v in got.items() if v} == want


def test_chunk_weighted(spark):
    df = spark.createDataFrame([(1, "a b c. d e f.", "a b c. x y z. q."), (2, "", None), (3, None, "one two.")], "k int, a string, b string")
    same = lambda x, y: (x == y).cast("double")
    got = {r.k: (r.pairs, r.score) for r in U.chunk_weighted(df, "k", "a", "b", 3, same).collect()}
    # Weights 3, 3 and 1; only the first pair is equal.
    assert got[1][0] == 3 and abs(got[1][1] - 3 / 7) < 1e-12 and got[2] == (0, 0.0) and got[3] == (1, 0.0)


def test_sqlite_snapshot(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, None, None)], "k long, t string, v double")
    both = files.sqlite_snapshot({"a": a, "b": a.limit(1)})
    assert sorted(r["table"] for r in both.collect()) == ["a", "b"]
    got = files.sqlite_rows(both.where("`table` = 'a'"), "SELECT k, t, v FROM a ORDER BY k", "k long, t string, v double").collect()
    assert sorted(map(tuple, got)) == [(1, "x", 0.5), (2, None, None)]


def test_workbooks(spark, tmp_path):
    rows = [(1, " a <b> & \x01é", 0.5, True), (2, None, None, None), (3, "", -1e300, False)]
    book = files.workbook(["k", "t", "v", "b"], rows)
    assert [r["t"] for r in files.sheet_cells(book)] == [" a <b> & é", None, ""]
    (tmp_path / "a.xlsx").write_bytes(book)
    got = files.read_workbooks(spark.read.format("binaryFile").load(f"{tmp_path}/a.xlsx"), "k long, t string, v double, b boolean").collect()
    assert [tuple(r) for r in got] == [(1, " a <b> & é", 0.5, True), (2, None, None, None), (3, "", -1e300, False)]
    assert files.sheet_cells(files.workbook(["k"], [])) == []
    with pytest.raises(Exception):
        files.read_workbooks(spark.createDataFrame([(bytearray(book),)], "content binary"), "t long").collect()


def test_sheet_cells_of_other_writers():
    import io
    import zipfile

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    members = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="x" sheetId="3" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="/xl/worksheets/data.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>day</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>',
        "xl/worksheets/data.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="AB2"><v>2.5</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    assert files.sheet_cells(out.getvalue()) == [{"day": None, "value": "2.5"}]


def test_page_links(spark):
    html = """<a class=x href="/a.htm">1</a><A HREF='b.htm'>2</A><a href="#top">3</a><a href="https://o.org/c">4</a><a href="//o.org/d">5</a><a href="/a.htm">6</a><a href="javascript:x()">7</a>"""
    df = spark.createDataFrame([("http://s.org/x/y.htm?q=/1", html), ("http://s.org", '<a href="b.htm">'), ("http://s.org/z", None)], "url string, html string")
    got = sorted((r.url, r.link) for r in files.page_links(df, "url", "html").collect())
    at = "http://s.org/x/y.htm?q=/1"
    assert got == [("http://s.org", "http://s.org/b.htm"), (at, "http://o.org/d"), (at, "http://s.org/a.htm"), (at, "http://s.org/x/b.htm"), (at, "https://o.org/c")]


def test_bisected():
    asked = []

    def fetch(batch):
        asked.append(len(batch))
        return None if 5 in batch else sum(batch)

    assert files.bisected([1, 2, 3, 4, 5, 6, 7], fetch) == [([1, 2, 3], 6), ([4], 4), ([5], None), ([6, 7], 13)]
    assert asked == [7, 3, 4, 2, 1, 1, 2] and files.bisected([], fetch) == []
