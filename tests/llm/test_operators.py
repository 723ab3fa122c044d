"""The training-data operators against brute force, and on empty, null, tied, repeated and clashing input."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, decontaminate, embed_dedup, lm_score, ngram_join, packing, pii, quality, sharding, substring_dedup, toxicity
from millrace.llm import words as W
from millrace.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    base = _text(rng, 120)
    for k in range(60):
        words = base.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append(" ".join(words))
    rows += [_text(rng, rng.randrange(1, 60)) for _ in range(60)]
    rows += ["a b c", "A b C", "a b", "", "   ", None, "x", "x", _text(rng, 3000), "same words " * 30, "same words " * 40]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)]


def _brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = _brute_words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "threshold", "num", "den"), [(4, "0.85", 85, 100), (5, "0.8", 80, 100)])
def test_ngram_join(spark, n, threshold, num, den):
    rows = _corpus()
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, DOC), n=n, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == _brute_components(rows, n, num, den)


def test_ngram_join_odd_input(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as size", "2 as node", "3 as component_id")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert out == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, None)]


def _variants_of_one(rng, n, words=60, edits=6):
    """Copies of one text with up to `edits` words changed: many near 0.85 of each other, few of any one."""
    base, out = rng.sample(WORDS, words), []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"v{rng.randrange(12)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1 << 19, 1 << 15])
def test_ngram_join_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
    rng = random.Random(21)
    texts = [*_variants_of_one(rng, 500), *(_text(rng, 40) for _ in range(50))]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, DOC), n=4, threshold="0.85").collect()
    want = _brute_components(rows, 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert 2 < len({c for _, c in want.values()}) < 450


def test_links_of_a_cell():
    rng = random.Random(22)
    for trial in range(40):
        t, n = Fraction(rng.choice([80, 85, 95]), 100), rng.randrange(2, 100)
        bases = [rng.sample(range(1, 300), 40) for _ in range(rng.choice([1, 2, 5]))]
        sets = []
        for _ in range(n):
            own = set(rng.choice(bases))
            for _ in range(rng.randrange(9)):
                own.discard(rng.randrange(1, 300)), own.add(rng.randrange(1, 300))
            sets.append(np.array(rng.sample(sorted(own), rng.randrange(5, len(own) + 1)) if rng.random() < 0.2 else sorted(own), np.uint64))
        sets = [np.sort(x) for x in sets]
        label = np.array([rng.randrange(n) if trial % 2 else k for k in range(n)])
        side = np.array([rng.randrange(2) if trial % 3 == 0 else 0 for _ in range(n)])
        known = [(k, n + int(label[k])) for k in range(n)]
        own = [set(x.tolist()) for x in sets]
        alike = lambda i, j: len(own[i] & own[j]) * t.denominator >= t.numerator * len(own[i] | own[j])  # noqa: B023, E731
        pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if (not side.any() or side[i] != side[j]) and alike(i, j)]
        links = ngram_join.connecting(sets, label, side, t)
        assert all(alike(i, j) for i, j in links)
        assert _roots(known + links, 2 * n) == _roots(known + pairs, 2 * n)


def _roots(edges, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(k) for k in range(n)]


def test_ngram_join_of_repeated_ids(spark):
    rng = random.Random(23)
    a, b, c = (_text(rng, 30) for _ in range(3))
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (3, ""), (4, c), (5, None)]
    out = ngram_join.jaccard_components(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3), (3, 3), (4, 3), (5, 5)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "u long, v long")
    want = {k: find(k) for k in range(300) if find(k) != k}
    assert {r.node: r.component for r in components(df).collect()} == want


def test_components_by_stars(spark, monkeypatch):
    from millrace.llm import common

    monkeypatch.setattr(common, "CONTRACT_ROWS", 3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 120), (120, 110)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 120: 100, 110: 100}


PII_TEXTS = [
    "mail a.b@c.de, x@y and a@b.com@d.org or _%+-@-.- done", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "card 4111 1111-1111 1111 and 4111111111111112 or 4111  1111",
    "call +1 (706) 555-3138, +12, +1.2.3.4.5.6.7.8.9 ((+4", "é😀 4111111111111111 a@b.co +49 170 1234567", "", "+" * 50, "1" * 5000, "a" * 20000 + "@", "1.1.1.1" * 30, None,
]
PII_BRUTE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_pii_base(spark):
    rng = random.Random(3)
    texts = [*PII_TEXTS, *("".join(rng.choice("ab1 2.3@-+()4") for _ in range(80)) for _ in range(200))]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    out = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    for k, t in enumerate(texts):
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, p, ok in PII_BRUTE for m in re.finditer(p, t or "") if ok(m.group())]
        assert out[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert set(spans) <= set(out[k].spans.split(",")) | {""}
    assert pii.find(df.limit(0)).count() == 0


def test_pii_context(spark):
    rows = [(k, f"some words here reach desk phone +1 (555) 010-{k:04d} now and then", "en", "s", 0) for k in range(12)]
    rows.append((99, "other words reach desk phone 0555 0109999 now and again", "en", "s", 0))
    rows.append((100, "in room number 0555 0109999 of the hall", "en", "s", 0))
    out = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(rows, DOC))).collect()}
    assert out[99].n_phone == 0 and out[99].spans == "phone:29:41"
    assert out[100].spans == ""
    red = {r.doc_id: r for r in pii.redacted(spark.createDataFrame(rows, DOC), ("doc_id", "text", "lang", "source", "n_chars")).collect()}
    assert red[99].text == "other words reach desk phone <phone> now and again" and red[99].n_chars == len(red[99].text)


def test_pii_patterns_of_found_instances(spark):
    """Numbers found in the seeds' context induce a context that no seed has, and that one names others."""
    rows = [f"some words reach desk phone +1 (555) 010-{k:04d} now and then" for k in range(12)]
    rows += [f"some words reach desk phone 0555 01{k:05d} now and then" for k in range(8)]
    rows += [f"leave it for night porter 0555 01{k:05d} says he" for k in range(8)] * 2
    rows += ["leave it for night porter 0777 0300001 says she", "in room number 0888 0300001 of the hall", "x" * 100 + "@" + "y" * 100]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(rows)], DOC)
    out = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    assert out[12].startswith("phone:")
    assert out[36].startswith("phone:") and out[37] == "" and out[38] == ""
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    by_map = {r.doc_id: r.text for r in pii.redacted(df, columns).collect()}
    assert "<phone> says she" in by_map[36]
    monkey, pii.SEND_PATTERNS = pii.SEND_PATTERNS, 0
    try:
        assert {r.doc_id: r.text for r in pii.redacted(df, columns).collect()} == by_map
    finally:
        pii.SEND_PATTERNS = monkey


def test_pii_of_odd_rows(spark):
    rows = [(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co"), (2, None), (3, "z " * 50_000 + "a@b.co")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).selectExpr("*", "1 as row", "2 as kind", "3 as base", "4 as found")
    out = sorted((str(r.doc_id), r.n_email, r.spans) for r in pii.digest(pii.find(df)).collect())
    assert out == [("1", 1, "email:0:6")] * 2 + [("2", 0, ""), ("3", 1, "email:100000:100006"), ("None", 1, "email:0:6")]


def test_quality(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + rng.choice(WORDS)[1:].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)) + "." for _ in range(300)]
    bad = [" ".join(f"{w}{m}" for w in _text(rng, 60).split()) for m in ("!!", "***", "%%%") for _ in range(12)]
    bad = [b.upper() if "!!" in b else b for b in bad]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate([*good, *bad, "", None, "short"])]
    out = {r.doc_id: r for r in quality.score_documents(spark.createDataFrame(rows, DOC)).collect()}
    assert all(out[k].kept for k in range(300)) and not any(out[k].kept for k in range(300, 336))
    assert out[336].score == 0.0 and out[337].score == 0.0 and out[338].score is not None
    assert quality.score_documents(spark.createDataFrame([], DOC)).count() == 0


def test_quality_of_odd_rows(spark, monkeypatch):
    rng = random.Random(24)
    good = " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(50))
    rows = [(None, good), (1, good), (1, good), (2, good + " !!! *** ###" * 30), (3, " ".join([good] * 400)), (4, " \n "), *((k, good[k:]) for k in range(10, 40))]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).selectExpr("*", "1 as key", "2 as part", "'a' as kept", "3 as y")
    for entries in (1 << 23, 500):
        monkeypatch.setattr(quality, "TRAIN_ENTRIES", entries)
        out = quality.score_documents(df).collect()
        assert len(out) == len(rows) and not any(r.kept for r in out if r.doc_id == 4) and all(r.kept for r in out if r.doc_id in (None, 1))
    kept = quality.kept_documents(df, ("doc_id", "text", "n_chars")).collect()
    assert sorted(str(r.doc_id) for r in kept).count("1") == 2 and any(r.doc_id is None for r in kept) and all(r.doc_id != 4 for r in kept)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(5)
    n, k = 60_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    right_good, right_bad = rng.uniform(0.85, 0.99, k), rng.uniform(0.3, 0.9, k)
    right = rng.random((n, k)) < np.where(good[:, None], right_good, right_bad)
    vote = np.where(rng.random((n, k)) < 0.1, -1, np.where(right, good[:, None], ~good[:, None])).astype(np.int8)
    codes, at, counts = np.unique(quality._code(vote), return_inverse=True, return_counts=True)
    post, found = quality.expectation_maximisation(quality._uncode(codes), counts.astype(float))
    assert abs(found["share"] - 0.8) < 0.02
    assert np.abs(found["right_good"] - right_good).max() < 0.02 and np.abs(found["right_bad"] - right_bad).max() < 0.04
    assert ((post[at] >= 0.5) == good).mean() > 0.93


def _vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows = []
    for k in range(240):
        rows.append((k, (base[k % 20] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.4])).tolist(), int(k % 3)))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, rows[0][1], 0), (506, [2 * x for x in rows[0][1]], 0), (507, [1.0, 2.0], 0), (508, [], 0)]
    return rows


def test_embedding_dedup_of_odd_rows(spark):
    v, w = [3.0, 4.0, 0.0], [0.0, 0.0, 7.0]
    rows = [(0, v, 1), (1, v, 1), (1, w, 1), (2, w, 1), (3, [1e200 * x for x in v], 1), (4, [1e-200 * x for x in w], 1), (5, [5e-324, 0.0, 0.0], 1), (None, v, 1), (7, v * 700, 1), (8, v * 700, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as key", "2 as node", "3 as d", "4 as rep")
    out = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
    assert out == sorted([("0", 2, 0), ("1", 2, 0), ("1", 2, 0), ("2", 2, 0), ("3", 2, 0), ("4", 2, 0), ("5", 0, 5), ("None", 0, None), ("7", 1, 7), ("8", 1, 7)])


@pytest.mark.parametrize("tile", [512, 3])
def test_embedding_dedup(spark, monkeypatch, tile):
    # Tiles of three rows make grids of several dimensions and groups of many tiles.
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(embed_dedup, "GROUP", 5)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    ok = {i: np.array(v, float) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and np.any(v)}
    lab = {i: x for i, _, x in rows}
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(ok, 2):
        x, y = ok[a], ok[b]
        if lab[a] == lab[b] and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
            links[a].add(b), links[b].add(a)
    seen = {}
    for i in sorted(out):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {i: (len(links[i]), seen[i], seen[i] == i) for i in out}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_tiles_are_read_a_few_at_a_time(spark, monkeypatch):
    # A reader that makes room for 4,096 rows of a tile's size takes gigabytes.
    seen, compare = [], embed_dedup._compare

    def watched(near, tiles, *rest):
        seen.append(int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) * tiles.selectExpr("max(length(vectors)) n").first().n)
        return compare(near, tiles, *rest)

    monkeypatch.setattr(embed_dedup, "_compare", watched)
    x = np.random.default_rng(1).standard_normal((600, 64))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    assert embed_dedup.near_duplicates(df).where("kept").count() == 600
    assert seen and max(seen) <= 64 << 20


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, _text(rng, 30)) for k in range(5)] + [(9, "too short"), (10, None)]
    edited = items[1][1].split()
    edited[7], edited[19] = "changed", "words"
    docs = [_text(rng, 100) + " " + items[0][1].upper().replace(" ", ", ") + " " + _text(rng, 50), _text(rng, 40) + " " + " ".join(edited), _text(rng, 200), "", None, " ".join(items[2][1].split()[:12])]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(docs)], DOC)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(out) == {(0, 0), (1, 1)} and out[0, 0].similarity == 1.0 and 0.8 <= out[1, 1].similarity < 1
    assert (out[0, 0].start_word, out[0, 0].end_word) == (100, 130)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def _plain_similarity(item, text):
    h = [0.0] * (len(text) + 1)
    best = 0.0
    for x in item:
        now = [0.0]
        for j, y in enumerate(text, 1):
            now.append(max(0, h[j - 1] + (1 if x == y else -0.25), h[j] - 0.25, now[-1] - 0.25))
        h, best = now, max(best, max(now))
    return best / len(item)


def test_decontamination_against_plain_alignment(spark):
    rng = random.Random(18)
    # Words of the items are frequent in the other texts too.
    few = WORDS[:150]
    items = [[rng.choice(few) for _ in range(n)] for n in (60, 40, 8, 9, 25)]

    def inserted(words, every):
        return [x for k, w in enumerate(words) for x in ([w, "new"] if k % every == every - 1 else [w])]

    copies = [inserted(items[0], 3), inserted(items[0], 2), items[1][:20] + ["new"] * 24 + items[1][20:], inserted(items[2], 2), inserted(items[3], 3)]
    for item in items:
        for _ in range(8):
            words, edits = [], rng.choice([0.05, 0.15, 0.3, 0.6])
            for w in item:
                kind = rng.choice(["put", "put", "put", "swap", "drop"]) if rng.random() < edits else ""
                words += [w] * (kind in ("", "put")) + [rng.choice(few)] * (kind in ("put", "swap"))
            copies.append(words)
    texts = [[rng.choice(few) for _ in range(30)] + c + [rng.choice(few) for _ in range(30)] for c in copies] + [[rng.choice(few) for _ in range(100)] for _ in range(60)]
    df = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], DOC)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    out = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.contaminated(df, bench).collect()}
    plain = {(d, i): _plain_similarity(item, t) for d, t in enumerate(texts) for i, item in enumerate(items)}
    assert out == {k: round(x, 6) for k, x in plain.items() if x >= 0.8 - 1e-9}
    assert {(0, 0), (1, 0), (2, 1)} <= set(out)


def test_alignment_against_plain_tables():
    rng = random.Random(1)
    for _ in range(40):
        a, b = ([rng.randrange(1, 5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if x == y else -0.25), h[i - 1, j] - 0.25, h[i, j - 1] - 0.25)
        best, _ = decontaminate.align([np.array(a, np.uint64)], [np.array(b, np.uint64)])
        assert abs(best[0] - h.max()) < 1e-9


def test_packing(spark):
    rng = random.Random(8)
    texts = [_text(rng, rng.choice([1, 5, 50, 400, 3000]) + rng.randrange(300)) for _ in range(160)] + ["", None, "It's <|endoftext|> é中文 İ", "x" * 500]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(df, path).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r), by_seq[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) <= math.ceil(sum(r.length for r in rows) / 4096) + 1
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_fill_is_best():
    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        counts = collections.Counter(items)
        room = rng.randrange(1, 120)
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        got = packing.fill(sorted(counts), dict(counts), room)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


def test_fill_of_many_lengths():
    lengths = [*range(1, 101), *range(1400, 2041)]
    counts = dict.fromkeys(lengths, 3)
    for room in (2196, 2600, 1399, 90):
        got = packing.fill(lengths, counts, room)
        assert sum(n * k for n, k in got.items()) == room and all(k <= counts[n] for n, k in got.items())
    sizes = np.array([n for n in lengths for _ in range(8)])
    sequence, _ = packing.pack(sizes)
    filled = np.bincount(sequence, weights=sizes)
    # Two long pieces, and short ones where the room is left, until those run out.
    assert (filled[:20] == 4096).all()


def test_tokenizer_on_many_words():
    coder = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeéÉßæøÿ ñ.,!-12'\t\n") for _ in range(rng.randrange(0, 120))) for _ in range(400)]
    ids, first = coder.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == coder.library.encode(t, add_special_tokens=False).ids


def test_substring_dedup(spark):
    rng = random.Random(12)
    passage, rest = _text(rng, 60), [_text(rng, 150) for _ in range(12)]
    texts = [" ".join(r.split()[: 20 + k]) + " " + passage + "\n" + " ".join(r.split()[20 + k :]) if k < 8 else r for k, r in enumerate(rest)] + ["", None, "few words only"]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    rows = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == set(range(8))
    assert {r.doc_id for r in rows if r.kept} == {0} and all(r.component_id == 0 for r in rows)
    for r in rows:
        # A paragraph that is similar enough may reach past the passage by a few words.
        assert 17 + r.doc_id <= r.start_word < r.end_word <= 83 + r.doc_id
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_substring_dedup_of_repeating_words(spark):
    rng = random.Random(15)
    line = _text(rng, 10)
    texts = [" ".join([_text(rng, 60 + k), *[line] * 20, _text(rng, 70)]) for k in range(2)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    rows = substring_dedup.repeated_passages(df).collect()
    for k in range(2):
        covered = {w for r in rows if r.doc_id == k for w in range(r.start_word, r.end_word)}
        assert not set(range(60 + k + 9, 260 + k - 9)) - covered and not covered - set(range(50 + k, 270 + k))
    assert {r.kept for r in rows if r.doc_id == 0} == {True} and {r.kept for r in rows if r.doc_id == 1} == {False}


def _variants(rng, n):
    """25 words, each time with one of the first two or last two words changed, or one of both: all within 0.8 of a neighbour, few of any one."""
    base, out = rng.sample(WORDS, 25), [[]]
    for k in range(n):
        words = list(base)
        for at in rng.choice([(0,), (24,), (1,), (23,), (0, 24)]):
            words[at] = f"v{rng.randrange(n // 4)}"
        out.append(words)
    return [" ".join(w) for w in out[1:]]


def _brute_links(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(sets))]


def test_links_of_full_buckets():
    rng = random.Random(16)
    for most in (25, 40, 400):
        sets = []
        for _ in range(300):
            own = rng.sample(range(most), 21) if not sets or rng.random() < 0.3 else [x for x in rng.choice(sets) if rng.random() > 0.1] + rng.sample(range(most), 2)
            sets.append(set(own) or {0})
        parent = list(range(len(sets)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in substring_dedup._forest([np.array(sorted(s), np.uint32) for s in sets], 0.8):
            assert find(i) != find(j)
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
        assert [find(i) for i in range(len(sets))] == _brute_links(sets)


@pytest.mark.parametrize("block", [4096, 64])
def test_substring_dedup_of_many_variants(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_CLASSES", block)
    rng = random.Random(17)
    texts = [v for _ in range(3) for v in _variants(rng, 150)]
    words = [t.split() for t in texts]
    root = _brute_links([{tuple(w[k : k + 5]) for k in range(21)} for w in words])
    size = collections.Counter(root)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    rows = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(k, x) for k, x in enumerate(root) if size[x] > 1}


def test_recall_of_similar_paragraphs(spark):
    """Pairs of one paragraph each: the last words changed, so that Jaccard is 0.8, 0.83 and 0.91; below 0.8 none may be found."""
    rng = random.Random(28)
    levels, texts = [(22, 2), (25, 2), (25, 1), (20, 2)], []
    for words, edits in levels:
        for _ in range(500):
            own = [f"w{rng.randrange(1 << 30)}" for _ in range(words)]
            again = list(own)
            again[-edits] = "other"
            texts += [" ".join(own), " ".join(again)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    found = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
    recall = [sum(1000 * k + 2 * j in found for j in range(500)) / 500 for k in range(4)]
    assert recall[0] >= 0.97 and recall[1] >= 0.98 and recall[2] >= 0.99 and recall[3] == 0, recall
    print("recall", recall)


def test_tune_bands():
    bands, rows = substring_dedup.tune_bands(0.8, 0.98)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.98


def _lm_brute(rows):
    tok = {i: [*_brute_words(t), None] for i, t in rows}
    count = collections.Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    return {i: (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tok.items()}


@pytest.mark.parametrize("page", [1 << 26, 1 << 10])
def test_lm_scoring(spark, page):
    rng = random.Random(4)
    rows = [(k, _text(rng, rng.randrange(0, 50))) for k in range(150)] + [(900, ""), (901, None), (902, "  ")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC)
    out = lm_score.score_documents(df, page_bytes=page).collect()
    want = _lm_brute(rows)
    for r in out:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-9 * max(1, abs(base))
        assert r.score <= 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert lm_score.score_documents(df.limit(0)).count() == 0


def _bigram_brute(rows, mu):
    """The score of each text under exact bigram counts, quantised to powers of two or not."""
    tok = {i: [*_brute_words(t), None] for i, t in rows}
    train = [t for i, t in tok.items() if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<"] + t[:-1], t, strict=True))
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t in tok.items():
        total = 0
        for h, w in zip(["<"] + t[:-1], t, strict=True):
            k = pairs[h, w]
            above = len(train) if h == "<" else count[h]
            total += math.log10(((2 ** (k.bit_length() - 1) if k else 0) + mu * (count[w] + 0.1) / (n + 0.1 * (v + 1))) / (above + mu))
        out[i] = total
    return out


@pytest.mark.parametrize("page", [1 << 26, 1])
def test_lm_scores_against_plain_counts(spark, page):
    rng = random.Random(25)
    rows = [(k, " ".join(rng.choice(WORDS[: rng.choice([5, 40, 400])]) for _ in range(60))) for k in range(400)] + [(900, "never seen words"), (901, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).selectExpr("*", "1 as chunk", "2 as part", "3 as levels")
    out = lm_score.score_documents(df, page_bytes=page).collect()
    want = _bigram_brute(rows, out[0].mu)
    off = [r.score - want[r.doc_id] for r in out]
    # A false positive, about 1 % a level, can only raise a pair's count.
    assert min(off) > -1e-6 and sum(abs(x) < 1e-6 for x in off) > 0.5 * len(off)
    assert sum(off) < 0.01 * abs(sum(want.values()))


def test_false_positives_of_the_filter():
    rng = np.random.default_rng(3)
    for n in (1_000, 200_000):
        keys = rng.integers(0, 1 << lm_score.KEY_BITS, 2 * n, dtype=np.uint64)
        total = rng.geometric(0.4, n).astype(float)
        page = lm_score._page(keys[:n], total)
        ask = lambda k: lm_score._levels(k, page, np.zeros(len(k), np.int64), np.full(len(k), 8 * len(page)))  # noqa: B023, E731
        exact = np.floor(np.log2(total)) + 1
        assert (ask(keys[:n]) >= exact).all() and (ask(keys[:n]) > exact).mean() < 0.02
        assert (ask(keys[n:]) > 0).mean() < 0.02


def test_sharding(spark):
    df = spark.createDataFrame([(k, "x" * (k % 50), "en", "s", 0) for k in range(2000)] + [(None, None, "en", "s", 0), (7, "again", "en", "s", 0)], DOC)
    rows = sharding.shard_rows(df, [1.0] * 16, [1.0] * 17).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
        if r.doc_id is not None and r.doc_id != 7:
            text = "x" * (r.doc_id % 50)
            assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text.encode())
    assert len(rows) == 2002 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 60 < min(map(len, slots.values())) and max(map(len, slots.values())) < 200
    moved = sum(r.grown_shard == 16 for r in rows) / len(rows)
    assert 0.03 < moved < 0.1
    heavy = sharding.shard_rows(df, [1.0, 3.0], [1.0, 3.0]).where("shard = 1").count() / len(rows)
    assert 0.68 < heavy < 0.82


def test_toxicity(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for k in range(600):
        parts = [_text(rng, 8).translate(str.maketrans("0123456789", "abcdefghij")) + "." for _ in range(4)]
        bad = k % 6 == 0
        if bad:
            parts[k % 4] = "you are a vilewretch today."
        rows.append((k, " ".join(parts), "en", "s", 0)), labels.append((k, 1, int(bad)))
    rows += [(1000, "", "en", "s", 0), (1001, None, "en", "s", 0)]
    df, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(df, lab).collect()}
    held = [k for k in range(600) if out[k].held_out]
    assert sum((out[k].predicted == 1) == (k % 6 == 0) for k in held) >= 0.97 * len(held)
    hit = next(k for k in held if k % 6 == 0 and out[k].predicted)
    text = rows[hit][1]
    assert any("vilewretch" in text[o.start : o.end] for o in out[hit].offending)
    assert out[1000].score == out[1001].score == 0.0
    assert toxicity.score_documents(df, lab.limit(0)).where("score > 0.01").count() == 0
    assert toxicity.score_documents(df.limit(0), lab).count() == 0


def test_toxicity_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 200)
    rng = random.Random(26)
    rows = [(k, _text(rng, 30) + (". you are a vilewretch." if k % 4 == 0 else ".")) for k in range(200)]
    rows += [(8, rows[8][1])] * 300 + [(None, "you are a vilewretch."), (900, "fine words. " * 20_000), (901, None)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).selectExpr("*", "1 as label", "2 as score", "3 as part")
    lab = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(5, 1, None), (None, 1, 1), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(df, lab).collect()
    assert len(out) == len(rows)
    assert {r.predicted for r in out if r.doc_id in (8, None)} == {1} and {r.predicted for r in out if r.doc_id in (900, 901)} == {0}


def test_sharding_of_odd_rows(spark):
    assert sharding.shard_rows(spark.createDataFrame([], DOC), [1.0] * 16, [1.0] * 17).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (2, "é" * 100_000)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).selectExpr("*", "1 as shard", "2 as slot", "3 as size")
    out = sharding.shard_rows(df, [1.0] * 16, [1.0] * 17).collect()
    assert len(out) == 5 and len({r.shard for r in out if r.doc_id == 1}) == 1
    assert {r["size"] for r in out if r.doc_id == 2} == {200_001} and {r["size"] for r in out if r.doc_id is None} == {1}


def test_packing_decontamination_and_passages_of_odd_rows(spark):
    rng = random.Random(27)
    item = _text(rng, 30)
    long_text = _text(rng, 30_000)
    rows = [(None, item), (1, "x " + item), (1, "x " + item), (2, ""), (3, None), (4, long_text + " " + item), (5, long_text)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC).selectExpr("*", "1 as item", "2 as part", "3 as word", "4 as pos")
    hits = decontaminate.contaminated(df, spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in hits} == {None, 1, 4} and {r.item_id for r in hits} == {7}
    pieces = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len([r for r in pieces if r.doc_id == 1]) == 2 and sum(r.length for r in pieces if r.doc_id == 5) == next(r.doc_tokens for r in pieces if r.doc_id == 5)
    assert [(r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id in (2, 3)] == [(0, 1, 1)] * 2
    spans = substring_dedup.repeated_passages(df).collect()
    covered = {k: {w for r in spans if r.doc_id == k for w in range(r.start_word, r.end_word)} for k in (4, 5)}
    assert all(len(c) > 29_900 for c in covered.values()) and not any(r.doc_id is None for r in spans)


def test_word_hashes_match_words():
    w = W.Words([b"The the THE", b"", b"\ta  b\n"])
    assert w.counts.tolist() == [3, 0, 2] and len(set(w.hash[:3].tolist())) == 1
    assert [w.word(k) for k in (3, 4)] == ["a", "b"]
