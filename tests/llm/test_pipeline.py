"""The pipeline's stages on the smallest tables, and run() on planted documents against plain Python."""

import collections
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= seen and len(now) > 0.5 * len(seen), name
        seen = now
    assert docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.]example'").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == seen


def test_empty(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def _prose(rng, n):
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    return " ".join(word() for _ in range(n)) + "."


def _shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def _similarity(item, text):
    h, best = [0.0] * (len(text) + 1), 0.0
    for x in item:
        now = [0.0]
        for j, y in enumerate(text, 1):
            now.append(max(0, h[j - 1] + (1 if x == y else -0.25), h[j] - 0.25, now[-1] - 0.25))
        h, best = now, max(best, max(now))
    return best / len(item)


def test_run_on_planted_documents(spark, tmp_path):
    rng = random.Random(31)
    good = [_prose(rng, rng.randrange(70, 120)) for _ in range(100)]
    item = _prose(rng, 30)
    texts = list(enumerate(good))
    edited = good[3].split()
    edited[10] = "zzz"
    texts += [(200, good[0]), (201, good[1].upper()[:1] + good[1][1:]), (202, " ".join(edited)), (203, _prose(rng, 20) + " " + item + " " + _prose(rng, 20)), (204, _prose(rng, 40) + " write to some.one@mail.example or 10.20.30.40 today")]
    # The same text twice with one id, two texts with one id, and rows without an id.
    texts += [(10, good[10]), (11, _prose(rng, 50)), (None, good[12]), (None, _prose(rng, 20) + " " + item), (None, _prose(rng, 60)), (300, _prose(rng, 6000))]
    junk = [(400 + k, " ".join(f"{w}{m}" for w in _prose(rng, 50).split())) for k, m in enumerate(["!!!", "***", "###", "%%%"] * 4)] + [(None, "@@ ## $$ %% ^^ && ** !! ~~ == ++ || // <> {} [] " * 3)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*texts, *junk, (500, ""), (501, None), (502, "   ")]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Columns of the same names as those that stages use are left out.
    docs = docs.withColumns({c: F.lit("x") for c in ("_key", "key", "component_id", "score", "part", "count", "row")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = texts
    named = collections.defaultdict(list)
    for i, t in kept:
        if i is not None:
            named[i].append(t)
    ids = sorted(named)
    sets = {i: [_shingles(t) for t in named[i]] for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(10 * len(x & y) >= 8 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    kept = [(i, min(named[i])) for i in ids if find(i) == i] + [(i, t) for i, t in kept if i is None]
    runs = lambda t: re.findall("[a-z0-9]+", t.lower())
    kept = [(i, t) for i, t in kept if _similarity(runs(item), runs(t)[:200]) < 0.8]
    assert {200, 201, 202, 203}.isdisjoint(i for i, _ in kept) and sum(i is None for i, _ in kept) == 2
    kept = [(i, t.replace("some.one@mail.example", "<email>").replace("10.20.30.40", "<ip>")) for i, t in kept]
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in kept:
        tokens = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(tokens), 4096):
            part = tokens[at : at + 4096]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(tokens)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *own], own, strict=False)) and sum(n for _, n in own) <= 4096
