"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on every text.  The corpus counts of
vote patterns (at most 3**8, whatever the input) go to an expectation-maximisation that
estimates each labeller's accuracy on good and on bad texts and the share of good ones,
without any true label.  The posterior of a text's pattern is its training target for a
linear scorer over hashed words, word shapes and votes; the fit uses at most TRAIN_ROWS
different rows, those of smallest hash, and TRAIN_ENTRIES features of them; every text is
scored.

Null, empty and blank texts get no votes and are rejected with score 0.  Very long texts
are measured whole.  Rows with a null id are scored.  Repeated rows are counted and
scored each, and fitted once.  Ties at the threshold are kept.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import exchange, per_batch, per_task, record, settle, spread
from .linear import first_by_hash, fit_logistic, sigmoid

LABELLERS = ("symbols", "capitals", "variety", "echoes", "shouts", "marks", "separators", "word_length")
#: Of each labeller's measure: good below the first and bad above the second; variety is turned round.
LIMITS = {"symbols": (0.03, 0.07), "capitals": (0.10, 0.30), "variety": (0.60, 0.80), "echoes": (0.05, 0.15), "shouts": (0.02, 0.15), "marks": (0.03, 0.15), "separators": (0.03, 0.15), "word_length": (0.0, 0.0)}
#: Words from which measures over words are taken to say something.
LEAST_WORDS = 16
TRAIN_ROWS, TRAIN_ENTRIES = 8_000, 1 << 23
DIM_BITS = 17
DIMS = 1 << DIM_BITS
THRESHOLD = 0.5
#: Prior accuracy of a labeller on good and on bad texts, worth as many texts of either class, whatever the input.
PRIOR = (0.995, 0.35)
PRIOR_TEXTS = 100


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbol, upper, letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    for b in range(33, 127):
        symbol[b] = not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?!"
    upper[65:91] = True
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return symbol, upper, letter


_SYMBOL, _UPPER, _LETTER = _tables()
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("a")


def _per_doc(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def measures(raws: list[bytes], w: W.Words) -> dict[str, np.ndarray]:
    """Per text, each labeller's measure."""
    data = np.frombuffer(w.bytes, np.uint8)
    low, high = w.doc_start[:-1], w.doc_start[1:] - 1
    words = np.maximum(w.counts, 1)
    size = w.end - w.start
    inked = np.maximum(np.bincount(w.doc, size, len(raws)), 1)
    letters = np.maximum(_per_doc(_LETTER[data], low, high), 1)
    same = np.zeros(len(w), bool)
    if len(w):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    _, doc = W.distinct(w.hash, w.doc)
    distinct = np.bincount(doc, minlength=len(raws))
    last, before = data[w.end - 1], data[np.maximum(w.end - 2, w.start)]
    shout = (last == 33) & (before == 33) & (size > 2)
    triple = (~_LETTER[last]) & (last == before) & (data[np.maximum(w.end - 3, w.start)] == last) & (size > 3) & ~((last >= 48) & (last <= 57))
    return {
        "symbols": _per_doc(_SYMBOL[data], low, high) / inked,
        "capitals": _per_doc(_UPPER[data], low, high) / letters,
        "variety": 1 - np.minimum(distinct / np.minimum(words, 400), 1),
        "echoes": np.bincount(w.doc, same, len(raws)) / words,
        "shouts": np.bincount(w.doc, shout, len(raws)) / words,
        "marks": np.bincount(w.doc, triple, len(raws)) / words,
        "separators": np.bincount(w.doc, (size == 1) & ~_LETTER[last] & ~((last >= 48) & (last <= 57)), len(raws)) / words,
        "word_length": inked / words,
    }


def votes(raws: list[bytes], w: W.Words) -> np.ndarray:
    """One column for each labeller: 1 good, 0 bad, -1 nothing."""
    m = measures(raws, w)
    out = np.full((len(raws), len(LABELLERS)), -1, np.int8)
    enough = w.counts >= LEAST_WORDS
    for k, name in enumerate(LABELLERS):
        x = m[name]
        if name == "word_length":
            good, bad = (x >= 3) & (x <= 10), (x < 2.2) | (x > 14)
        else:
            good, bad = x <= LIMITS[name][0], x > LIMITS[name][1]
        out[good & enough, k] = 1
        out[bad & enough, k] = 0
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """(posterior of good for each pattern, estimates).

    A labeller's vote is independent of the others given the class.  Bad texts are of many
    kinds and each labeller knows one or two, while good texts are alike; the estimates start
    from PRIOR, which says so and counts as PRIOR_TEXTS texts.
    """
    share = 0.85
    right_good, right_bad = np.full(patterns.shape[1], PRIOR[0]), np.full(patterns.shape[1], PRIOR[1])
    said, good = patterns >= 0, patterns == 1
    post = np.ones(len(patterns))
    for _ in range(rounds):
        a = np.where(said, np.where(good, np.log(right_good), np.log1p(-right_good)), 0).sum(axis=1) + np.log(share)
        b = np.where(said, np.where(good, np.log1p(-right_bad), np.log(right_bad)), 0).sum(axis=1) + np.log1p(-share)
        now = sigmoid(a - b)
        if np.abs(now - post).max(initial=0) < 1e-9:
            break
        post = now
        for own, right, prior, agree in ((post, right_good, PRIOR[0], good), (1 - post, right_bad, PRIOR[1], ~good)):
            mass = own * counts
            right[:] = np.clip((mass @ (said & agree) + PRIOR_TEXTS * prior) / (mass @ said + PRIOR_TEXTS), 1e-4, 1 - 1e-4)
        share = float(np.clip((post * counts).sum() / max(1, counts.sum()), 1e-3, 1 - 1e-3))
    return post, {"share": share, "right_good": right_good, "right_bad": right_bad}


def _shape_hashes(w: W.Words) -> np.ndarray:
    """A hash of each word's shape: letters and digits by kind, equal neighbours once, other marks up to three."""
    data = np.frombuffer(w.bytes, np.uint8)
    size = w.end - w.start
    at = spread(w.start, size)
    s = _SHAPE[data[at]]
    begin = np.cumsum(size) - size
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    mark = (s != ord("a")) & (s != ord("A")) & (s != ord("0"))
    keep[2:] |= mark[2:] & (s[2:] == s[1:-1]) & (s[1:-1] != s[:-2])
    keep[begin] = True
    kept = np.cumsum(keep) - 1
    return W.run_hashes(s[keep], kept[begin])


def _entries(raws: list[bytes]):
    """(row, feature, value) of a chunk, and its vote patterns."""
    w = W.Words(raws)
    vote = votes(raws, w)
    row, col, value = [], [], []
    if len(w):
        for h in (w.hash, _shape_hashes(w) ^ np.uint64(0x9FB21C651E98DF25)):
            pair = w.doc * DIMS + (h >> np.uint64(64 - DIM_BITS)).astype(np.int64)
            pair, times = np.unique(pair, return_counts=True)
            row.append(pair // DIMS), col.append(pair % DIMS), value.append(times / w.counts[pair // DIMS])
    named = W.mix(np.arange(3 * len(LABELLERS), dtype=np.uint64) + np.uint64(77)) >> np.uint64(64 - DIM_BITS)
    r = np.repeat(np.arange(len(raws)), len(LABELLERS))
    c = named[(np.arange(len(LABELLERS)) * 3 + vote + 1).reshape(-1)].astype(np.int64)
    on = np.repeat(w.counts > 0, len(LABELLERS))
    row.append(r[on]), col.append(c[on]), value.append(np.ones(int(on.sum())))
    return np.concatenate(row), np.concatenate(col), np.concatenate(value), vote, w.counts


def _code(vote: np.ndarray) -> np.ndarray:
    return (vote.astype(np.int64) + 1) @ (3 ** np.arange(vote.shape[1]))


def _uncode(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def _fit(docs: DataFrame):
    """(posterior of each vote pattern, weights of the scorer), both sent to the tasks; docs: doc_id, text."""
    spark = docs.sparkSession
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key"))

    def vote_rows(batch):
        for at, raws in W.chunks(batch.column(0).to_pylist()):
            w = W.Words(raws)
            code = _code(votes(raws, w))
            yield record(key=batch.column(1).slice(at, len(raws)), code=pa.array(np.where(w.counts > 0, code, -1)))

    voted = settle(per_batch(keyed, "key long, code long", vote_rows), "votes").where("code >= 0")
    table = sorted((r["code"], r["n"]) for r in voted.groupBy("code").agg(F.count("*").alias("n")).collect())
    codes, counts = np.array([c for c, _ in table], np.int64), np.array([n for _, n in table], np.float64)
    post, _ = expectation_maximisation(_uncode(codes), counts) if len(codes) else (np.empty(0), {})
    target = spark.sparkContext.broadcast(dict(zip(codes.tolist(), post.tolist(), strict=True)))
    sample = first_by_hash(voted.select("key").distinct(), "key", TRAIN_ROWS)
    chosen = keyed.join(F.broadcast(sample), "key").select("key", "text")

    def sparse(batch):
        for at, raws in W.chunks(batch.column(1).to_pylist()):
            row, col, value, vote, _ = _entries(raws)
            order = np.argsort(row, kind="stable")
            row, col, value = row[order], col[order], value[order]
            edges = np.searchsorted(row, np.arange(len(raws) + 1))
            y = [target.value.get(c, 0.0) for c in _code(vote).tolist()]
            yield record(key=batch.column(0).slice(at, len(raws)), y=pa.array(y, pa.float64()), col=pa.array([col[edges[k] : edges[k + 1]].astype(np.int32).tobytes() for k in range(len(raws))], pa.binary()), value=pa.array([value[edges[k] : edges[k + 1]].astype(np.float32).tobytes() for k in range(len(raws))], pa.binary()))

    def fitted(batches):
        y, col, value, entries = [], [], [], 0
        for batch in batches:
            for _, target_, c, v in zip(*(x.to_pylist() for x in batch.columns[:4]), strict=True):
                entries += len(c) // 4
                if entries <= TRAIN_ENTRIES:
                    y.append(target_), col.append(np.frombuffer(c, np.int32)), value.append(np.frombuffer(v, np.float32))
        if y:
            w = fit_logistic(np.array([len(c) for c in col]), np.concatenate(col), np.concatenate(value), np.array(y), DIMS)
            yield record(w=pa.array([w.astype(np.float64).tobytes()], pa.binary()))

    # Repeated rows are one before they meet, so one task gets at most TRAIN_ROWS rows; it holds TRAIN_ENTRIES features of them.
    rows = per_batch(chosen, "key long, y double, col binary, value binary", sparse).groupBy("key").agg(F.first("y").alias("y"), F.first("col").alias("col"), F.first("value").alias("value"))
    one = exchange(rows.withColumn("part", F.lit(0)), "part", 1).sortWithinPartitions("key").drop("part")
    got = per_task(one, "w binary", fitted).collect()
    return target, spark.sparkContext.broadcast(np.frombuffer(got[0][0]) if got else np.zeros(DIMS + 1))


def _scored(raws: list[bytes], weights: np.ndarray):
    """(score, votes, words) of each text."""
    row, col, value, vote, counts = _entries(raws)
    return np.where(counts > 0, sigmoid(np.bincount(row, weights[col] * value, len(raws)) + weights[-1]), 0.0), vote, counts


def score_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score, kept, weak_posterior, and votes (labeller order of LABELLERS)."""
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    target, weights = _fit(docs)

    def score(batch):
        for at, raws in W.chunks(batch.column(1).to_pylist()):
            s, vote, counts = _scored(raws, weights.value)
            y = [target.value.get(c, 0.0) if n else 0.0 for c, n in zip(_code(vote).tolist(), counts.tolist(), strict=True)]
            yield record(doc_id=batch.column(0).slice(at, len(raws)), score=pa.array(s), kept=pa.array(s >= threshold), weak_posterior=pa.array(y, pa.float64()), votes=pa.array(vote.astype(np.int32).tolist(), pa.list_(pa.int32())))

    return per_batch(docs, "doc_id long, score double, kept boolean, weak_posterior double, votes array<int>", score)


def kept_documents(documents: DataFrame, columns: tuple[str, ...], id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of the rows that the scorer keeps; each row stands for itself, null and repeated ids included."""
    _, weights = _fit(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))

    def keep(batch):
        for at, raws in W.chunks(batch.column(columns.index(text_column)).to_pylist()):
            yield batch.slice(at, len(raws)).filter(pa.array(_scored(raws, weights.value)[0] >= threshold))

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    return per_batch(documents.select(*columns), ", ".join(f"{c} {kinds[c]}" for c in columns), keep)
