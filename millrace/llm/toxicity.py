"""Toxicity by multiple-instance learning.

Only documents have labels, but sentences are what offends.  A sentence is a bag of
hashed features (its letter runs and their first characters); its score is a logistic
function of them, and a document's score the noisy-or of its sentences,
1 - prod(1 - p), where all sentences without a feature count as one, so that a long clean
text scores like a short one.  Training maximises the documents' likelihood, so that credit goes to
the sentences that explain a label; the same scores then locate offending sentences.

Features are chosen first by how much more often toxic training documents hold them,
counted over all of the sample.  At most TRAIN_ROWS labelled rows are used, those of
smallest key hash; every document is scored.

Null, empty and blank texts have no sentences and score 0.  Labels that are null, or of
unknown documents, are ignored; a document with several labels counts as toxic if one
says so.  Rows with a null id are scored and never trained on.  Repeated rows are
scored each.  Without any label of both kinds every score is 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import exchange, per_batch, per_task, record, settle, shuffle_width
from .linear import Adam, counter_rows, first_by_hash, sigmoid, summed_counters
from .tokens import Runs, sentences

DIM_BITS = 18
DIMS = 1 << DIM_BITS
PREFIXES = (4, 5, 6)
TRAIN_ROWS = 16_000
SELECT = 1024
LEAST_Z = 5.0
THRESHOLD = 0.3


def features(runs: Runs) -> list[np.ndarray]:
    """Hashed feature numbers, one array for each kind, aligned with the runs."""
    return [(h >> np.uint64(64 - DIM_BITS)).astype(np.int64) for h in (runs.hash, *runs.prefix.values())]


def _presence(rows: DataFrame) -> DataFrame:
    """Per task, in how many documents of each label a feature occurs; the last two counters are the documents."""

    def run(batches):
        counts = np.zeros((2, DIMS), np.int64)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for at, raws in W.chunks(batch.column(0).to_pylist()):
                runs = Runs(raws, PREFIXES)
                own = label[at : at + len(raws)]
                docs += np.bincount(own, minlength=2)
                for f in features(runs):
                    pair = np.unique(runs.doc * DIMS + f)
                    for y in (0, 1):
                        counts[y] += np.bincount(pair[own[pair // DIMS] == y] % DIMS, minlength=DIMS)
        flat = np.concatenate([counts.reshape(-1), docs, np.zeros(14, np.int64)])
        yield counter_rows(np.concatenate([flat, np.zeros(-len(flat) % 8, np.int64)]))

    return per_task(rows, "k int, bytes binary", run)


def choose(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Feature number -> position among the chosen, -1 for the rest."""
    n0, n1 = max(1, int(docs[0])), max(1, int(docs[1]))
    p = (counts[0] + counts[1] + 1) / (n0 + n1 + 2)
    z = (counts[1] / n1 - counts[0] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = np.argsort(-z, kind="stable")[:SELECT]
    best = best[z[best] >= LEAST_Z]
    place = np.full(DIMS, -1, np.int32)
    place[best] = np.arange(len(best))
    return place


def _bags(runs: Runs, place: np.ndarray, docs: int):
    """(sentence of each entry, feature of each entry, document of each sentence, first run of each sentence)."""
    head = np.flatnonzero(sentences(runs))
    sentence = np.searchsorted(head, np.arange(len(runs)), "right") - 1
    which, what = [], []
    for f in features(runs):
        own = place[f]
        on = own >= 0
        which.append(sentence[on]), what.append(own[on].astype(np.int64))
    pair = np.unique(np.concatenate(which) * (SELECT + 1) + np.concatenate(what)) if which else np.empty(0, np.int64)
    return pair // (SELECT + 1), pair % (SELECT + 1), runs.doc[head] if len(head) else np.empty(0, np.int64), head


def _train_rows(rows: DataFrame, place) -> DataFrame:
    """(label, sentences, entries): entries are (sentence of the document, feature) pairs."""

    def run(batch):
        label = batch.column(1)
        for at, raws in W.chunks(batch.column(0).to_pylist()):
            runs = Runs(raws, PREFIXES)
            which, what, doc, _ = _bags(runs, place.value, len(raws))
            number = np.bincount(doc, minlength=len(raws))
            base = np.cumsum(number) - number
            own = doc[which]
            edges = np.searchsorted(own, np.arange(len(raws) + 1))
            packed = np.stack([which - base[own], what], axis=1).astype(np.int32)
            yield record(label=label.slice(at, len(raws)), sentences=pa.array(number), entries=pa.array([packed[edges[k] : edges[k + 1]].tobytes() for k in range(len(raws))], pa.binary()))

    return per_batch(rows, "label int, sentences long, entries binary", run)


def fit(label: np.ndarray, number: np.ndarray, entries: list[np.ndarray], size: int, steps: int = 250) -> np.ndarray:
    """Weights, the bias last, that make the labels likely under the noisy-or of sentences."""
    # Sentences without a chosen feature say nothing, however many: those of a document count as one, its leak.
    doc, what, sentence, seen = [], [], [], 0
    plain = number.astype(np.float64)
    for k, e in enumerate(entries):
        if len(e):
            own, inv = np.unique(e[:, 0], return_inverse=True)
            plain[k] -= len(own)
            doc.append(np.full(len(own), k)), what.append(e[:, 1]), sentence.append(inv + seen)
            seen += len(own)
    plain = np.minimum(plain, 1)
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    doc, what, sentence = cat(doc), cat(what), cat(sentence)
    w, opt = np.zeros(size + 1), Adam(size + 1, 0.1)
    w[-1] = -5.0
    for _ in range(steps):
        z = np.bincount(sentence, w[what], seen) + w[-1]
        p, base = sigmoid(z), sigmoid(w[-1:])[0]
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label)) + plain * np.log1p(-base)
        none = np.exp(clean)
        # d loss / d z of a sentence: p if the document is clean, else -p times none / (1 - none).
        scale = np.where(label == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        d = p * scale[doc]
        g = np.append(np.bincount(what, d[sentence], size), d.sum() + (plain * base * scale).sum()) / len(label)
        g[:-1] += 1e-4 * w[:-1]
        w -= opt.step(g)
    return w


def _fitted(train: DataFrame, size: int) -> np.ndarray | None:
    def run(batches):
        label, number, entries = [], [], []
        for batch in batches:
            label.append(batch.column(0).to_numpy(zero_copy_only=False)), number.append(batch.column(1).to_numpy())
            entries += [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column(2).to_pylist()]
        if label:
            yield record(w=pa.array([fit(np.concatenate(label), np.concatenate(number), entries, size).tobytes()], pa.binary()))

    # The sample is bounded, so one task may hold it.
    rows = per_task(exchange(train.withColumn("part", F.lit(0)), "part", 1).select("label", "sentences", "entries"), "w binary", run).collect()
    return np.frombuffer(rows[0][0]) if rows else None


def score_documents(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, offending (sentence, start, end, score; characters)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held)
    known = first_by_hash(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", TRAIN_ROWS)
    # At most TRAIN_ROWS ids, so they can be sent to the texts.  Ids that repeat there may give more rows; only then those are cut.
    sample = settle(docs.join(F.broadcast(known), "doc_id").select("text", "label"), "sample")
    if sample.count() > TRAIN_ROWS:
        sample = settle(sample.limit(TRAIN_ROWS).repartition(shuffle_width(spark)), "sample")
    flat = summed_counters(_presence(sample), 2 * DIMS + 16)
    docs_by_label = flat[2 * DIMS : 2 * DIMS + 2]
    place = choose(flat[: 2 * DIMS].reshape(2, DIMS), docs_by_label)
    size = int(place.max(initial=-1)) + 1
    sent = spark.sparkContext.broadcast(place)
    w = _fitted(settle(_train_rows(sample, sent), "bags"), size) if docs_by_label.min() > 0 else None
    weights = spark.sparkContext.broadcast(w if w is not None else np.append(np.zeros(size), -40.0))

    def run(batch):
        ids = batch.column(0).to_pylist()
        for at, raws in W.chunks(batch.column(1).to_pylist()):
            runs = Runs(raws, PREFIXES)
            which, what, doc, head = _bags(runs, sent.value, len(raws))
            w = weights.value
            p = sigmoid(np.bincount(which, w[what], len(doc)) + w[-1])
            says = np.bincount(which, minlength=len(doc)) > 0
            clean = np.bincount(doc, np.where(says, np.log1p(-np.minimum(p, 1 - 1e-12)), 0), len(raws))
            leak = np.bincount(doc, ~says, len(raws)) > 0
            score = -np.expm1(clean + leak * np.log1p(-sigmoid(w[-1:])[0]))
            found = [[] for _ in raws]
            number = np.cumsum(np.concatenate([[0], np.bincount(doc, minlength=len(raws))]))
            for s in np.flatnonzero(p >= threshold):
                d = int(doc[s])
                raw, base = raws[d], int(runs.doc_start[d])
                low = int(runs.start[head[s]]) - base
                last = int(head[s + 1]) if s + 1 < len(head) and doc[s + 1] == d else int(runs.first[d + 1])
                high = int(runs.end[last - 1]) - base
                begin = len(raw[:low].decode("utf-8", "replace"))
                found[d].append({"sentence": int(s - number[d]), "start": begin, "end": begin + len(raw[low:high].decode("utf-8", "replace")), "score": float(p[s])})
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold for i in ids[at : at + len(raws)]]
            yield record(
                doc_id=pa.array(ids[at : at + len(raws)], pa.int64()), held_out=pa.array(held), score=pa.array(score), predicted=pa.array((score >= threshold).astype(np.int32)),
                offending=pa.array(found, pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
            )

    return per_batch(docs, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<sentence:int,start:int,end:int,score:double>>", run)
