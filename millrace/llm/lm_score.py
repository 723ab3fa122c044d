"""Language-model scoring with a log-frequency Bloom filter.

The corpus is cut once into chunks of token numbers (`_chunks`).  Unigram counts go
through an exchange by hash range: each chunk asks for its distinct words once and gets
their corpus counts back, so no vocabulary is broadcast and none has to fit anywhere.
Bigram counts of the training texts meet in the same way; each hash range writes its
counts, quantised to powers of two, into its own page of a Bloom filter: an n-gram of
level q is stored q times, under (n-gram, 1) to (n-gram, q).  A lookup probes level
after level until one is missing.  A page has ENTRY_BITS bits for each entry, so that its
error rate, about 1 % a level, is the same at every size.

A filter that cannot pass `page_bytes` is broadcast and probed where the texts are.  The
pages of a larger one stay in the tasks that own their hash ranges, which answer each
chunk's distinct n-grams in the exchange that brings the counts: one pass, whatever the
size, and the same probes of the same bits.

    P(w | h) = (k + mu * P0(w)) / (c(h) + mu)
    k = min(2 ** (q(h, w) - 1) [q > 0], c(h), c(w))
    P0(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

mu is the value of MU under which the training texts, each token left out of its own
counts, are likeliest; the sum runs over all of them.

Null and empty texts are the end token alone; very long ones are scored whole.  A null id
counts as the empty text in the held-out rule.  Repeated rows are scored and counted
each.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_rows, exchange, forget, per_batch, per_task, record, settle, shuffle_width

END = np.uint64(0x9AE16A3B2F90404F)
BEGIN = np.uint64(0xC949D7C7509E6557)
CHUNK_TOKENS = 150_000
MU = (10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0)
#: Of the filter: bits for each entry, probes for each level, bytes up to which it is broadcast.
ENTRY_BITS, PROBES, PAGE_BYTES = 10, 5, 1 << 25
KEY_BITS = 48
SMOOTH = 0.1


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _chunks(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    def run(batches):
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, ids, n, number = [], [], 0, 0

        def out():
            h = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([x[1] for x in held]).astype(np.int32)
            out_flags = np.array([held_out(i, folds, fold) for i in ids], bool)
            vocab, token, total = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-total, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            vocab, token = vocab[order], rank[token]
            train = np.repeat(~out_flags, lengths)
            counts = np.bincount(token[train], minlength=len(vocab)).astype(np.uint32)
            return record(
                chunk=pa.array([part + number]), ids=pa.array([ids], pa.list_(pa.int64())), held=pa.array([out_flags.tobytes()], pa.binary()), lengths=pa.array([lengths.tobytes()], pa.binary()),
                low=pa.array([(token & 0xFFFF).astype(np.uint16).tobytes()], pa.binary()), high=pa.array([(token >> 16).astype(np.uint8 if len(vocab) < 1 << 24 else np.uint32).tobytes()], pa.binary()),
                vocab=pa.array([vocab.tobytes()], pa.binary()), counts=pa.array([counts.tobytes()], pa.binary()), tokens=pa.array([len(token)]),
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, raws in W.chunks(batch.column(1).to_pylist()):
                w = W.Words(raws)
                held.append((np.insert(w.hash, w.first[1:], END), w.counts + 1))
                ids += names[at : at + len(raws)]
                n += len(held[-1][0])
                if n >= CHUNK_TOKENS:
                    yield out()
                    held, ids, n, number = [], [], 0, number + 1
        if ids:
            yield out()

    return per_task(docs, "chunk long, ids array<long>, held binary, lengths binary, low binary, high binary, vocab binary, counts binary, tokens long", run)


class _Chunk:
    def __init__(self, held, lengths, low, high, vocab):
        self.held, self.lengths, self.vocab = np.frombuffer(held, bool), np.frombuffer(lengths, np.int32), np.frombuffer(vocab, np.uint64)
        low = np.frombuffer(low, np.uint16)
        high = np.frombuffer(high, np.uint8 if len(self.vocab) < 1 << 24 else np.uint32)
        self.token = low.astype(np.int64) | (high.astype(np.int64) << 16)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.train = np.repeat(~self.held, self.lengths)

    def bigrams(self) -> np.ndarray:
        """A key of KEY_BITS bits for each token and the one before it."""
        h = self.vocab[self.token]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = BEGIN
        return W.mix(before * W._BASE + h) >> np.uint64(64 - KEY_BITS)


def _ranges(sorted_parts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.searchsorted(sorted_parts, np.arange(width + 1))
    used = np.flatnonzero(np.diff(edges))
    return used, edges


def _part(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The hash range, 0 to width - 1, of each key; follows the keys' order."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def _word_counts(chunks: DataFrame, width: int) -> DataFrame:
    """Rows (chunk, part, counts): corpus counts of a chunk's words in hash order; chunk -1 holds (n, v) of a part."""

    def ask(batch):
        for chunk, vocab, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            vocab, counts = np.frombuffer(vocab, np.uint64), np.frombuffer(counts, np.uint32)
            order = np.argsort(vocab)
            vocab, counts = vocab[order], counts[order]
            used, edges = _ranges(_part(vocab, 64, width), width)
            yield record(part=pa.array(used, pa.int32()), chunk=pa.array([chunk] * len(used), pa.int64()), keys=pa.array([vocab[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary()), counts=pa.array([counts[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary()))

    def answer(batches):
        part, chunk, keys, counts = [], [], [], []
        for batch in batches:
            p, c, k, n = (x.to_pylist() for x in batch.columns)
            part += p
            chunk += c
            keys += [np.frombuffer(x, np.uint64) for x in k]
            counts += [np.frombuffer(x, np.uint32) for x in n]
        if not part:
            return
        own, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        wide = total.max(initial=0) >= 1 << 32
        for k in range(len(part)):
            got = total[inv[ends[k] - len(keys[k]) : ends[k]]]
            yield record(chunk=pa.array([chunk[k]]), part=pa.array([part[k]], pa.int32()), counts=pa.array([got.astype(np.uint32).tobytes() if not wide else got.tobytes()], pa.binary()), wide=pa.array([wide]), n=pa.array([0]), v=pa.array([0]))
        yield record(chunk=pa.array([-1]), part=pa.array([part[0]], pa.int32()), counts=pa.array([b""], pa.binary()), wide=pa.array([wide]), n=pa.array([int(total.sum())]), v=pa.array([int((total > 0).sum())]))

    asked = per_batch(chunks.select("chunk", "vocab", "counts"), "part int, chunk long, keys binary, counts binary", ask)
    return per_task(exchange(asked, "part", width), "chunk long, part int, counts binary, wide boolean, n long, v long", answer)


def _page(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The filter's page of a hash range, as bytes: its keys' counts, quantised."""
    level = np.where(total > 0, np.floor(np.log2(np.maximum(total, 1))).astype(np.int64) + 1, 0)
    bits = np.zeros(max(64, int(level.sum()) * ENTRY_BITS + 7 & ~7), bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= q]
        for probe in range(PROBES):
            bits[_place(own, q, probe, len(bits))] = True
    return np.packbits(bits)


def _place(keys: np.ndarray, level: int, probe: int, bits) -> np.ndarray:
    h = W.mix(keys + np.uint64((level * 64 + probe) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((h >> np.uint64(32)) * np.asarray(bits, np.uint64) >> np.uint64(32)).astype(np.int64)


def _levels(keys: np.ndarray, pages: np.ndarray, base: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Quantised levels of keys by repeated membership probes; base and bits: first bit and size of each key's page."""
    level = np.zeros(len(keys), np.int64)
    live = np.flatnonzero(bits > 0)
    q = 1
    while len(live):
        for probe in range(PROBES):
            at = base[live] + _place(keys[live], q, probe, bits[live])
            live = live[(pages[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
        level[live] = q
        q += 1
    return level


def _asks(chunks: DataFrame, width: int) -> DataFrame:
    """Rows (part, chunk, high, low, counts): a chunk's distinct bigrams by hash range, with their counts in training texts."""

    def run(batch):
        for chunk, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = _Chunk(*rest)
            keys, at = np.unique(c.bigrams(), return_inverse=True)
            counts = np.bincount(at[c.train], minlength=len(keys))
            used, edges = _ranges(_part(keys, KEY_BITS, width), width)
            cut = lambda x: pa.array([x[edges[k] : edges[k + 1]].tobytes() for k in used], pa.binary())  # noqa: B023, E731
            yield record(
                part=pa.array(used, pa.int32()), chunk=pa.array([chunk] * len(used), pa.int64()), high=cut((keys >> np.uint64(16)).astype(np.uint32)), low=cut((keys & np.uint64(0xFFFF)).astype(np.uint16)),
                counts=pa.array([zlib.compress(counts[edges[k] : edges[k + 1]].astype(np.uint32).tobytes(), 1) for k in used], pa.binary()),
            )

    asked = per_batch(chunks.select("chunk", "held", "lengths", "low", "high", "vocab"), "part int, chunk long, high binary, low binary, counts binary", run)
    return exchange(asked, "part", width)


def _owned(asks: DataFrame, answer: bool) -> DataFrame:
    """Rows (chunk, part, bytes): the levels of what each chunk asked for, or with chunk -1 the filter's pages."""

    def run(batches):
        part, chunk, keys, counts = None, [], [], []
        for batch in batches:
            for p, c, high, low, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                part = p
                chunk.append(c)
                keys.append((np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16)) | np.frombuffer(low, np.uint16))
                counts.append(np.frombuffer(zlib.decompress(n), np.uint32))
        if part is None:
            return
        ends = np.cumsum([len(k) for k in keys])
        keys, inv = np.unique(np.concatenate(keys), return_inverse=True)
        page = _page(keys, np.bincount(inv, weights=np.concatenate(counts)))
        if not answer:
            yield record(chunk=pa.array([-1]), part=pa.array([part], pa.int32()), bytes=pa.array([page.tobytes()], pa.binary()))
            return
        level = _levels(keys, page, np.zeros(len(keys), np.int64), np.full(len(keys), len(page) * 8)).astype(np.uint8)
        for c, low, high in zip(chunk, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield record(chunk=pa.array([c]), part=pa.array([part], pa.int32()), bytes=pa.array([zlib.compress(level[inv[low:high]].tobytes(), 1)], pa.binary()))

    return per_task(asks, "chunk long, part int, bytes binary", run)


class _Filter:
    """All pages of a filter that is broadcast."""

    def __init__(self, pages: dict[int, bytes], width: int):
        self.width = width
        self.bits = np.array([8 * len(pages.get(k, b"")) for k in range(width)], np.int64)
        self.base = np.cumsum(self.bits) - self.bits
        self.pages = np.frombuffer(b"".join(pages.get(k, b"") for k in range(width)), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        part = _part(keys, KEY_BITS, self.width)
        return _levels(keys, self.pages, self.base[part], self.bits[part])


def _texts(chunk: _Chunk, counts: np.ndarray, level: np.ndarray, inv: np.ndarray, n: int, v: int):
    """Per text: known tokens, base score, and the score under each mu; and the left-out sums over training tokens."""
    floor = n + SMOOTH * (v + 1)
    c = counts[chunk.token]
    base = (c + SMOOTH) / floor
    known = np.add.reduceat((c > 0).astype(np.int64), chunk.starts)
    plain = np.add.reduceat(np.log10(base), chunk.starts)
    history = np.empty(len(c), np.float64)
    history[1:] = c[:-1]
    history[chunk.starts] = counts[np.flatnonzero(chunk.vocab == END)[0]]
    # A pair is no more frequent than either of its words; a false positive may say so.
    pair = np.minimum(np.minimum(np.where(level > 0, 2.0 ** (level - 1), 0.0)[inv], history), c)
    t = chunk.train
    less, rest, above = (c[t] - 1 + SMOOTH) / floor, np.maximum(pair[t] - 1, 0), np.maximum(history[t] - 1, 0)
    scores, left = [], []
    for mu in MU:
        scores.append(np.add.reduceat(np.log10((pair + mu * base) / (history + mu)), chunk.starts))
        left.append(float(np.log10((rest + mu * less) / (above + mu)).sum()))
    return known, plain, scores, left


def score_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 10, fold: int = 0, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mu."""
    spark = documents.sparkSession
    width = shuffle_width(spark)
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    chunks = settle(_chunks(docs, folds, fold), "chunks")
    # A chunk is a row of some megabytes, so Python gets them one by one.
    with arrow_rows(spark, 1):
        scored, n = _all_scored(chunks, width, page_bytes)
    forget(chunks)
    sums = scored.where("left is not null").agg(*(F.sum(F.col("left")[k]) for k in range(len(MU)))).first()
    best = max(range(len(MU)), key=lambda k: (sums[k] if sums[k] is not None else 0.0, k))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"), F.lit(MU[best]).alias("mu"))


def _all_scored(chunks: DataFrame, width: int, page_bytes: int) -> tuple[DataFrame, int]:
    spark = chunks.sparkSession
    answers = settle(_word_counts(chunks, width), "answers")
    n, v = answers.where("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    # A bigram has no more entries than occurrences, so n bounds the filter.
    if n * ENTRY_BITS // 8 <= page_bytes:
        pages = {k: bits for _, k, bits in _owned(_asks(chunks, width), False).toLocalIterator()}
        sent, levels = spark.sparkContext.broadcast(_Filter(pages, width)), None
    else:
        sent, levels = None, settle(_owned(_asks(chunks, width), True), "levels")
    scored = settle(_scored(chunks, answers, levels, sent, n, v), "scored")
    for old in (answers, levels):
        if old is not None:
            forget(old)
    return scored, n


def _scored(chunks, answers, levels: DataFrame | None, sent, n, v) -> DataFrame:
    counts = answers.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "counts", "wide"))).alias("answers"))
    rows = chunks.select("chunk", "ids", "held", "lengths", "low", "high", "vocab").join(counts, "chunk")
    if levels is not None:
        rows = rows.join(levels.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "bytes"))).alias("levels")), "chunk")

    def run(batch):
        for _, ids, held, lengths, low, high, vocab, got, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = _Chunk(held, lengths, low, high, vocab)
            by_hash = np.concatenate([np.frombuffer(a["counts"], np.int64 if a["wide"] else np.uint32) for a in got]).astype(np.float64)
            counts = np.empty(len(by_hash))
            counts[np.argsort(c.vocab)] = by_hash
            keys, inv = np.unique(c.bigrams(), return_inverse=True)
            level = np.concatenate([np.frombuffer(zlib.decompress(x["bytes"]), np.uint8) for x in rest[0]]).astype(np.int64) if rest else sent.value.levels(keys)
            known, plain, scores, left = _texts(c, counts, level, inv, n, v)
            m = len(ids)
            yield record(
                doc_id=pa.array(ids, pa.int64()), held_out=pa.array(c.held), n_tokens=pa.array(c.lengths, pa.int64()), n_known=pa.array(known, pa.int64()), base_score=pa.array(plain),
                scores=pa.array(list(np.stack(scores, axis=1)), pa.list_(pa.float64())), left=pa.array([left] + [None] * (m - 1), pa.list_(pa.float64())),
            )

    return per_batch(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left array<double>", run)
