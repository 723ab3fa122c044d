"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

Texts and items are letter and digit runs, so case and punctuation do not hide a copy.
An alignment scores a match 1 and an edit -EDIT; similarity is the best score over the
item's words.  At similarity THRESHOLD t an item of m words has at most (1 - t) m words
without a match, and its copy spans at most m + (1 - t) m / EDIT words of the text, all
edits being insertions.  One pass counts the items' words in the texts.  The seeds of an
item are its rarest words, more of them than may lack a match; a second pass keeps the
stretches of text where as many seeds as must match stand within the widest copy, and
where enough words of the item do.  No alignment of similarity THRESHOLD is lost, however
its edits lie; the counts only decide how much is aligned.

Items go out in blocks of at most BLOCK_WORDS words; a benchmark of more takes more passes.

Null and empty texts match nothing.  Items below MIN_WORDS words are ignored: they occur
by chance.  Repeated rows of texts each match; repeated items each report.  Rows with a
null id are matched like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import per_batch, per_task, record, settle, shuffle_width, spread
from .tokens import Runs

MIN_WORDS = 8
EDIT = 0.25
THRESHOLD = 0.8
BLOCK_WORDS = 1 << 21


def lost_words(size, threshold: float = THRESHOLD):
    """Words of an item of `size` words that an alignment of similarity `threshold` may leave without a match, at most."""
    return np.floor((1 - threshold) * size + 1e-6).astype(np.int64)


def copy_words(size, threshold: float = THRESHOLD):
    """Words of a text that such an alignment spans, at most."""
    return size + np.floor((1 - threshold) * size / EDIT + 1e-6).astype(np.int64)


class Block:
    """Some items: their words, and an index from word to items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        # The table has no key 0.
        self.words = [Runs([(text or "").encode("utf-8", "surrogatepass")]).hash | np.uint64(1) for text in texts]
        self.size = np.array([len(w) for w in self.words], np.int64)
        used = [w for w in self.words if len(w) >= MIN_WORDS]
        self.vocabulary = np.unique(np.concatenate(used)) if used else np.empty(0, np.uint64)
        self.table = W.HashTable()
        self.table.put(self.vocabulary, np.arange(len(self.vocabulary), dtype=np.int32))

    def seed(self, counts: np.ndarray, threshold: float) -> None:
        """Chooses seeds by the counts of the vocabulary: words, their items, and how many must stand near each other."""
        word, item = [], []
        self.need, self.least, self.span = np.zeros(len(self.words), np.int64), self.size - lost_words(self.size, threshold), copy_words(self.size, threshold)
        for k, w in enumerate(self.words):
            if len(w) < MIN_WORDS:
                continue
            slot = self.table.get(w).astype(np.int64)
            slot = slot[np.lexsort((slot, counts[slot]))]
            self.need[k] = min(-(-len(w) // 8), self.least[k])
            own = np.unique(slot[: int(self.size[k] - self.least[k] + self.need[k])])
            word.append(own), item.append(np.full(len(own), k))
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.argsort(word, kind="stable")
        self.item = item[order]
        self.first = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))


def _stretches(block: Block, runs: Runs, words: np.ndarray):
    """(doc, item, first run, past last run) of the stretches that may hold a copy."""
    slot = block.table.get(words)
    at = np.flatnonzero(slot >= 0)
    slot = slot[at].astype(np.int64)
    count = block.first[slot + 1] - block.first[slot]
    item, where = block.item[spread(block.first[slot], count)], np.repeat(at, count)
    doc = runs.doc[where]
    order = np.lexsort((where, item, doc))
    doc, item, where = doc[order], item[order], where[order]
    if not len(doc):
        return
    # The seeds of a copy that must match stand in a row and within its span.
    last = np.arange(len(doc)) + block.need[item] - 1
    near = np.minimum(last, len(doc) - 1)
    span = block.span[item]
    on = np.flatnonzero((last < len(doc)) & (doc[near] == doc) & (item[near] == item) & (where[near] - where < span))
    if not len(on):
        return
    doc, item, span, low, high = doc[on], item[on], span[on], where[near[on]] - span[on] + 1, where[on] + span[on]
    low, high = np.maximum(low, runs.first[doc]), np.minimum(high, runs.first[doc + 1])
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    head = np.flatnonzero(fresh)
    for x, y in zip(head.tolist(), np.append(head[1:], len(doc)).tolist(), strict=True):
        k, a, b = int(item[x]), int(low[x]), int(high[y - 1])
        held = np.concatenate([[0], np.cumsum(np.isin(words[a:b], block.words[k]))])
        wide = min(int(span[x]), b - a)
        if (held[wide:] - held[: len(held) - wide]).max() >= block.least[k]:
            yield int(doc[x]), k, a, b


def _counts(docs: DataFrame, sent) -> DataFrame:
    """(word, texts): how often a task's texts hold each word of the block."""

    def run(batches):
        block = sent.value
        counts = np.zeros(len(block.vocabulary), np.int64)
        for batch in batches:
            for _, raws in W.chunks(batch.column(1).to_pylist()):
                slot = block.table.get(Runs(raws).hash | np.uint64(1))
                counts += np.bincount(slot[slot >= 0], minlength=len(counts))
        used = np.flatnonzero(counts)
        for k in range(0, len(used), 1 << 16):
            part = used[k : k + (1 << 16)]
            yield record(word=pa.array(part, pa.int32()), times=pa.array(counts[part], pa.int64()))

    return per_task(docs, "word int, times long", run)


def _candidates(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, item, start, words) of the stretches to align."""

    def run(batches):
        block = sent.value
        for batch in batches:
            ids = batch.column(0)
            for first_row, raws in W.chunks(batch.column(1).to_pylist()):
                runs = Runs(raws)
                words = runs.hash | np.uint64(1)
                rows = list(_stretches(block, runs, words))
                if rows:
                    yield record(doc_id=ids.take(pa.array([first_row + r[0] for r in rows])), item=pa.array([r[1] for r in rows], pa.int32()), start=pa.array([r[2] - int(runs.first[r[0]]) for r in rows], pa.int64()), words=pa.array([words[r[2] : r[3]].tobytes() for r in rows], pa.binary()))

    return per_task(docs, "doc_id long, item int, start long, words binary", run)


def align(items: list[np.ndarray], passages: list[np.ndarray], edit: float = EDIT) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of the best alignment in the passage, exclusive) of each pair, all pairs at once."""
    wide, deep = max(map(len, passages)), max(map(len, items))
    p = np.zeros((len(items), wide), np.uint64)
    q = np.zeros((len(items), deep), np.uint64)
    for k, (a, b) in enumerate(zip(items, passages, strict=True)):
        q[k, : len(a)], p[k, : len(b)] = a, b
    inside = np.arange(wide) < np.array([len(b) for b in passages])[:, None]
    ramp = edit * np.arange(wide)
    h = np.zeros((len(items), wide + 1))
    best, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
    deepest = np.array([len(a) for a in items])
    for i in range(deep):
        step = h[:, :-1] + np.where((p == q[:, i : i + 1]) & inside, 1.0, -edit)
        step = np.maximum(np.maximum(step, h[:, 1:] - edit), 0)
        # A gap along the passage costs edit for each word: a running maximum of step + ramp.
        h[:, 1:] = np.maximum.accumulate(step + ramp, axis=1) - ramp
        row = np.where((i < deepest)[:, None] & inside, h[:, 1:], 0)
        j = row.argmax(axis=1)
        top = row[np.arange(len(items)), j]
        better = top > best
        best[better], end[better] = top[better], j[better] + 1
    return best, end


#: Cells of one alignment batch.
ALIGN_CELLS = 1 << 21


def _aligned(candidates: DataFrame, sent, threshold: float) -> DataFrame:
    def run(batch):
        block = sent.value
        ids, item, start, raw = (c.to_pylist() for c in batch.columns)
        passages = [np.frombuffer(x, np.uint64) for x in raw]
        order = sorted(range(len(item)), key=lambda k: len(passages[k]))
        k = 0
        while k < len(order):
            n = max(1, ALIGN_CELLS // max(1, len(passages[order[min(len(order) - 1, k + 1024)]])))
            part = order[k : k + min(n, 1024)]
            k += len(part)
            best, end = align([block.words[item[i]] for i in part], [passages[i] for i in part])
            size = np.array([block.size[item[i]] for i in part])
            on = np.flatnonzero(best >= threshold * size - 1e-9)
            if len(on):
                yield record(
                    doc_id=pa.array([ids[part[i]] for i in on], pa.int64()), item_id=pa.array([block.ids[item[part[i]]] for i in on], pa.int64()), similarity=pa.array(best[on] / size[on]),
                    start_word=pa.array([max(start[part[i]], start[part[i]] + int(end[i]) - int(size[i])) for i in on], pa.int64()), end_word=pa.array([start[part[i]] + int(end[i]) for i in on], pa.int64()),
                )

    return per_batch(candidates.select("doc_id", "item", "start", "words"), "doc_id long, item_id long, similarity double, start_word long, end_word long", run)


def _blocks(benchmark: DataFrame, id_column: str, text_column: str):
    """Items, dealt to the driver block by block; a block holds at most BLOCK_WORDS words."""
    ids, texts, words = [], [], 0
    rows = benchmark.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).where(F.col(text_column).isNotNull()).orderBy(id_column, text_column)
    for item, text in rows.toLocalIterator():
        n = len(text.split())
        if ids and words + n > BLOCK_WORDS:
            yield Block(ids, texts)
            ids, texts, words = [], [], 0
        ids.append(item), texts.append(text)
        words += n
    if ids:
        yield Block(ids, texts)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, start_word, end_word (best copy)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    hits = None
    for block in _blocks(benchmark, item_column, item_text):
        if not len(block.vocabulary):
            continue
        sent = spark.sparkContext.broadcast(block)
        counts = np.zeros(len(block.vocabulary), np.int64)
        for row in _counts(docs, sent).groupBy("word").agg(F.sum("times").alias("times")).toLocalIterator():
            counts[row.word] = row.times
        block.seed(counts, threshold)
        sent = spark.sparkContext.broadcast(block)
        candidates = settle(_candidates(docs, sent), "candidates")
        own = _aligned(candidates.repartition(shuffle_width(spark)), sent, threshold)
        hits = own if hits is None else hits.union(own)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start_word long, end_word long")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", F.negative("start_word").alias("first"), "end_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", F.negative("m.first").alias("start_word"), "m.end_word")
