"""Repeated passages by paragraph MinHash banding.

A paragraph is PARAGRAPH words from an anchor.  Anchors are chosen by content: of every
ANCHOR_GAP consecutive starts the one whose 5-word shingle hashes lowest.  Any passage
of PARAGRAPH + ANCHOR_GAP - 1 words therefore has an anchor of its own in every text that
holds it, wherever it stands and whatever surrounds it; a text shorter than a paragraph
is one paragraph.  Line breaks do not matter, as passages are also copied into lines.
Where words repeat, equal paragraphs of a text that overlap are one occurrence that spans
the whole stretch.

Paragraphs are banded by MinHash over 5-word shingles, with bands tuned for recall at
the threshold.  Equal paragraphs are one class; within a band's bucket, classes are
paired and their exact Jaccard is verified.  A bucket of more than SMALL_BUCKET classes
(a frequent line in many contexts) is banded again with more rows; small buckets of that
are paired, and in full ones an exact search links all that similar pairs connect.  Links are clustered by connected components; a cluster that occurs in two texts
or more keeps its first occurrence and gives up the others, and overlapping paragraphs
of a text are merged to spans.

Null, empty and blank texts have no paragraphs; texts below MIN_WORDS words neither.
Rows with a null id are ignored.  Repeated ids count as one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import components, exchange, forget, longs, packed, per_batch, per_task, record, settle, shuffle_width, spread

SHINGLE = 5
PARAGRAPH = 25
ANCHOR_GAP = 25
MIN_WORDS = 12
THRESHOLD = 0.8
SMALL_BUCKET = 12
#: Bands and rows of the second banding, for full buckets.
SECOND = (8, 2)


def tune_bands(threshold: float, recall: float, most: int = 32) -> tuple[int, int]:
    """(bands, rows): the most rows, hence fewest chance collisions, whose band count within `most` hashes and 4 bands gives the recall."""
    best = None
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands is not None and bands <= 4:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width], by doubling; result has len(x) - width + 1 values."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(shingles: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, words) of the paragraphs; shingles[i] is the hash of words i to i + SHINGLE - 1 (any value past a text's end)."""
    total = len(shingles)
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.maximum(counts - PARAGRAPH + 1, 0)
    long_texts = starts >= ANCHOR_GAP
    found = []
    if long_texts.any() and total >= ANCHOR_GAP:
        low = _sliding(shingles, ANCHOR_GAP, np.minimum)
        at = spread(first[:-1][long_texts], starts[long_texts] - ANCHOR_GAP + 1)
        held = np.zeros(total + ANCHOR_GAP, np.uint64)
        held[at + ANCHOR_GAP - 1] = low[at]
        high = _sliding(held, ANCHOR_GAP, np.maximum)[:total]
        inside = spread(first[:-1][long_texts], starts[long_texts])
        found.append(inside[high[inside] == shingles[inside]])
    for d in np.flatnonzero((starts > 0) & ~long_texts):
        own = shingles[first[d] : first[d] + starts[d]]
        found.append(first[d] + np.flatnonzero(own == own.min()))
    at = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    short = np.flatnonzero((counts >= MIN_WORDS) & (starts == 0))
    return np.concatenate([at, first[short]]), np.concatenate([np.full(len(at), PARAGRAPH), counts[short]])


def _chunk(raws: list[bytes]):
    """Words, shingle hashes at every word (0 past a text's last shingle), paragraphs (word index, words)."""
    w = W.Words(raws)
    shingles = np.zeros(len(w), np.uint64)
    value, _, pos = W.grams(w, SHINGLE, False)
    shingles[pos] = value
    at, size = anchors(shingles, w.first, w.counts)
    return w, shingles, at, size


def _runs(whole: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, words of all) of the runs: equal paragraphs of a text that overlap, as where a few words repeat, are one occurrence of their whole stretch."""
    order = np.lexsort((at, whole, doc))
    w, d, a = whole[order], doc[order], at[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (a[1:] - a[:-1] >= PARAGRAPH)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(a))[: len(head)] - 1
    back = np.argsort(order[head], kind="stable")
    return order[head][back], (a[last] - a[head] + size[order[head]])[back]


def _salt(k: int) -> np.uint64:
    return np.uint64((k + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)


def _minhash(shingles: np.ndarray, at: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    mixed = W.mix(shingles ^ _salt(k))
    full = size == PARAGRAPH
    out = np.empty(len(at), np.uint64)
    if full.any():
        out[full] = _sliding(mixed, PARAGRAPH - SHINGLE + 1, np.minimum)[at[full]]
    for i in np.flatnonzero(~full):
        out[i] = mixed[at[i] : at[i] + size[i] - SHINGLE + 1].min()
    return out


ENTRY = np.dtype([("sig", np.uint64), ("whole", np.uint64), ("doc", np.uint32), ("pos", np.uint32), ("size", np.uint32), ("band", np.uint16)])


def _banded(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    def run(batch):
        for first_row, raws in W.chunks(batch.column(1).to_pylist()):
            w, shingles, at, size = _chunk(raws)
            if not len(at):
                continue
            whole = _whole(w.hash, at, size)
            one, reach = _runs(whole, w.doc[at], at, size)
            whole, at, size = whole[one], at[one], size[one]
            keep = []
            for b in range(bands):
                sig = np.full(len(at), b + 1, np.uint64)
                for r in range(rows):
                    sig = W.mix(sig ^ _minhash(shingles, at, size, b * rows + r))
                e = np.empty(len(at), ENTRY)
                e["sig"], e["whole"], e["doc"], e["pos"], e["size"], e["band"] = sig, whole, w.doc[at], at - w.first[w.doc[at]], reach, b
                keep.append(e)
            rows_ = np.concatenate(keep)
            part = ((rows_["sig"] >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows_, counts = rows_[order], np.bincount(part, minlength=width)
            used = np.flatnonzero(counts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids = longs(batch.column(0).slice(first_row, len(raws)))
            names = []
            for k in used:
                own, inv = np.unique(rows_["doc"][ends[k] : ends[k + 1]], return_inverse=True)
                rows_["doc"][ends[k] : ends[k + 1]] = inv
                names.append(ids[own].tobytes())
            yield record(part=pa.array(used, pa.int32()), names=pa.array(names, pa.binary()), entries=packed(rows_, np.concatenate([[0], np.cumsum(counts[used])])))

    return exchange(per_batch(docs, "part int, names binary, entries binary", run), "part", width)


def _whole(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's word sequence."""
    out = np.zeros(len(at), np.uint64)
    for k in range(PARAGRAPH):
        on = size > k
        if on.all():
            out = out * W._BASE + h[at + k]
        else:
            out[on] = out[on] * W._BASE + h[at[on] + k]
    return W.mix(out + size.astype(np.uint64))


def _buckets(banded: DataFrame) -> DataFrame:
    """Rows of kind 0: (whole, doc, pos, size) occurrences of repeated classes; 1: (whole, other) pairs to verify; 2: classes of full buckets; 3: one occurrence of each class named by 1 or 2."""

    def run(batches):
        es, ids = [], []
        for batch in batches:
            for _, names, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(rows, ENTRY)
                es.append(rows), ids.append(np.frombuffer(names, np.int64)[rows["doc"]])
        if not es:
            return
        e, doc = np.concatenate(es), np.concatenate(ids)
        order = np.lexsort((e["pos"], doc, e["whole"], e["sig"]))
        e, doc = e[order], doc[order]
        new_sig = np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])
        new_class = new_sig | np.concatenate([[True], e["whole"][1:] != e["whole"][:-1]])
        head = np.flatnonzero(new_class)
        copies = np.diff(np.append(head, len(e)))

        def out(kind, whole, other=None, d=None, pos=None, size=None):
            n = len(whole)
            for k in range(0, n, 1 << 17):
                s = slice(k, k + (1 << 17))
                m = len(whole[s])
                null = pa.nulls(m, pa.int64())
                cut = lambda x: null if x is None else pa.array(x[s].astype(np.int64))  # noqa: B023, E731
                yield record(kind=pa.array(np.full(m, kind), pa.int32()), whole=pa.array(whole[s].view(np.int64)), other=null if other is None else pa.array(other[s].view(np.int64)), doc=cut(d), pos=cut(pos), size=cut(size))

        repeated = np.repeat(copies > 1, copies) & (e["band"] == 0)
        yield from out(0, e["whole"][repeated].copy(), None, doc[repeated], e["pos"][repeated], e["size"][repeated])
        bucket = np.cumsum(new_sig[head]) - 1
        classes = np.bincount(bucket)
        first = np.cumsum(classes) - classes
        whole = e["whole"][head].copy()
        own_doc, own_pos = doc[head], e["pos"][head].astype(np.int64)
        small = np.flatnonzero((classes > 1) & (classes <= SMALL_BUCKET))
        i = spread(first[small], classes[small])
        end = np.repeat(first[small] + classes[small], classes[small])
        counts = end - i - 1
        x, y = np.repeat(i, counts), spread(i + 1, counts)
        # Neighbouring paragraphs of one text overlap and so share shingles; they are no copies of each other.
        on = (own_doc[x] != own_doc[y]) | (np.abs(own_pos[x] - own_pos[y]) >= PARAGRAPH)
        x, y = x[on], y[on]
        full = classes[bucket] > SMALL_BUCKET
        named = full.copy()
        named[x] = named[y] = True
        yield from out(3, whole[named], None, own_doc[named], own_pos[named], e["size"][head][named])
        yield from out(1, whole[x], whole[y])
        yield from out(2, whole[full])

    return per_task(banded, "kind int, whole long, other long, doc long, pos long, size long", run)


def _paragraph_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(whole, shingles) of the paragraphs at places (whole, doc, pos, size); a set's few shingles go by 32 bits of their hashes."""
    wanted = places.groupBy("doc").agg(F.collect_list(F.struct("whole", "pos", "size")).alias("places"))
    rows = docs.join(wanted, docs.doc_id == wanted.doc).select("places", "text")

    def run(batch):
        asked = batch.column(0).to_pylist()
        for at, raws in W.chunks(batch.column(1).to_pylist()):
            w = W.Words(raws)
            shingles = np.zeros(len(w), np.uint64)
            value, _, pos = W.grams(w, SHINGLE, False)
            shingles[pos] = value
            whole, sets = [], []
            for k in range(len(raws)):
                for p in asked[at + k]:
                    # A run is longer than its paragraph.
                    x, size = w.first[k] + p["pos"], min(p["size"], PARAGRAPH)
                    # A repeated id with another text may lack the paragraph.
                    if p["pos"] + size <= w.counts[k]:
                        whole.append(p["whole"])
                        sets.append(np.unique((shingles[x : x + size - SHINGLE + 1] >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield record(whole=pa.array(whole, pa.int64()), shingles=pa.array(sets, pa.binary()))

    return per_batch(rows, "whole long, shingles binary", run).dropDuplicates(["whole"])


#: Classes of a block: a full second bucket of more is dealt to tasks by pairs of blocks.
BLOCK_CLASSES = 4096


def _sizes(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, sets), np.int64, len(sets))


def _forest(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all that similar pairs connect, by exact Jaccard.

    Breadth first: a set is compared with those not reached yet that share one of its
    rarest members, of which similar sets have one in common (any order of members does).
    """
    n, size = len(sets), _sizes(sets)
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((member, times[member], owner))
    member = member[order]
    rank = spread(np.zeros(n, np.int64), size)
    head = rank < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[owner]
    wide = np.full((n, int(size.max())), len(times))
    wide[owner, rank] = member
    key, at = member[head], owner[head]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    own, first, count = np.unique(key, return_index=True, return_counts=True)
    shared = {int(m): at[x : x + c] for m, x, c in zip(own[count > 1], first[count > 1], count[count > 1], strict=True)}
    asks: dict[int, list[int]] = {}
    for m, list_ in shared.items():
        for i in list_.tolist():
            asks.setdefault(i, []).append(m)
    left, mark, links = np.ones(n, bool), np.zeros(len(times) + 1, bool), []
    for start in asks:
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            near = []
            for m in asks.get(i, ()):
                shared[m] = shared[m][left[shared[m]]]
                near.append(shared[m])
            near = np.concatenate(near) if near else np.empty(0, np.int64)
            if not len(near):
                continue
            mark[wide[i, : size[i]]] = True
            both = mark[wide[near]].sum(axis=1)
            mark[wide[i, : size[i]]] = False
            found = np.unique(near[both >= threshold * (size[i] + size[near] - both)])
            left[found] = False
            links += [(i, j) for j in found.tolist()]
            queue += found.tolist()
    return links


def _second(sets: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Among the classes of full buckets, by a second banding: pairs to verify of small buckets, and links of full ones, which connect all that their similar pairs connect."""
    bands, rows = SECOND

    def sign(batch):
        raws = batch.column(1).to_pylist()
        s = np.frombuffer(b"".join(raws), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        first = np.cumsum(size) - size
        for b in range(bands):
            key = np.full(len(raws), b + 1, np.uint64)
            for r in range(rows):
                key = W.mix(key ^ np.minimum.reduceat(W.mix(s ^ _salt(1000 + b * rows + r)), first))
            yield record(whole=batch.column(0), sig=pa.array(key.view(np.int64)))

    signed = settle(per_batch(sets, "whole long, sig long", sign), "signed")
    size = signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    joined = settle(signed.join(size, "sig"), "joined")
    small = joined.where(F.col("n") <= SMALL_BUCKET)
    pairs = small.select("sig", "whole").join(small.select("sig", F.col("whole").alias("other")), "sig").where("whole < other").select("whole", "other")
    # A bucket of one block is one cell; of more blocks every two meet in a cell.
    full = joined.where(F.col("n") > SMALL_BUCKET).withColumn("blocks", F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")).withColumn("own", F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0))), lambda k: F.struct(F.least("own", k).alias("a"), F.greatest("own", k).alias("b")))
    cells = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(F.filter(every, lambda c: c.a != c.b))
    dealt = full.select("sig", "whole", F.explode(cells).alias("cell")).join(sets, "whole")
    dealt = dealt.select(F.pmod(F.xxhash64("sig", "cell.a", "cell.b"), F.lit(width)).cast("int").alias("part"), F.xxhash64("sig", "cell.a", "cell.b").alias("cell"), "whole", "shingles")

    def connect(batches):
        held = [b for b in batches]
        if not held:
            return
        rows_ = pa.Table.from_batches(held).combine_chunks()
        cell, whole, raw = rows_.column("cell").to_numpy(), rows_.column("whole").to_numpy(), rows_.column("shingles").combine_chunks()
        order = np.argsort(cell, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            links = _forest([np.frombuffer(raw[int(i)].as_py(), np.uint32) for i in at], threshold)
            if links:
                u, v = whole[at[[x for x, _ in links]]], whole[at[[y for _, y in links]]]
                yield record(u=pa.array(np.minimum(u, v)), v=pa.array(np.maximum(u, v)))

    return pairs, per_task(exchange(dealt, "part", width), "u long, v long", connect)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batch):
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        keep = []
        for s, t in zip(x, y, strict=True):
            s, t = np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(both >= threshold * (len(s) + len(t) - both))
        at = np.flatnonzero(keep)
        yield record(u=batch.column(0).take(pa.array(at)), v=batch.column(1).take(pa.array(at)))

    rows = pairs.join(sets.select("whole", F.col("shingles").alias("x")), "whole").join(sets.select(F.col("whole").alias("other"), F.col("shingles").alias("y")), "other")
    return per_batch(rows.select("whole", "other", "x", "y"), "u long, v long", run)


def repeated_passages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = 0.98) -> DataFrame:
    """One row per repeated span: doc_id, start_word, end_word (exclusive), component_id, kept.

    component_id is the smallest document id of the span's clusters; kept spans hold the
    first occurrence of a cluster, the others are to be removed.
    """
    spark = documents.sparkSession
    width = shuffle_width(spark)
    docs = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    bands, rows = tune_bands(threshold, recall)
    found = settle(_buckets(_banded(docs, bands, rows, width)), "buckets")
    place = found.where("kind = 3").groupBy("whole").agg(F.min(F.struct("doc", "pos", "size")).alias("p")).select("whole", "p.*")
    sets = settle(_paragraph_sets(docs, place), "sets")
    full = found.where("kind = 2").select("whole").distinct()
    second, links = _second(settle(sets.join(full, "whole", "left_semi"), "full"), threshold, width)
    pairs = found.where("kind = 1").select("whole", "other").union(second).where("whole <> other")
    pairs = pairs.select(F.least("whole", "other").alias("whole"), F.greatest("whole", "other").alias("other")).distinct()
    links = settle(_verified(pairs, sets, threshold).union(links), "links")
    cluster = settle(components(links), "clusters")
    near = links.select(F.explode(F.array("u", "v")).alias("whole")).distinct()
    places = found.where("kind = 0").select("whole", "doc", "pos", "size").union(place.join(near, "whole", "left_semi").select("whole", "doc", "pos", "size")).distinct()
    places = places.join(cluster.withColumnRenamed("node", "whole"), "whole", "left").select(F.coalesce("component", "whole").alias("cluster"), "doc", "pos", "size")
    places = settle(places, "places")
    first = places.groupBy("cluster").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last")).where("last > first.doc").select("cluster", "first")
    marked = places.join(first, "cluster").select("doc", "pos", "size", (F.struct("doc", "pos") == F.col("first")).alias("kept"), F.col("first.doc").alias("origin"))
    out = _spans(marked)
    forget(sets)
    return out


def _spans(marked: DataFrame) -> DataFrame:
    """Merges a document's overlapping paragraphs of equal `kept` to spans."""
    from pyspark.sql import Window as Win

    one = marked.groupBy("doc", "pos", "size").agg(F.min("kept").alias("kept"), F.min("origin").alias("origin"))
    order = Win.partitionBy("doc", "kept").orderBy("pos", "size")
    reach = F.max(F.col("pos") + F.col("size")).over(order.rowsBetween(Win.unboundedPreceding, -1))
    numbered = one.withColumn("fresh", (reach.isNull() | (F.col("pos") > reach)).cast("int")).withColumn("span", F.sum("fresh").over(order.rowsBetween(Win.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "kept", "span").agg(F.min("pos").alias("start_word"), F.max(F.col("pos") + F.col("size")).alias("end_word"), F.min("origin").alias("component_id")).select(F.col("doc").alias("doc_id"), "start_word", "end_word", "component_id", "kept")
