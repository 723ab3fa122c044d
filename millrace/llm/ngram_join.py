"""Exact n-gram Jaccard self-join with set-relation skipping.

Every text becomes a set of word n-gram hashes.  Texts of equal sets are one class.
A global order of n-grams puts those of heavily used hash buckets last; the first
n - ceil(t * n) + MATCHES n-grams of a class under that order go to index lists, and
two classes that link share at least MATCHES of them.

* Index-level skipping: a list is kept in blocks of equal position range, ordered by
  set size.  A block pair whose positions leave too little room for the required
  overlap is skipped whole, and sizes out of range are passed over by binary search.
* Answer-level skipping: in each of a few first rounds every class is compared with the
  few classes that most of its lists propose among those it is not yet connected to,
  which joins groups of near copies by about as many comparisons as members.
  In the last round only pairs that are not known to be connected remain, and all of
  them are decided.  Pairs of short lists are bounded from the overlap of their centres
  and the differences to them (|A n B| lies within |CA n CB| -/+ the differences), and a
  set is read only where the bounds do not decide.  Members of long lists meet in cells,
  one for lists of about the same members; a cell finds its candidates by the same
  position blocks, gets their overlaps from the differences to one centre
  (|A n B| = |C| - |C - A| - |C - B| + common differences) and returns only links that
  connect what its pairs connect, so that a group's output grows with its members.

Before that, a pair must pass the size filter, the position filter and a histogram
filter: sets whose bucket histograms differ by more than the symmetric difference that
the threshold allows cannot link.  All filters are exact.

Null ids keep their row, link with nothing and get a null component.  Null, empty and
blank texts have n_shingles 0, are no part of the graph and their own component.  Other
rows that share an id are one node of the graph, whatever their texts.  Columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import words as W
from .common import components, exchange, forget, longs, packed, per_batch, per_task, record, settle, shuffle_width, spread

#: log2 of the counters in the n-gram frequency sketch; its size is fixed whatever the input.
SKETCH_BITS = 20
#: Shared prefix n-grams that a pair needs before it is a candidate.
MATCHES = 3
#: Lists up to this length are paired in one vectorised step, longer ones block by block.
SHORT_LIST = 24
POSITION_BLOCK = 16
#: Buckets of a set's histogram, four bits each, and its bytes.
HISTOGRAM_BITS = 7
BUCKETS = 1 << HISTOGRAM_BITS
HISTOGRAM = BUCKETS // 2
#: Comparisons for each class in each round before the last, which decides all that is left.
CENTRE_ROUNDS = (1, 4, 4)
#: Members of a centre that one task group holds at most.
STAR = 1000
#: The centre rounds look at one list in this many; the last round looks at all.
PROPOSE_LISTS = 4
#: Rows of at most 100 bytes that are sent to every task up to this many; more are joined by a shuffle.
SEND_IDS = 1 << 18
#: N-grams of a block of a cell, each member counting for MEMBER more; every two blocks that can hold a new link meet.
BLOCK_GRAMS, MEMBER = 1 << 19, 512


def need(size_a: np.ndarray, size_b: np.ndarray, t: Fraction) -> np.ndarray:
    """Smallest overlap that links sets of these sizes: ceil(t / (1 + t) * (a + b))."""
    p, q = t.numerator, t.numerator + t.denominator
    return -((-(size_a + size_b) * p) // q)


def prefix_length(size: np.ndarray, t: Fraction) -> np.ndarray:
    least = -((-size * t.numerator) // t.denominator)
    return np.minimum(size, size - least + MATCHES)


def _sets(batch: pa.RecordBatch, n: int):
    """(index of the first row, rows, sorted distinct n-gram hashes, their rows, first) per chunk; columns: id, text."""
    for at, raws in W.chunks(batch.column(1).to_pylist()):
        value, doc, _ = W.grams(W.Words(raws), n, True)
        value, doc = W.distinct(value, doc)
        first = np.searchsorted(doc, np.arange(len(raws) + 1))
        yield at, len(raws), value, doc, first


def _signatures(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(value ^ np.uint64(salt)))])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _histograms(value: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Per set, how many n-grams fall into each bucket, modulo 16, two buckets to a byte."""
    slot = doc * BUCKETS + (W.mix(value ^ np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - HISTOGRAM_BITS)).astype(np.int64)
    own = (np.bincount(slot, minlength=count * BUCKETS) & 15).astype(np.uint8).reshape(count, HISTOGRAM, 2)
    return own[:, :, 0] | (own[:, :, 1] << 4)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, size, s1, s2, histogram) and, with doc_id null and size -1 - k, the k-th slice of a task's sketch."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for at, count, value, doc, first in _sets(batch, n):
                s1, s2 = _signatures(value, first)
                np.add.at(sketch, (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                yield record(doc_id=batch.column(0).slice(at, count), size=np.diff(first), s1=s1, s2=s2, bytes=packed(_histograms(value, doc, count).reshape(-1), np.arange(count + 1) * HISTOGRAM))
        slices = sketch.astype(np.uint32).reshape(SKETCH_SLICES, -1)
        yield record(doc_id=pa.nulls(SKETCH_SLICES, pa.int64()), size=-1 - np.arange(SKETCH_SLICES), s1=np.zeros(SKETCH_SLICES, np.int64), s2=np.zeros(SKETCH_SLICES, np.int64), bytes=pa.array([x.tobytes() for x in slices], pa.binary()))

    return per_task(docs, "doc_id long, size long, s1 long, s2 long, bytes binary", run)


SKETCH_SLICES = 8


def _sketch(profile: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed 2**SKETCH_BITS counters, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        for k, x in sums.items():
            yield record(k=pa.array([k], pa.int32()), sketch=pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()))

    parts = profile.where("size < 0").select((-1 - F.col("size")).cast("int").alias("k"), "bytes")
    rows = per_task(exchange(parts, "k", SKETCH_SLICES), "k int, sketch binary", add).collect()
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.uint32)
    for k, raw in rows:
        out[k] = np.frombuffer(raw, np.uint32)
    return out.reshape(-1)


def _index(docs: DataFrame, n: int, t: Fraction, sketch, width: int) -> DataFrame:
    """Byte-packed prefix entries by hash range: rows (part, class signatures, sizes, entries)."""

    def run(batch):
        heat = sketch.value
        for _, count, value, doc, first in _sets(batch, n):
            size = np.diff(first)
            names, _ = _signatures(value, first)
            # One row of each class in a chunk speaks for all of them.
            speaks = np.zeros(count, bool)
            speaks[np.unique(names, return_index=True)[1]] = True
            speaks &= size >= smallest(t)
            on = speaks[doc]
            value, doc = value[on], doc[on]
            if not len(value):
                continue
            begin = np.searchsorted(doc, np.arange(count))
            order = np.lexsort((value, heat[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], doc))
            position = np.arange(len(value)) - begin[doc]
            keep = position < prefix_length(size, t)[doc]
            value, position, doc = value[order][keep], position[keep], doc[keep]
            part = (value % np.uint64(width)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows = np.empty(len(value), ENTRY)
            rows["h"], rows["d"], rows["p"] = value[order], doc[order], position[order]
            counts = np.bincount(part, minlength=width)
            used = np.flatnonzero(counts)
            # Only the classes that a part refers to travel with it.
            ends = np.concatenate([[0], np.cumsum(counts)])
            own_names, sizes = [], []
            for k in used:
                own, inv = np.unique(rows["d"][ends[k] : ends[k + 1]], return_inverse=True)
                rows["d"][ends[k] : ends[k + 1]] = inv
                own_names.append(names[own].tobytes())
                sizes.append(size[own].astype(np.uint32).tobytes())
            yield record(part=pa.array(used, pa.int32()), names=pa.array(own_names, pa.binary()), sizes=pa.array(sizes, pa.binary()), entries=packed(rows, np.concatenate([[0], np.cumsum(counts[used])])))

    return exchange(per_batch(docs, "part int, names binary, sizes binary, entries binary", run), "part", width)


#: An n-gram of a chunk's class; `d` counts the classes of a part, at most those of a chunk.
ENTRY = np.dtype([("h", np.uint64), ("d", np.uint32), ("p", np.uint32)])


def smallest(t: Fraction) -> int:
    """Sets below this size link only with equal sets: one n-gram more or less is below t."""
    return int(t / (1 - t)) if t < 1 else 1 << 30


def _shared(index: DataFrame) -> DataFrame:
    """Entries (h, node, size, pos) of lists with at least two classes."""

    def run(batches):
        hs, ids, sizes, ps = [], [], [], []
        for batch in batches:
            for _, names, size, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, names, size = np.frombuffer(rows, ENTRY), np.frombuffer(names, np.int64), np.frombuffer(size, np.uint32)
                hs.append(rows["h"].copy()), ids.append(names[rows["d"]]), sizes.append(size[rows["d"]]), ps.append(rows["p"].copy())
        if not hs:
            return
        h, node, size, pos = map(np.concatenate, (hs, ids, sizes, ps))
        order = np.lexsort((node, h))
        h, node, size, pos = h[order], node[order], size[order], pos[order]
        # Rows of one class from several chunks are one entry.
        own = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        h, node, size, pos = h[own], node[own], size[own], pos[own]
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        many = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] > 1
        for k in range(0, int(many.sum()), 1 << 18):
            part = np.flatnonzero(many)[k : k + (1 << 18)]
            yield record(h=h[part].view(np.int64), node=node[part], size=size[part].astype(np.int32), pos=pos[part].astype(np.int32))

    return per_task(index, "h long, node long, size int, pos int", run)


def _fits(sa, pa_, sb, pb, t: Fraction) -> np.ndarray:
    """Whether sets of these sizes that share an n-gram at these positions may link."""
    low, high = np.minimum(sa, sb), np.maximum(sa, sb)
    room = np.minimum(pa_, pb) + 1 + np.minimum(sa - pa_, sb - pb) - 1
    return (high * t.numerator <= low * t.denominator) & (room >= need(sa, sb, t))


def _counted(batches_of_pairs):
    """Distinct (a, b) of one task with how often each came and both sizes."""
    held = [x for x in batches_of_pairs if len(x[0])]
    if not held:
        return
    a, b, sa, sb = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, sa, sb = a[order], b[order], sa[order], sb[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(fresh)
    times = np.diff(np.concatenate([at, [len(a)]]))
    for k in range(0, len(at), 1 << 18):
        x = at[k : k + (1 << 18)]
        yield record(a=a[x], b=b[x], sa=sa[x].astype(np.int32), sb=sb[x].astype(np.int32), times=times[k : k + (1 << 18)].astype(np.int32))


PAIRS = "a long, b long, sa int, sb int, times int"


def _read_lists(batches):
    """h, node, size, pos, label and histograms of a task's entries."""
    held = []
    for b in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in b.columns[:5]]
        own.append(np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, HISTOGRAM))
        held.append(own)
    if not held:
        return None
    h, node, size, pos, label, histogram = (np.concatenate(x) for x in zip(*held, strict=True))
    return h, node, size.astype(np.int64), pos.astype(np.int64), label, histogram


def _alike(histogram, size, i, j, t: Fraction) -> np.ndarray:
    """Whether the histograms of entries i and j leave room for the overlap they need."""
    out = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        p, q = histogram[x], histogram[y]
        low, high = (p - q) & 15, ((p >> 4) - (q >> 4)) & 15
        apart = (np.minimum(low, 16 - low) + np.minimum(high, 16 - high)).sum(axis=1, dtype=np.int64)
        out[k : k + (1 << 16)] = apart <= size[x] + size[y] - 2 * need(size[x], size[y], t)
    return out


def _proposals(lists: DataFrame, t: Fraction, most: int) -> DataFrame:
    """For each class the `most` partners of another label that most of its lists propose.

    A list proposes to an entry its smallest class of another label and the next two
    classes, so proposals are as many as entries, whatever the list's length.
    """

    def run(batches):
        got = _read_lists(batches)
        if got is None:
            return
        h, node, size, pos, label, histogram = got
        order = np.lexsort((node, h))
        h, label = h[order], label[order]
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        which = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        other = label != label[head][which]
        second = np.full(len(head), -1)
        at = np.flatnonzero(other)
        lists_at, first_at = np.unique(which[at], return_index=True)
        second[lists_at] = at[first_at]
        partner = np.where(other, head[which], second[which])
        left, right = [np.flatnonzero(partner >= 0)], [partner[partner >= 0]]
        for step in (1, 2):
            near = np.flatnonzero((which[step:] == which[: len(which) - step]) & (label[step:] != label[: len(label) - step])) if len(which) > step else np.empty(0, np.int64)
            left.append(near), right.append(near + step)
        i, j = order[np.concatenate(left)], order[np.concatenate(right)]
        on = _fits(size[i], pos[i], size[j], pos[j], t)
        i, j = i[on], j[on]
        on = _alike(histogram, size, i, j, t)
        i, j = i[on], j[on]
        yield from _counted([(node[i], node[j], size[i], size[j])])

    every = per_task(lists, PAIRS, run).groupBy("a", "b").agg(F.first("sa").alias("sa"), F.first("sb").alias("sb"), F.sum("times").alias("times"))
    best = every.withColumn("_rn", F.row_number().over(Win.partitionBy("a").orderBy(F.desc("times"), "b"))).where(F.col("_rn") <= most)
    return best.groupBy(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).agg(F.first(F.when(F.col("a") > F.col("b"), F.col("sa")).otherwise(F.col("sb"))).alias("sa"), F.first(F.when(F.col("a") > F.col("b"), F.col("sb")).otherwise(F.col("sa"))).alias("sb")).select(F.col("x").alias("a"), F.col("y").alias("b"), "sa", "sb")


def _long_list(size, pos, label, t: Fraction):
    """Index pairs of one long list (i, j), block by block; entries are ordered by position block, then size."""
    block = pos // POSITION_BLOCK
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    edges = np.append(edges, len(pos))
    for x in range(len(edges) - 1):
        i = np.arange(edges[x], edges[x + 1])
        for y in range(x, len(edges) - 1):
            j0, j1 = edges[y], edges[y + 1]
            # The most room that any pair of these blocks can have, against the least need.
            small = min(size[i[-1]], size[j1 - 1])
            most = min(pos[i].max(), pos[j0:j1].max()) + min((size[i] - pos[i]).max(), (size[j0:j1] - pos[j0:j1]).max())
            least = max(size[i[0]], size[j0])
            if small * t.denominator < least * t.numerator or most < need(size[i[0]], size[j0], t):
                continue
            lo = j0 + np.searchsorted(size[j0:j1], -((-size[i] * t.numerator) // t.denominator), "left")
            hi = j0 + np.searchsorted(size[j0:j1], size[i] * t.denominator // t.numerator, "right")
            if x == y:
                lo = np.maximum(lo, i + 1)
            for k in range(0, len(i), 256):
                counts = np.maximum(hi[k : k + 256] - lo[k : k + 256], 0)
                left, right = np.repeat(i[k : k + 256], counts), spread(lo[k : k + 256], counts)
                keep = label[left] != label[right]
                left, right = left[keep], right[keep]
                keep = _fits(size[left], pos[left], size[right], pos[right], t)
                yield left[keep], right[keep]


def _short_lists(head, length, size, pos, label, t: Fraction):
    """Index pairs (i, j) of the lists that start at head, many lists at a time."""
    i = spread(head, length)
    end = np.repeat(head + length, length)
    for k in range(0, len(i), 1 << 17):
        counts = end[k : k + (1 << 17)] - i[k : k + (1 << 17)] - 1
        left, right = np.repeat(i[k : k + (1 << 17)], counts), spread(i[k : k + (1 << 17)] + 1, counts)
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
        keep = _fits(size[left], pos[left], size[right], pos[right], t)
        yield left[keep], right[keep]


def _list_bounds(h, label):
    """(first entry, entries) of the lists of more than one label; entries of a list stand together."""
    fresh = np.concatenate([[True], h[1:] != h[:-1]])
    head = np.flatnonzero(fresh)
    mixed = np.zeros(len(head), bool)
    which = np.cumsum(fresh) - 1
    np.logical_or.at(mixed, which, label != label[head][which])
    return head[mixed], np.diff(np.append(head, len(h)))[mixed]


def _across(lists: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """What is not known to be connected: pairs (a, b, sa, sb) of short lists that may link, and members (cell, node, label, size) of long ones.

    A cell is named by a list's smallest class, so that lists of about the same classes, as
    a group of near copies has them, are one cell.
    """

    def run(batches):
        got = _read_lists(batches)
        if got is None:
            return
        h, node, size, pos, label, histogram = got
        order = np.lexsort((size, pos // POSITION_BLOCK, h))
        h, node, size, pos, label, histogram = (x[order] for x in (h, node, size, pos, label, histogram))
        head, length = _list_bounds(h, label)
        held, short = [], length <= SHORT_LIST
        for i, j in _short_lists(head[short], length[short], size, pos, label, t):
            on = _alike(histogram, size, i, j, t)
            i, j = i[on], j[on]
            swap = node[i] < node[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            held.append((node[a], node[b], size[a], size[b]))
        for batch in _counted(held):
            yield batch.append_column("cell", pa.nulls(batch.num_rows, pa.int64()))
        seen: dict[int, np.ndarray] = {}
        for x, n in zip(head[~short].tolist(), length[~short].tolist(), strict=True):
            cell, own = int(node[x : x + n].min()), np.arange(x, x + n)
            old = seen.get(cell)
            seen[cell] = own if old is None else np.concatenate([old, own[~np.isin(node[own], node[old])]])
        for cell, own in seen.items():
            yield record(a=node[own], b=label[own], sa=size[own].astype(np.int32), sb=pa.nulls(len(own), pa.int32()), times=pa.nulls(len(own), pa.int32()), cell=np.full(len(own), cell))

    every = settle(per_task(lists, f"{PAIRS}, cell long", run), "across")
    pairs = every.where("cell is null").groupBy("a", "b").agg(F.first("sa").alias("sa"), F.first("sb").alias("sb"), F.sum("times").alias("times"))
    return pairs.where(F.col("times") >= MATCHES).select("a", "b", "sa", "sb"), every.where("cell is not null").select("cell", F.col("a").alias("node"), F.col("b").alias("label"), F.col("sa").alias("size")).distinct()


def _deals(members: DataFrame) -> DataFrame:
    """(deal, side, node, label): the members of a cell in blocks of bounded size; a deal is one block or two that can hold a new link.

    A label that fills a block has blocks of its own, of which no two are compared: what is
    already connected is only met by the rest.
    """
    weight = F.col("size") + F.lit(MEMBER)
    own = members.groupBy("cell", "label").agg(F.sum(weight).alias("w"))
    own = settle(own.withColumn("large", F.col("w") > BLOCK_GRAMS), "cell_labels")
    rest = own.groupBy("cell").agg(F.sum(F.when(~F.col("large"), F.col("w"))).alias("rest"))
    split = lambda key, w: F.pmod(F.xxhash64(key), F.ceil(w / F.lit(BLOCK_GRAMS))).cast("string")
    block = F.when(F.col("large"), F.concat_ws(":", F.col("label").cast("string"), split("node", F.col("w")))).otherwise(F.concat(F.lit("rest:"), split("label", F.col("rest"))))
    dealt = members.join(own, ["cell", "label"]).join(rest, "cell").select("cell", "node", "label", block.alias("block"), F.when(F.col("large"), F.col("label")).alias("only"))
    dealt = settle(dealt, "blocks")
    blocks = dealt.select("cell", "block", "only").distinct()
    other = blocks.select("cell", F.col("block").alias("other"), F.col("only").alias("other_only"))
    met = blocks.join(other, "cell").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("only") == F.col("other_only"), F.lit(False)))
    deal = F.xxhash64("cell", "block", "other")
    sides = F.when(F.col("block") == F.col("other"), F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("other").alias("block"))))
    ends = met.select("cell", deal.alias("deal"), F.explode(sides).alias("s")).select("cell", "deal", "s.side", "s.block")
    return dealt.join(ends, ["cell", "block"]).select("deal", "side", "node", "label")


class _Differences:
    """Overlaps of a cell's sets from their differences to one centre; sets far from it are met as they are."""

    def __init__(self, member: np.ndarray, size: np.ndarray, kinds: int, centre: int):
        n, first = len(size), np.cumsum(size) - size
        self.mark = np.zeros(kinds, bool)
        self.flat, self.first, self.size = member, first, size
        own = member[first[centre] : first[centre] + size[centre]]
        place = np.full(kinds, -1)
        place[own] = np.arange(len(own))
        owner, at = np.repeat(np.arange(n), size), place[member]
        has = np.zeros((n, len(own)), bool)
        has[owner[at >= 0], at[at >= 0]] = True
        lost_by, lost = np.nonzero(~has)
        self.lost = np.bincount(lost_by, minlength=n)
        more = at < 0
        differ = self.lost + np.bincount(owner[more], minlength=n)
        self.near = differ < size
        who, what = np.concatenate([lost_by, owner[more]]), np.concatenate([own[lost], member[more]])
        order = np.argsort(who, kind="stable")
        self.delta, self.delta_size, self.delta_first = what[order], differ, np.cumsum(differ) - differ
        self.centre_size = len(own)

    def _common(self, i, js, flat, first, size) -> np.ndarray:
        own = flat[first[i] : first[i] + size[i]]
        self.mark[own] = True
        hits = np.concatenate([[0], np.cumsum(self.mark[flat[spread(first[js], size[js])]])])
        self.mark[own] = False
        ends = np.cumsum(size[js])
        return hits[ends] - hits[ends - size[js]]

    def overlaps(self, i: int, js: np.ndarray) -> np.ndarray:
        out = np.empty(len(js), np.int64)
        near = self.near[js] & self.near[i]
        if near.any():
            out[near] = self.centre_size - self.lost[i] - self.lost[js[near]] + self._common(i, js[near], self.delta, self.delta_first, self.delta_size)
        if not near.all():
            out[~near] = self._common(i, js[~near], self.flat, self.first, self.size)
        return out


def connecting(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """Links (index pairs) that connect all that links of a cell connect; sets of equal label are connected already.  With two sides only links across count."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    _, label = np.unique(label, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    # The cell's own lists: a set's rarest n-grams, of which linked sets share one.
    order = np.lexsort((member, times[member], owner))
    pos = np.arange(len(member)) - (np.cumsum(size) - size)[owner]
    head = (pos < (size + 1 + (-size * t.numerator) // t.denominator)[owner]) & (times[member[order]] > 1)
    h, own, pos = member[order][head], owner[head], pos[head]
    order = np.lexsort((size[own], pos // POSITION_BLOCK, h))
    h, own, pos = h[order], own[order], pos[order]
    may = np.zeros((n, n), bool)
    if len(h):
        s, lab = size[own], label[own]
        at, length = _list_bounds(h, lab)
        short = length <= SHORT_LIST
        for i, j in _short_lists(at[short], length[short], s, pos, lab, t):
            may[own[i], own[j]] = True
        for x, m in zip(at[~short].tolist(), length[~short].tolist(), strict=True):
            for i, j in _long_list(s[x : x + m], pos[x : x + m], lab[x : x + m], t):
                may[own[x + i], own[x + j]] = True
    may |= may.T
    if side.any():
        may &= side[:, None] != side[None, :]
    asks = may.any(axis=1)
    if not asks.any():
        return []
    differences = _Differences(member, size, len(times), int(may.sum(axis=1).argmax()))
    by_label = np.argsort(label, kind="stable")
    of_label = np.split(by_label, np.flatnonzero(np.diff(label[by_label])) + 1)
    left, links = np.ones(n, bool), []
    for start in np.flatnonzero(asks):
        if not left[start]:
            continue
        queue = of_label[label[start]].tolist()
        left[queue] = False
        while queue:
            i = queue.pop()
            js = np.flatnonzero(may[i] & left)
            if not len(js):
                continue
            js = js[differences.overlaps(i, js) >= need(size[i], size[js], t)]
            if len(js):
                met, one = np.unique(label[js], return_index=True)
                links += [(i, j) for j in js[one].tolist()]
                for m in met.tolist():
                    left[of_label[m]] = False
                    queue += of_label[m].tolist()
    return links


def _cell_links(deals: DataFrame, sets: DataFrame, t: Fraction, width: int) -> DataFrame:
    """(a, b) links that connect all that links of the deals connect."""
    part = F.pmod("deal", F.lit(width)).cast("int").alias("part")
    rows = exchange(deals.join(sets, "node").select(part, "deal", "side", "node", "label", "grams"), "part", width).sortWithinPartitions("deal")

    def run(batches):
        name, held = None, []

        def links():
            node, label, side = (np.array([x[k] for x in held], np.int64) for k in range(3))
            found = connecting([x[3] for x in held], label, side, t)
            if found:
                u, v = node[[i for i, _ in found]], node[[j for _, j in found]]
                yield record(a=np.maximum(u, v), b=np.minimum(u, v))

        for batch in batches:
            for _, deal, side, node, label, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if deal != name and held:
                    yield from links()
                    held = []
                name = deal
                held.append((node, label, side, np.frombuffer(grams, np.uint64)))
        if held:
            yield from links()

    return per_task(rows, "a long, b long", run)


def _overlaps(pairs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, sa, sb) with `overlap`.

    A set travels once for each pair it is the first of, to groups of at most STAR pairs of
    one second; the second's set comes once for each group and is met as a stream.
    """
    count = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("groups"))
    dealt = settle(pairs.join(count, "b").withColumn("g", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int")), "dealt")
    # The pairs go to the sets while they are few, so that only sets that are compared move.
    few = dealt.count() <= SEND_IDS
    send = F.broadcast if few else lambda df: df
    members = sets.select(F.col("node").alias("a"), "grams").join(send(dealt), "a").select("b", "g", "a", "sa", "sb", "grams")
    centres = sets.select(F.col("node").alias("b"), "grams").join(send(dealt.select("b", "g").distinct()), "b")
    centres = centres.select("b", "g", F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("sa"), F.lit(None).cast("int").alias("sb"), "grams")
    part = F.pmod(F.xxhash64("b", "g"), F.lit(width)).cast("int")
    rows = exchange(members.union(centres).withColumn("part", part), "part", width).sortWithinPartitions("b", "g", F.col("a").asc_nulls_first())

    def run(batches):
        key, centre = None, None
        for batch in batches:
            out = []
            for b, g, a, sa, sb, grams, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if a is None:
                    key, centre = (b, g), own
                elif key == (b, g):
                    at = np.searchsorted(centre, own)
                    at[at == len(centre)] = 0
                    out.append((a, b, sa, sb, int((centre[at] == own).sum()) if len(centre) else 0))
            if out:
                a, b, sa, sb, o = zip(*out, strict=True)
                yield record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), sa=pa.array(sa, pa.int32()), sb=pa.array(sb, pa.int32()), overlap=pa.array(o, pa.int32()))

    return per_task(rows, "a long, b long, sa int, sb int, overlap int", run)


def _distinct_nodes(pairs: DataFrame, *columns: str) -> DataFrame:
    """The classes that the columns name; each column is reduced on its own before they meet."""
    out = pairs.select(F.col(columns[0]).alias("node")).distinct()
    for c in columns[1:]:
        out = out.union(pairs.select(F.col(c).alias("node")).distinct())
    return out.distinct()


def _links(t: Fraction):
    return F.col("overlap") * F.lit(t.numerator + t.denominator) >= (F.col("sa") + F.col("sb")) * F.lit(t.numerator)


def _set_table(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the classes in nodes (node, rep), read from the texts of their representatives."""

    def run(batch):
        for at, count, value, _, first in _sets(batch, n):
            node = batch.column(2).slice(at, count)
            # Rows that share an id may hold other sets; only the class asked for counts.
            own = pa.array(_signatures(value, first)[0] == longs(node))
            yield record(node=node, grams=packed(value, first)).filter(own)

    nodes = settle(nodes, "nodes")
    # Ids are sent to the texts only while they are few; beyond that both sides are shuffled.
    wanted = F.broadcast(nodes) if nodes.count() <= SEND_IDS else nodes
    chosen = docs.join(wanted, docs.doc_id == wanted.rep).select("doc_id", "text", "node")
    return per_batch(chosen, "node long, grams binary", run)


def jaccard_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 4, threshold: Fraction | str | float = Fraction(85, 100)) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id, class_size.

    component_id is the smallest id reachable over pairs of n-gram Jaccard at least
    `threshold`; class_id the smallest id of rows with an equal set and class_size
    their number.
    """
    t = Fraction(str(threshold)) if not isinstance(threshold, Fraction) else threshold
    spark = documents.sparkSession
    width = shuffle_width(spark)
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    profile = settle(_profile(docs, n), "profile")
    sketch = spark.sparkContext.broadcast(_sketch(profile))
    rows = profile.where("size >= 0").select("doc_id", "size", "s1", "s2")
    # The classes: grouped minima, combined before the shuffle, so a class of any size is one row.
    classes = settle(profile.where("size > 0 and doc_id is not null").groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("bytes").alias("histogram")), "classes")
    known = docs.where("doc_id is not null")
    lists = settle(_shared(_index(known, n, t, sketch, width)), "lists")
    about = classes.select(F.col("s1").alias("node"), "rep", "histogram")
    listed = about.join(lists.select("node").distinct(), "node", "left_semi")
    listed = settle(listed, "listed")

    few = listed.count() <= SEND_IDS

    def labelled(label: DataFrame | None, one_in: int = 1) -> DataFrame:
        own = listed if label is None else listed.join(label, "node", "left")
        own = own.select("node", F.col("node").alias("label") if label is None else F.coalesce("label", "node").alias("label"), "histogram")
        # The classes go to the lists while they are few; beyond that both sides are shuffled.
        chosen = lists.where(F.pmod("h", F.lit(one_in)) == 0) if one_in > 1 else lists
        both = chosen.join(F.broadcast(own) if few else own, "node").select("h", "node", "size", "pos", "label", "histogram", F.pmod(F.xxhash64("h"), F.lit(width)).cast("int").alias("part"))
        return exchange(both, "part", width).drop("part")

    near, sets, label, used = None, None, None, [lists, listed]
    for most in CENTRE_ROUNDS:
        pairs = settle(_proposals(labelled(label, PROPOSE_LISTS), t, most), "proposals")
        nodes = _distinct_nodes(pairs, "a", "b")
        if sets is not None:
            nodes = nodes.join(sets.select("node"), "node", "left_anti")
        more = settle(_set_table(docs, listed.join(nodes, "node", "left_semi").select("node", "rep"), n), "sets")
        sets = more if sets is None else sets.union(more)
        found = settle(_overlaps(pairs, sets, width).where(_links(t)), "near")
        used += [pairs, more, found]
        if found.isEmpty():
            break
        near = found if near is None else near.union(found)
        label = settle(components(near.select(F.col("a").alias("u"), F.col("b").alias("v"))).select("node", F.col("component").alias("label")), "label")
        used.append(label)
    rest, members = _across(labelled(label), t)
    rest, deals = settle(rest, "rest"), settle(_deals(members), "deals")
    used += [rest, deals]
    nodes = deals.select("node").distinct()
    if sets is not None:
        nodes = nodes.join(sets.select("node"), "node", "left_anti")
    more = settle(_set_table(docs, listed.join(nodes, "node", "left_semi").select("node", "rep"), n), "cell_sets")
    sets = more if sets is None else sets.union(more)
    in_cells = settle(_cell_links(deals, sets, t, width), "cell_links")
    used += [more, in_cells]
    if near is None:
        near = spark.createDataFrame([], "a long, b long, sa int, sb int, overlap int")
    centre = near.groupBy("a").agg(F.min(F.struct("b", "sb", "overlap", "sa")).alias("m")).select(F.col("a").alias("node"), F.col("m.b").alias("centre"), F.col("m.sb").alias("centre_size"), F.col("m.overlap").alias("shared"))
    far = settle(_derived(rest, centre, docs, listed, sets, n, t, width), "far")
    ends = lambda df: df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(ends(near).union(ends(in_cells)).union(ends(far)).union(_one_id(rows)))
    own = classes.select("s1", "s2", "size", "rep", "class_size").join(found.select(F.col("node").alias("s1"), "component"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    low = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = own.join(low, "component").select("s1", "s2", "size", F.col("rep").alias("class_id"), "class_size", "component_id")
    member = settle(member, "member")
    for old in (*used, far):
        forget(old)
    out = rows.join(member, ["s1", "s2", "size"], "left")
    return out.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_size", F.lit(1))).alias("class_size"),
    )


def _one_id(rows: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of rows that share an id."""
    held = rows.where("size > 0 and doc_id is not null").select("doc_id", "s1")
    several = held.groupBy("doc_id").agg(F.min("s1").alias("v"), F.max("s1").alias("high")).where("v < high")
    return held.join(several, "doc_id").where("s1 <> v").select(F.col("s1").alias("u"), "v").distinct()


def _derived(rest: DataFrame, centre: DataFrame, docs: DataFrame, listed: DataFrame, sets: DataFrame | None, n: int, t: Fraction, width: int) -> DataFrame:
    """The links among `rest`, decided from their centres' overlap where its bounds allow."""
    side = lambda x: centre.select(F.col("node").alias(x), F.col("centre").alias(f"c{x}"), F.col("centre_size").alias(f"z{x}"), F.col("shared").alias(f"k{x}"))
    own = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", "sa", "sb",
        F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"),
        F.coalesce("za", "sa").alias("za"), F.coalesce("zb", "sb").alias("zb"),
        F.coalesce("ka", "sa").alias("ka"), F.coalesce("kb", "sb").alias("kb"),
    )
    own = settle(own, "own")
    first = own.where("ca <> cb").groupBy("ca", "cb").agg(F.first("za").alias("za"), F.first("zb").alias("zb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("za").alias("sa"), F.col("zb").alias("sb"))
    first = settle(first, "centre_pairs")
    nodes = _distinct_nodes(own, "a", "b", "ca", "cb")
    if sets is not None:
        nodes = nodes.join(sets.select("node"), "node", "left_anti")
    more = settle(_set_table(docs, listed.join(nodes, "node", "left_semi").select("node", "rep"), n), "more_sets")
    every = more if sets is None else sets.union(more)
    known = settle(_overlaps(first, every, width), "centre_overlaps")
    bound = own.join(known.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("overlap").alias("o")), ["ca", "cb"], "left")
    bound = bound.withColumn("o", F.coalesce("o", "za"))
    up = F.col("o") + (F.col("sa") - F.col("ka")) + (F.col("sb") - F.col("kb"))
    down = F.col("o") - (F.col("za") - F.col("ka")) - (F.col("zb") - F.col("kb"))
    goal = lambda x: x * F.lit(t.numerator + t.denominator) >= (F.col("sa") + F.col("sb")) * F.lit(t.numerator)
    bound = settle(bound.where(goal(up)).withColumn("sure", goal(down)).select("a", "b", "sa", "sb", "sure"), "bounded")
    read = _overlaps(bound.where("not sure").select("a", "b", "sa", "sb"), every, width).where(_links(t)).select("a", "b")
    return bound.where("sure").select("a", "b").union(read)
