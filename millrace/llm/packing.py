"""Packing of token sequences by minimum bin slack.

A text's ids, then one closing id, are cut into pieces of `capacity` and a rest.  The
rests are packed in groups of about GROUP_PIECES: the longest piece left opens a
sequence, and a bitset subset-sum search over the multiset of remaining lengths picks
those that fill the window closest to capacity; the counts taken of each length are
read back from the bitsets that the search went through.

Null and empty texts are the closing id alone.  Ids travel with their pieces only as a
CRC, so the packing stage moves a few numbers for each piece.  Null document ids and
repeated rows are packed like any other row.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import words as W
from .common import exchange, per_batch, per_task, record, settle

CAPACITY = 4096
END_ID = 2
#: Pieces that one task packs; a group's unfilled end costs at most one sequence.
GROUP_PIECES = 32768


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length (sorted `lengths`, available `counts`) fill `room` closest without passing it."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    k = bisect.bisect_right(lengths, room)
    for length in reversed(lengths[:k]):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece; sizes are 1 to capacity."""
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    held: dict[int, list[int]] = {}
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        held.setdefault(n, []).append(i)
    counts = {n: len(x) for n, x in held.items()}
    lengths = sorted(counts)
    number = 0

    def use(n: int, at: int) -> int:
        i = held[n].pop()
        sequence[i], offset[i] = number, at
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
            lengths.pop(bisect.bisect_left(lengths, n))
        return at + n

    while lengths:
        at = use(lengths[-1], 0)
        if at < capacity and lengths:
            for n, times in fill(lengths, counts, capacity - at).items():
                for _ in range(times):
                    at = use(n, at)
        number += 1
    return sequence, offset


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for at, raws in W.chunks(batch.column(1).to_pylist()):
            ids, first = coder.encode(raws)
            which, start, length, crc, total = [], [], [], [], []
            for k in range(len(raws)):
                own = np.append(ids[first[k] : first[k + 1]], end_id).astype("<u4")
                for s in range(0, len(own), capacity):
                    part = own[s : s + capacity]
                    which.append(at + k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(own))
            yield record(doc_id=batch.column(0).take(pa.array(which)), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), doc_tokens=pa.array(total, pa.int64()))

    return per_batch(docs, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", run)


def pack_documents(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pieces = settle(_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    dealt = exchange(pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")), "part", groups)

    def run(batches):
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        sequence, offset = pack(rows.column("length").to_numpy(), capacity)
        group = rows.column("part").to_numpy().astype(np.int64)
        out = rows.drop_columns(["part"]).append_column("sequence_id", pa.array((group << 32) + sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=1 << 16)

    return per_task(dealt, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", run)
