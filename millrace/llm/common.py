"""Shared plumbing: settled tables, byte-packed exchanges and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints/millrace"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only for a local master that names none."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


#: Parquet's writer looks at the size of its pages and groups after 100 rows at the earliest, unless told so.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def settle(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}/{name}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a settled table that nothing will read again."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int, *more: str):
    """Python gets at most `rows` rows at a time from the jobs that run inside: for tables of very large rows; so do the settings `more`."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", *more)
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        for name, was in zip(names, before, strict=True):
            spark.conf.set(name, was)


def wide_rows(spark: SparkSession, rows: int):
    """arrow_rows, also for the reader of Parquet, which else makes room for 4,096 rows of any size."""
    return arrow_rows(spark, rows, "spark.sql.parquet.columnarReaderBatchSize")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange(df: DataFrame, part: str, width: int) -> DataFrame:
    """Rows of equal `part` (0 <= part < width) meet in one task; every task gets one part."""
    return df.repartitionById(width, F.col(part).cast("int"))


#: Rows and bytes of the Arrow batches that Python gets, unless the session asks for smaller ones.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def _small_batches(spark: SparkSession) -> None:
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.match(r"-?[0-9]+", spark.conf.get(name))[0])
        if now <= 0 or now > most:
            spark.conf.set(name, most)


@contextlib.contextmanager
def _lean():
    """A task's memory goes back to the system when it ends: workers live on, and what they keep adds up over the jobs of a session."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        yield
    finally:
        with contextlib.suppress(AttributeError, OSError):  # no such call outside glibc
            ctypes.CDLL(None).malloc_trim(0)


def per_batch(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches):
        with _lean():
            for batch in batches:
                if batch.num_rows:
                    yield from f(batch)

    _small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_task(df: DataFrame, schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches):
        with _lean():
            yield from f(b for b in batches if b.num_rows)

    _small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def longs(column: pa.Array) -> np.ndarray:
    """An int64 column without nulls as numpy."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def packed(rows: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column: the bytes of rows[first[i]:first[i+1]]."""
    size = rows.dtype.itemsize
    data = np.ascontiguousarray(rows).view(np.uint8) if len(rows) else np.empty(0, np.uint8)
    offsets = (first * size).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return whole.cast(pa.binary())


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [s, s + c)."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component in these edges) of nodes that are not their own smallest."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


#: Edges that a task contracts at once.  As many or fewer in all are finished by one task of that bounded size.
CONTRACT_ROWS = 1 << 18


def _contract(edges: DataFrame) -> DataFrame:
    def run(batches):
        held, n = [], 0

        def out():
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = _forest(u, v)
            return record(u=a, v=b)

        for batch in batches:
            held.append((longs(batch.column(0)), longs(batch.column(1))))
            n += batch.num_rows
            if n >= CONTRACT_ROWS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return per_task(edges, "u long, v long", run)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that is not its component's smallest.

    Alternates large-star and small-star steps until nothing changes.  Each step is a
    grouped minimum, which is combined before the shuffle, and an equi-join whose hot
    side the engine may split; no node's neighbours are gathered in one place.
    """
    edge = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # Every task contracts its own edges first.
    e = settle(_contract(edges.where("u <> v").select("u", "v")), "edges")
    if e.count() <= CONTRACT_ROWS:
        return _contract(exchange(e.withColumn("part", F.lit(0)), "part", 1).select("u", "v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    e = settle(edge(e), "edges")
    state = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edge(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, e = e, settle(edge(small), "edges")
        forget(old)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
