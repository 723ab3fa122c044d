"""Exact cosine near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned into the basis of their second-moment
matrix, leading dimensions first.  Linked vectors differ by at most reach =
sqrt(2 (1 - t)) in any dimension, so vectors of one label lie in a grid of that width over
the leading dimensions, more of them for a label of more vectors, and only neighbouring
cells are met.  A cell is dealt into tiles of at most TILE_ROWS and TILE_BYTES with boxes
over the first dimensions.  Of two tiles whose boxes come as close as reach, those rows of
the one move that come as close to the box of the other.  Where the spread is even over
the dimensions no box prunes, and a vector moves about once for every two tiles of its
label: large tiles keep that small, and few dimensions keep the cells from breaking them up.
Two tiles are compared in blocks of at most PAIRS pairs: the product of the leading
dimensions and the suffix norms bounds the cosine from above, by one matrix product, and
what that leaves is decided by the cosine of the vectors as given, in double precision; they
are scaled by a power of two, which changes no quotient, so that no square overflows.

Equal vectors of a label are one class, compared once.  A tile pair returns degrees and
a spanning forest, never its pairs, so groups of near copies stay linear in what moves.

Null, zero-length or all-zero vectors, vectors with null or non-finite components and
vectors without a label link with nothing.  Vectors of different lengths never link.
Null ids keep their row with null component and kept.  Rows that share an id are one node
of the components; n_links counts the rows that link with the row's own vector.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, _forest, components, exchange, forget, per_batch, per_task, record, settle, shuffle_width, spread, wide_rows

#: A tile's rows and bytes of vectors, at most (hashing deals rows a little unevenly).
TILE_ROWS, TILE_BYTES = 4096, 2 << 20
#: Leading dimensions of the grid, at most, and tiles that a group of one tile's comparisons meets.
MOST_DIMS, GROUP = 5, 16
#: Dimensions of a tile's box, and of the bound.
BOX_DIMS, LEAD = 8, 16
#: Pairs that are bounded at once, and components of vectors that are multiplied at once.
PAIRS, PRODUCTS = 1 << 20, 1 << 20
#: Room for rounding in bounds; the final test has none.
SLACK = 1e-9


def _vectors(batch: pa.RecordBatch, column: str):
    """(row numbers, matrix) of the usable vectors of each length."""
    lists = batch.column(batch.schema.get_field_index(column))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(0)
    ok = np.asarray(lists.is_valid()) & (size > 0)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1]
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        x = values[spread(starts[rows], np.full(len(rows), d))].reshape(len(rows), d)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield rows[good], x[good]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, their largest component between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the basis of the second-moment matrix, leading dimension first."""

    def run(batch):
        x = [np.frombuffer(v) for v in batch.column(0).to_pylist()]
        for d in {len(v) for v in x}:
            u = _unit(np.stack([v for v in x if len(v) == d]))
            m = u.T @ u
            yield record(d=pa.array([d] * (d * d), pa.int32()), k=pa.array(np.arange(d * d), pa.int32()), value=pa.array(m.reshape(-1)))

    sums = per_batch(rows.select("vector"), "d int, k int, value double", run).groupBy("d", "k").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for d, own in sums.groupby("d"):
        m = np.zeros(d * d)
        m[own["k"].to_numpy()] = own["value"].to_numpy()
        m = m.reshape(d, d)
        _, basis = np.linalg.eigh((m + m.T) / 2)
        out[int(d)] = np.ascontiguousarray(basis[:, ::-1])
    return out


def _keys(rows: DataFrame) -> DataFrame:
    """(vec_id, label, key, vector): key names the class of equal vectors; null where a vector cannot link."""

    def run(batch):
        n = batch.num_rows
        keys, vectors = [None] * n, [None] * n
        labels = batch.column(1).to_pylist()
        for at, x in _vectors(batch, "embedding"):
            for i, v, scaled in zip(at.tolist(), x, _scaled(x), strict=True):
                if labels[i] is not None:
                    keys[i] = hashlib.blake2b(f"{labels[i]}\0".encode() + (v + 0.0).tobytes(), digest_size=16).digest()
                    vectors[i] = (scaled + 0.0).tobytes()
        yield record(vec_id=batch.column(0), label=batch.column(1), key=pa.array(keys, pa.binary()), vector=pa.array(vectors, pa.binary()))

    return per_batch(rows, "vec_id long, label string, key binary, vector binary", run)


def _cells(classes: DataFrame, basis, width: float) -> DataFrame:
    """Classes with their cell: whole coordinates of the first `dims` dimensions, comma-joined."""

    def run(batch):
        raws = [np.frombuffer(v) for v in batch.column(3).to_pylist()]
        dims = batch.column(4).to_numpy()
        size = np.array([len(v) for v in raws])
        cell = [""] * len(raws)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            y = np.floor(_unit(np.stack([raws[i] for i in at])) @ basis.value[int(d)][:, :MOST_DIMS] / width).astype(np.int64)
            for i, row in zip(at.tolist(), y.tolist(), strict=True):
                cell[i] = ",".join(map(str, row[: dims[i]]))
        yield record(label=batch.column(0), node=batch.column(1), class_size=batch.column(2), vector=batch.column(3), d=pa.array(size, pa.int32()), cell=pa.array(cell))

    count = classes.groupBy("label").agg(F.greatest(F.lit(1), F.least(F.lit(MOST_DIMS), F.floor(F.log(8.0, F.count("*") / F.lit(TILE_ROWS))))).cast("int").alias("dims"))
    return per_batch(classes.join(count, "label").select("label", "node", "class_size", "vector", "dims"), "label string, node long, class_size long, vector binary, d int, cell string", run)


def _tiles(cells: DataFrame, basis, width: int) -> DataFrame:
    """One row per tile: its cell, box over the leading dimensions, nodes, class sizes and vectors."""
    most = F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_BYTES / 8) / F.col("d"))))
    count = cells.groupBy("label", "d", "cell").agg(F.count("*").alias("n")).select("label", "d", "cell", F.ceil(F.col("n") / most).cast("int").alias("tiles"))
    dealt = cells.join(count, ["label", "d", "cell"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    keys = ["label", "d", "cell", "tile"]
    part = F.pmod(F.xxhash64(*keys), F.lit(width)).cast("int")
    rows = exchange(dealt.select(*keys, "node", "class_size", "vector", part.alias("part")), "part", width).sortWithinPartitions(*keys)

    def tile(key, nodes, sizes, vectors):
        label, d, cell, k = key
        x = np.frombuffer(b"".join(vectors)).reshape(-1, d)
        y = (_unit(x) @ basis.value[d])[:, :BOX_DIMS]
        return record(
            id=pa.array([f"{label}\0{d}\0{cell}\0{k}"]), label=pa.array([label]), d=pa.array([d], pa.int32()), cell=pa.array([cell]), box=pa.array([np.concatenate([y.min(axis=0), y.max(axis=0)]).tolist()], pa.list_(pa.float64())),
            nodes=pa.array([np.array(nodes, np.int64).tobytes()], pa.binary()), sizes=pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), vectors=pa.array([x.tobytes()], pa.binary()),
        )

    def run(batches):
        key, held = None, ([], [], [])
        for batch in batches:
            for label, d, cell, k, *row, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, d, cell, k) != key:
                    if key is not None:
                        yield tile(key, *held)
                    key, held = (label, d, cell, k), ([], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if key is not None:
            yield tile(key, *held)

    return per_task(rows, "id string, label string, d int, cell string, box array<double>, nodes binary, sizes binary, vectors binary", run)


def _near_tiles(meta: DataFrame, reach: float) -> DataFrame:
    """(a, b, box): tiles of neighbouring cells whose boxes come as close as reach, a <= b; box is that of a."""

    def around(batch):
        for tile, label, d, cell, box in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = np.array(cell.split(","), np.int64)
            cells = [",".join(map(str, row)) for row in (own + np.array(list(itertools.product((-1, 0, 1), repeat=len(own))))).tolist()]
            n = len(cells)
            yield record(a=pa.array([tile] * n), label=pa.array([label] * n), d=pa.array([d] * n, pa.int32()), cell=pa.array(cells), box=pa.array([box] * n, pa.list_(pa.float64())))

    asked = per_batch(meta, "a string, label string, d int, cell string, box array<double>", around)
    met = asked.join(meta.select(F.col("id").alias("b"), "label", "d", "cell", F.col("box").alias("other")), ["label", "d", "cell"]).where("a <= b")
    gap = F.expr("aggregate(sequence(0, size(box) div 2 - 1), 0D, (s, k) -> s + pow(greatest(0D, other[k] - box[k + size(box) div 2], box[k] - other[k + size(box) div 2]), 2))")
    return met.where(gap <= reach * reach + SLACK).select("a", "b", "box")


def _lead(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Leading dimensions of the unit vectors and the norm of the rest: of two rows, their product is at least the cosine."""
    y = _unit(x) @ basis
    return np.hstack([y[:, :LEAD], np.sqrt((y[:, LEAD:] ** 2).sum(axis=1, keepdims=True))])


def linked(x: np.ndarray, z: np.ndarray, lead_x: np.ndarray, lead_z: np.ndarray, t: float, same: bool):
    """Blocks of row pairs (i of x, j of z) of cosine at least t; those with i < j where both are the same tile."""
    norm = lambda m: np.sqrt((m * m).sum(axis=1))
    norm_x, norm_z = norm(x), norm(z)
    rows, chunk = max(1, PAIRS // max(1, len(z))), max(1, PRODUCTS // x.shape[1])
    for low in range(0, len(x), rows):
        first = low if same else 0
        i, j = np.nonzero(lead_x[low : low + rows] @ lead_z[first:].T >= t - SLACK)
        i, j = i + low, j + first
        if same:
            on = i < j
            i, j = i[on], j[on]
        on = np.zeros(len(i), bool)
        for k in range(0, len(i), chunk):
            a, b = i[k : k + chunk], j[k : k + chunk]
            on[k : k + chunk] = np.einsum("ij,ij->i", x[a], z[b]) / (norm_x[a] * norm_z[b]) >= t
        if on.any():
            yield i[on], j[on]


def _moved(near: DataFrame, tiles: DataFrame, basis, reach: float) -> DataFrame:
    """(a, g, b, nodes, sizes, vectors, d): of tile b the rows that come as close as reach to the box of a."""

    def run(batch):
        for a, g, b, box, nodes, sizes, vectors, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if a != b:
                x, box = np.frombuffer(vectors).reshape(-1, d), np.array(box).reshape(2, -1)
                y = (_unit(x) @ basis.value[d])[:, : box.shape[1]]
                on = (np.maximum(np.maximum(box[0] - y, y - box[1]), 0) ** 2).sum(axis=1) <= reach * reach + SLACK
                if not on.any():
                    continue
                nodes, sizes, vectors = np.frombuffer(nodes, np.int64)[on].tobytes(), np.frombuffer(sizes, np.int64)[on].tobytes(), x[on].tobytes()
            yield record(a=pa.array([a]), g=pa.array([g], pa.int32()), b=pa.array([b]), nodes=pa.array([nodes], pa.binary()), sizes=pa.array([sizes], pa.binary()), vectors=pa.array([vectors], pa.binary()), d=pa.array([d], pa.int32()))

    rows = near.join(tiles.withColumnRenamed("id", "b").drop("label", "cell", "box"), "b")
    return per_batch(rows.select("a", "g", "b", "box", "nodes", "sizes", "vectors", "d"), "a string, g int, b string, nodes binary, sizes binary, vectors binary, d int", run)


def _compare(near: DataFrame, tiles: DataFrame, basis, t: float, reach: float, width: int) -> DataFrame:
    """(node, degree, parent): links to other classes weighted by their size, and forest edges (degree 0).

    A tile travels once for each group of GROUP tiles that it is compared with.
    """
    own = tiles.select(F.col("id").alias("a"), "nodes", "sizes", "vectors", "d").join(near.select("a", "g").distinct(), "a").select("a", "g", F.lit(None).cast("string").alias("b"), "nodes", "sizes", "vectors", "d")
    moved = _moved(near, tiles, basis, reach)
    part = F.pmod(F.xxhash64("a", "g"), F.lit(width)).cast("int")
    rows = exchange(moved.union(own).withColumn("part", part), "part", width).sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches):
        key, centre = None, None
        for batch in batches:
            for a, g, b, nodes, sizes, vectors, d, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tile = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(vectors).reshape(-1, d)
                lead = _lead(tile[2], basis.value[d])
                if b is None:
                    key, centre = (a, g), (*tile, lead)
                    continue
                assert key == (a, g)
                (na, sa, x, lead_x), (nb, sb, z) = centre, tile
                da, db, forest = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64), []
                for i, j in linked(x, z, lead_x, lead, t, a == b):
                    da += np.bincount(i, sb[j], len(na)).astype(np.int64)
                    db += np.bincount(j, sa[i], len(nb)).astype(np.int64)
                    forest.append(_forest(na[i], nb[j]))
                if not forest:
                    continue
                u, v = _forest(*(np.concatenate(e) for e in zip(*forest, strict=True)))
                node = np.concatenate([na[da > 0], nb[db > 0], u])
                yield record(node=node, degree=np.concatenate([da[da > 0], db[db > 0], np.zeros(len(u), np.int64)]), parent=pa.array([*([None] * (len(node) - len(u))), *v.tolist()], pa.int64()))

    return per_task(rows, "node long, degree long, parent long", run)


def near_duplicates(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    width = shuffle_width(spark)
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("embedding"))
    keyed = settle(_keys(rows), "keyed")
    usable = keyed.where("key is not null and vec_id is not null")
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("class_size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # A class is named by 64 bits of its key: ids may repeat.
    classes = settle(classes.withColumn("node", F.xxhash64("key")), "classes")
    basis = spark.sparkContext.broadcast(_moments(classes))
    reach = math.sqrt(max(0.0, 2 * (1 - threshold))) + SLACK
    cells = settle(_cells(classes, basis, max(reach, 1e-6)), "cells")
    # A tile is a row of up to some megabytes: Parquet and Python get a few at a time.
    tiles = settle(_tiles(cells, basis, width), "tiles", WIDE_ROWS)
    near = _near_tiles(tiles.select("id", "label", "d", "cell", "box"), reach)
    groups = near.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("groups"))
    near = settle(near.join(groups, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")), "near")
    with wide_rows(spark, 8):
        found = settle(_compare(near, tiles, basis, threshold, reach, width), "found")
    degree = found.where("parent is null").groupBy("node").agg(F.sum("degree").alias("degree"))
    held = usable.select("vec_id", F.xxhash64("key").alias("node"))
    several = held.groupBy("vec_id").agg(F.min("node").alias("v"), F.max("node").alias("high")).where("v < high")
    one_id = held.join(several, "vec_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    component = components(found.where("parent is not null").select(F.col("node").alias("u"), F.col("parent").alias("v")).union(one_id))
    member = classes.select("key", "node", "rep", "class_size").join(degree, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = member.join(low, "component").select("key", (F.coalesce("degree", F.lit(0)) + F.col("class_size") - 1).cast("long").alias("n_links"), "component_id")
    member = settle(member, "member")
    for old in (cells, tiles, near, found, classes):
        forget(old)
    out = keyed.select("vec_id", "key").join(member, "key", "left")
    linkable = F.col("vec_id").isNotNull()
    component_id = F.when(linkable, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(linkable, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (component_id == F.col("vec_id")).alias("kept"))
