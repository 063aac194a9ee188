"""Centroid clustering over zone maps in Hilbert order (operator 11).

Entries are integers (floor of ``scale`` times the entry), so all distances,
sums and centroids are exact and no result depends on how rows are dealt out.

1. *Order.* Vectors are put in the order of a Hilbert curve through the axes
   along which the first centroids differ most, by one range exchange. The row's hash is
   the second sort key, so a vector that very many rows share is cut between rows.
2. *Zone maps.* Neighbours form blocks; a block stores the least and the largest
   entry of each dimension (its box).
3. *Candidates.* No vector of a block is nearer to a centroid than the box's least
   distance, nor farther than its largest. A centroid whose least distance is above
   some other's largest can be nearest to no vector of the block and is not compared.
4. *Comparison.* The rest is compared exactly, a block at a time.

A round sends the centroids to the tasks and gets back sums by cluster and
dimension: k * (dims + 1) numbers a task, summed by Spark. The blocks are written once.
How much the boxes spare depends on the data: much for separated clusters,
little for vectors that fill the space evenly. The result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_package
from .common import empty, stored
from .vectors import EXACT, ExactSums, decimals, floored, matrix, summed

#: Entries are kept within this bound, so that a squared distance in up to 64 dimensions is a long.
LIMIT = (1 << 27) - 1
AXES, BITS = 8, 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer cells (0 to 2**bits - 1), as big-endian bytes.

    From the highest bit down, the cell's corner turns the lower bits (swapping them with the
    first axis or reversing it); the turned corners in Gray code are the digits.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, own in enumerate(axes):
            high = (own >> level) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ own) & low)
            axes[0] = axes[0] ^ np.where(high, low, swap)
            axes[i] = (axes[0] if i == 0 else own) ^ (0 if i == 0 else swap)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    digits = [((a ^ turn) >> level) & 1 for level in range(bits - 1, -1, -1) for a in axes]
    return np.packbits(np.stack(digits, 1).astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some vector in the box."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(v: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number of equal ones; exact."""
    own = candidates(low, high, centroids)
    c = centroids[own]
    largest = max(int(np.abs(low).max()), int(np.abs(high).max()), int(np.abs(c).max()))
    if 4 * v.shape[1] * largest**2 < 1 << 53:  # whole numbers below 2**53: floating point is exact
        x, y = v.astype(np.float64), c.astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
        at = d.argmin(1)
        return own[at], d[np.arange(len(v)), at].astype(np.int64)
    d = np.stack([((v - one) ** 2).sum(1) for one in c], 1)
    at = d.argmin(1)
    return own[at], d[np.arange(len(v)), at]


def first_centroids(rows: DataFrame, k: int, tag: str) -> np.ndarray:
    """The k vectors with the least sha256 of "tag:id" (ties: the lesser vector); fewer if there are fewer rows."""
    name = F.concat(F.lit(f"{tag}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    top = rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in top], np.int64)


def zone_blocks(rows: DataFrame, centroids: np.ndarray, block_rows: int, rows_per_task: int) -> DataFrame:
    """(ids, v, low, high): neighbours along the curve, ``block_rows`` a block; vectors as little-endian int32.

    The curve's axes and grid come from the first centroids; they decide the layout only.
    """
    dims, id_type = centroids.shape[1], rows.schema["vec_id"].dataType
    spread = centroids.std(0)
    axes = np.argsort(-spread, kind="stable")[:AXES]
    middle, width = centroids.mean(0)[axes], np.maximum(6 * spread[axes], 1.0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), dims)
                grid = np.clip(((v[:, axes] - middle) / width + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                key = [x.tobytes() for x in hilbert_keys(grid, BITS)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()), pa.array(key, pa.binary())],
                                                 ["vec_id", "v", "key"])

    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("v", T.BinaryType()), T.StructField("key", T.BinaryType())])
    curve = stored(rows.select("vec_id", "v").mapInArrow(keyed, schema), "curve")
    n_tasks = max(1, -(-curve.count() // rows_per_task))
    curve = curve.withColumn("salt", F.xxhash64("vec_id"))
    curve = curve.repartitionByRange(n_tasks, "key", "salt").sortWithinPartitions("key", "salt").select("vec_id", "v")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the last block of a batch may be short
            parts = [batch.slice(i, block_rows) for i in range(0, batch.num_rows, block_rows)]
            if not parts:
                continue
            packed = [b"".join(p.column(1).to_pylist()) for p in parts]
            own = [np.frombuffer(p, "<i4").reshape(-1, dims) for p in packed]
            ids = pa.ListArray.from_arrays(np.append(np.arange(0, batch.num_rows, block_rows), batch.num_rows).astype(np.int32), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(packed, pa.binary()), *[pa.array([x.tobytes() for x in side], pa.binary()) for side in ([p.min(0) for p in own], [p.max(0) for p in own])]],
                ["ids", "v", "low", "high"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(c, T.BinaryType()) for c in ("v", "low", "high")]])
    return stored(curve.mapInArrow(blocks, schema), "blocks")


def _each(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for v, low, high in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("v", "low", "high")), strict=True):
        whole = [np.frombuffer(x, "<i4").astype(np.int64) for x in (v, low, high)]
        yield whole[0].reshape(-1, dims), whole[1], whole[2]


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' exact mean; without vectors it stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = ExactSums(k * (dims + 1))
        for batch in batches:
            for v, low, high in _each(batch, dims):
                own, _ = nearest(v, low, high, centroids)
                part = np.zeros((k, dims + 1), np.int64)
                order = np.argsort(own, kind="stable")
                there, first = np.unique(own[order], return_index=True)
                part[there, 1:] = np.add.reduceat(v[order], first, axis=0)
                part[:, 0] = np.bincount(own, minlength=k)
                sums.add(part.ravel())
        cells = [(i, t) for i, t in enumerate(sums.totals()) if t]
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cells], pa.int32()), decimals([t for _, t in cells])], ["cell", "value"])

    total = np.zeros(k * (dims + 1), object)
    for r in summed(blocks.select("v", "low", "high"), run).collect():  # k * (dims + 1) rows at most
        total[r.cell] = int(r.value)
    total, out = total.reshape(k, dims + 1), centroids.copy()
    for i in range(k):
        if total[i, 0]:
            out[i] = [s // total[i, 0] for s in total[i, 1:]]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims, id_type = centroids.shape[1], blocks.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(v, low, high, centroids) for v, low, high in _each(batch, dims)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(np.concatenate([x for x, _ in found]), pa.int32()),
                                                  pa.array(np.concatenate([d for _, d in found]), pa.int64())], ["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return stored(blocks.mapInArrow(run, schema), "assigned")


def compared(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(n_rows, n_candidates) of each block: how many centroids its vectors are compared with."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(len(v), len(candidates(low, high, centroids))) for v, low, high in _each(batch, dims)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([c for _, c in own], pa.int64())], ["n_rows", "n_candidates"])

    return blocks.mapInArrow(run, "n_rows long, n_candidates long")


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, tag: str = "2", id_col: str = "vec_id",
                    vec_col: str = "embedding", block_rows: int = 128, rows_per_task: int = 100_000) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` finite entries.

    Vectors that are null, of another length or with null or non-finite entries are left out.
    Entries beyond +-``LIMIT`` after scaling count as ``LIMIT``. Centroids start as the k vectors with the least
    sha256 of "tag:id" (fewer rows: fewer centroids; a null id counts as "null"; rows repeated under one id by
    their vectors); equal distances go to the smaller number; a centroid without vectors stays. Repeated rows
    repeat. No vectors give no rows. An inertia beyond a long is null. Only id and vector are read.
    """
    if dims > 64:
        raise ValueError("squared distances are exact for up to 64 dimensions")
    spark = vectors.sparkSession
    share_package(spark)
    rows = stored(floored(vectors, scale, LIMIT, id_col, vec_col).filter(F.size("v") == dims), "integer-vectors")
    centroids = first_centroids(rows, k, tag)
    if not len(centroids):
        id_type = rows.schema["vec_id"].dataType.simpleString()
        return empty(spark, f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = zone_blocks(rows, centroids, block_rows, rows_per_task)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    out = assigned(blocks, centroids)
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("s")).collect()}  # k rows
    long = lambda x: x if x < 1 << 63 else None
    whole = long(sum(inertia.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = spark.createDataFrame([(i, long(s), whole, sha[i]) for i, s in sorted(inertia.items())],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
