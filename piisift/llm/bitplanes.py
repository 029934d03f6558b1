"""Centroid clustering on bit planes: exact integer distances from AND and popcount.

A vector of up to 64 integers is kept as bit planes: plane b packs bit b of
every component (two's complement) into one 64-bit word.  An inner product is
then a weighted sum of popcounts: bit planes b of a vector and c of a centroid
share ``popcount(x_b & y_c)`` components, each worth ``2^b * 2^c``, the last
plane of either counting negative.  Squared distances and component sums
follow exactly from the planes, which are written once and read by each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import cut

#: Scaled components beyond this size count as this size, so that squared distances fit in a long.
LARGEST = 1 << 26
#: Vectors compared at once inside a task.
ROWS = 8192


def pack(values: np.ndarray) -> np.ndarray:
    """(vectors, planes) 64-bit words of integer vectors of at most 64 components; as few planes as the largest needs."""
    most = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
    places = np.zeros((len(values), 64), dtype=np.int64)
    places[:, : values.shape[1]] = values
    planes = [np.packbits(((places >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0] for b in range(most.bit_length() + 1)]
    return np.stack(planes, axis=1)


def weights(planes: int) -> np.ndarray:
    """Worth of each plane; the last one holds the signs."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of packed vectors: row by row, or of every row of ``a`` with the one vector ``b``."""
    out = np.zeros(len(a), dtype=np.int64)
    for i, x in enumerate(weights(a.shape[1]).tolist()):
        for j, y in enumerate(weights(b.shape[-1]).tolist()):
            out += x * y * np.bitwise_count(a[:, i] & b[..., j]).astype(np.int64)
    return out


def component_sums(planes: np.ndarray) -> np.ndarray:
    """Sum of each of the 64 components over packed vectors."""
    sums = np.zeros(64, dtype=np.int64)
    for b, w in enumerate(weights(planes.shape[1]).tolist()):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += w * bits.sum(axis=0, dtype=np.int64)
    return sums


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of packed vectors; ties go to the smaller number."""
    packed, own = pack(centroids), products(planes, planes)
    best, at = np.full(len(planes), np.iinfo(np.int64).max), np.zeros(len(planes), dtype=np.int32)
    for number, (centroid, norm) in enumerate(zip(packed, (centroids * centroids).sum(axis=1).tolist(), strict=True)):
        distance = own + norm - 2 * products(planes, centroid)
        closer = distance < best
        best[closer], at[closer] = distance[closer], number
    return at, best


def _packed(scale: int, dim: int):
    """(id, vector) rows -> (id, planes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                scaled = np.floor(scale * batch.column(1).flatten().to_numpy().astype(np.float64))
                planes = pack(np.clip(scaled, -LARGEST, LARGEST - 1).astype(np.int64).reshape(-1, dim))
                data = pa.array([row.tobytes() for row in planes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["id", "planes"])

    return task


def _alike(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their planes as a matrix) for each number of planes in a batch, ``ROWS`` rows at a time."""
    column = pa.concat_arrays([column.cast(pa.binary())])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[: len(column) + 1].astype(np.int64)
    words, sizes = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint64), np.diff(offsets) // 8
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield part, words[offsets[part][:, None] // 8 + np.arange(size)]


def _assign(centroids: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, best = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
            for rows, planes in _alike(batch.column(1)):
                at[rows], best[rows] = nearest(planes, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(best)], names=["id", "cluster", "distance"])

    return task


def _partial_sums(centroids: np.ndarray):
    """One row per cluster and task: its number of vectors and the sum of each component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), 64), dtype=np.int64)
        for batch in batches:
            for _, planes in _alike(batch.column(0)):
                at, _ = nearest(planes, centroids)
                for c in np.unique(at):
                    counts[c] += int((at == c).sum())
                    sums[c] += component_sums(planes[at == c])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return task


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(``id, cluster, distance`` per vector; ``cluster, centroid, cluster_inertia, inertia`` per cluster): exact integer k-means.

    Vectors are ``floor(scale * x)`` of exactly ``dim`` (at most 64) finite
    components; other rows take no part.  Components beyond ``LARGEST`` after
    scaling count as that size.  The first centroids are the ``k`` vectors (or
    all, if fewer) with the least SHA-256 of ``seed:id``, in that order; a
    vector without an id starts a centroid only if there are not enough others,
    and repeated ids go by their vectors.  Each round assigns every vector to
    the nearest centroid (ties: smaller number) and moves each centroid with
    vectors to the floor of their mean; then all are assigned once more.
    ``distance`` is squared; inertias are its sums over the cluster and over all
    (at most the largest long).  Repeated rows count each; other columns are
    not read; without usable vectors both results are empty.  Only ``k``
    centroids and ``k`` rows of sums reach the driver in a round.
    """
    if not 1 <= dim <= 64:
        raise ValueError("a plane holds at most 64 components")
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = vectors.select(F.col(id_col).alias("id"), vector.cast("array<double>").alias("vector")).where(vector.isNotNull() & (F.size(vector) == dim) & finite)
    kind = usable.schema["id"].dataType.simpleString()
    packed = cut(usable.mapInArrow(_packed(scale, dim), f"id {kind}, planes binary"))

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = usable.select(hashed.alias("h"), F.transform("vector", lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST - 1)), F.lit(-LARGEST))).alias("v"))
    start = first.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), dim)
    for _ in range(rounds if len(start) else 0):
        parts = packed.select("planes").mapInArrow(_partial_sums(centroids), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dim)]).alias("sums"))
        for r in total.collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    # without a first centroid there is no vector to assign either
    found = cut(packed.mapInArrow(_assign(centroids if len(start) else np.zeros((1, dim), dtype=np.int64)), f"id {kind}, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most, total = (1 << 63) - 1, sum(sums.values())
    clusters = [(i, c, min(most, sums.get(i, 0)), min(most, total)) for i, c in enumerate(centroids.tolist())]
    return found, spark.createDataFrame(clusters, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
