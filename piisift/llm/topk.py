"""Exact top-k inner products by block-at-a-time pruning.

Candidates are stored in blocks of a document range (consecutive rows of the
input): a forward index, the block's integer vectors, and per dimension (the
"terms" of a dense vector) the block's largest and smallest component.  A
query's best possible score in a block is the sum over its dimensions of the
better of the two products.  A first round scores, per query, the blocks with
the highest bounds; the k-th score found is a floor.  The second round scores,
in order of their bounds, the blocks whose bound reaches the floor, which rises
as better candidates are found.

The statement fixes the queries as a set run against all rows; queries go in
blocks as well, so all traffic is (query block, block) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piisift.llm.common import cut

BLOCK_ROWS, QUERY_ROWS, FIRST_BLOCKS, GROUP_BLOCKS, SALTS = 1024, 256, 2, 256, 16
NO_FLOOR = -(1 << 63)


def _usable(vector: Column) -> Column:
    """Not null, no null and no non-finite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def _bytes(x: np.ndarray) -> bytes:
    """Integers as 32 bits when they fit, else 64 (told apart by length)."""
    narrow = not len(x) or (x.max() < 1 << 31 and x.min() >= -(1 << 31))
    return x.astype(np.int32 if narrow else np.int64).tobytes()


def _blocks(rows: int):
    """(id, vector, floor) rows -> blocks ``block, dim, n, ids, floors, data, top, low`` of consecutive rows of one dimension."""
    names = ["block", "dim", "n", "ids", "floors", "data", "top", "low"]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, lists, floors = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            dims = pc.list_value_length(lists).to_numpy()
            values = np.floor(1024.0 * lists.flatten().to_numpy().astype(np.float64))
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), rows):
                    part = at[k : k + rows]
                    data = values[(starts[part][:, None] + np.arange(dim)).astype(np.int64)].astype(np.int64).reshape(len(part), dim)
                    row = [number, dim, len(part), ids[part].tobytes(), floors[part].tobytes(), _bytes(data.ravel()), data.max(axis=0).tobytes(), data.min(axis=0).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)
                    number += 1

    return task


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bounds of up to ``GROUP_BLOCKS`` blocks of one dimension side by side."""
    held: dict[int, list] = {}

    def close(dim: int) -> pa.RecordBatch:
        blocks, tops, lows = zip(*held.pop(dim), strict=True)
        row = [dim, blocks[0], np.array(blocks, dtype=np.int64).tobytes(), b"".join(tops), b"".join(lows)]
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["gdim", "first", "blocks", "tops", "lows"])

    for batch in batches:
        for block, dim, top, low in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.setdefault(dim, []).append((block, top, low))
            if len(held[dim]) == GROUP_BLOCKS:
                yield close(dim)
    for dim in list(held):
        yield close(dim)


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * n * dim else np.int64
    return np.frombuffer(data, dtype=kind).reshape(n, dim).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in doubles while every partial sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per query and block the sum of the better product of each dimension."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return _product(plus, top) + _product(minus, low)


def _select(first: bool):
    """(query block, group of block bounds) rows -> (block, query block, queries to score there, their bounds)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = _matrix(row["data"], row["n"], row["dim"])
                blocks = np.frombuffer(row["blocks"], dtype=np.int64)
                top, low = (np.frombuffer(row[x], dtype=np.int64).reshape(len(blocks), row["dim"]) for x in ("tops", "lows"))
                bound = _bounds(q, top, low)
                if first:
                    take = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(take, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
                else:
                    take = bound >= np.frombuffer(row["floors"], dtype=np.int64)[:, None]
                use = np.flatnonzero(take.any(axis=0))
                who = [np.flatnonzero(take[:, j]) for j in use]
                at = [bound[w, j] for w, j in zip(who, use, strict=True)]
                columns = [blocks[use], [row["qblock"]] * len(use), [w.astype(np.int32).tobytes() for w in who], [b.tobytes() for b in at], [int(b.max()) for b in at]]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "qblock", "who", "bound", "most"])

    return task


def _score(k: int):
    """Pairs of a query block and a block, by falling bound -> each query's best ``k`` in the block that can still matter."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["qblock"] != current:
                    current, best = row["qblock"], {}
                    floors = np.frombuffer(row["floors"], dtype=np.int64).copy()
                who, bound = np.frombuffer(row["who"], dtype=np.int32), np.frombuffer(row["bound"], dtype=np.int64)
                who = who[bound >= floors[who]]
                if not len(who):
                    continue  # no query of the block can reach its k-th score here
                ids, qids = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["qids"], dtype=np.int64)
                scores = _product(_matrix(row["qdata"], row["qn"], row["dim"])[who], _matrix(row["data"], row["n"], row["dim"]))
                out = []
                for i, w in enumerate(who.tolist()):
                    s = scores[i]
                    other = np.flatnonzero((s >= floors[w]) & (ids != qids[w]))
                    other = other[np.lexsort((ids[other], -s[other]))[:k]]
                    if not len(other):
                        continue
                    out.append((np.full(len(other), qids[w]), ids[other], s[other]))
                    best[w] = sorted([*best.get(w, []), *s[other].tolist()], reverse=True)[:k]
                    if len(best[w]) == k:
                        floors[w] = max(floors[w], best[w][-1])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return task


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` highest integer inner products.

    Components are ``floor(1024 * x)``, taken to be below 2^53 in size.
    Candidates are all rows whose id is not the query's; ties go to the smaller
    id.  Vectors that are null or hold null or non-finite components, and rows
    with a null id, take no part; only vectors of one length meet.  Of rows
    that repeat an id each counts as a candidate, and one query runs (the one
    with the least vector).  Extra columns are not read; an empty table gives
    an empty result.
    """
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, vector = F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")
    good = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col)))
    asked = good.where(is_query).groupBy(key).agg(F.min(vector_col).alias("vector"))
    layout = "block long, dim int, n int, ids binary, floors binary, data binary, top binary, low binary"
    none = F.lit(NO_FLOOR).cast("long").alias("floor")
    blocks = cut(good.select(key, vector, none).mapInArrow(_blocks(BLOCK_ROWS), layout))
    groups = cut(blocks.select("block", "dim", "top", "low").mapInArrow(_groups, "gdim int, first long, blocks binary, tops binary, lows binary"))
    dealt = groups.withColumn("gsalt", F.pmod(F.xxhash64("first"), F.lit(SALTS)).cast("int")).drop("first")

    def search(queries: DataFrame, first: bool) -> DataFrame:
        """The best ``k`` candidates of each query in the blocks chosen for it."""
        queries = cut(queries.mapInArrow(_blocks(QUERY_ROWS), layout)).select(F.col("block").alias("qblock"), "dim", "n", "ids", "floors", "data")
        spread = queries.drop("ids").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        meet = spread.join(dealt, (F.col("dim") == F.col("gdim")) & (F.col("salt") == F.col("gsalt")))
        chosen = meet.mapInArrow(_select(first), "block long, qblock long, who binary, bound binary, most long")
        pairs = chosen.join(blocks.select(F.col("block").alias("b"), "n", "ids", "data"), F.col("block") == F.col("b"))
        q = queries.select(F.col("qblock").alias("q"), "dim", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), "floors")
        pairs = pairs.join(q, F.col("qblock") == F.col("q")).drop("b", "q")
        part = F.pmod(F.xxhash64("block"), F.lit(SALTS))
        pairs = pairs.repartition(partitions, "qblock", part).sortWithinPartitions("qblock", F.desc("most"))
        rows = pairs.mapInArrow(_score(k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = search(asked.select("id", "vector", none), first=True)
    floor = found.where(F.col("rank") == k).select(F.col("query_id").alias("q"), "score")
    with_floor = asked.join(floor, F.col("id") == F.col("q"), "left").select("id", "vector", F.coalesce("score", F.lit(NO_FLOOR).cast("long")).alias("floor"))
    return search(with_floor, first=False)
