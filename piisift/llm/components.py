"""Connected components of an edge table by rounds of local union and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import cut


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges (u, v) -> (node, least node reached here); ``moved`` marks nodes that were no ``u`` here."""
    parent: dict[int, int] = {}
    own: set[int] = set()

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        own.update(us)
        for u, v in zip(us, vs, strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in list(parent)]
    rows = [(x, r) for x, r in rows if x != r]
    for k in range(0, len(rows), 1 << 16):
        part = np.array(rows[k : k + (1 << 16)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array([x not in own for x in part[:, 0].tolist()])], names=["u", "v", "moved"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, v`` edges (longs) -> ``node, root`` for every node of an edge, root the least node of its component.

    A round unites the edges that meet at a node in that node's partition and
    then lets every node point where its pointer points; the number of rounds
    grows with the logarithm of the longest chain.  Rounds are cut by
    checkpoints; one flag per round reaches the driver.  Many nodes that point
    to one are many rows of the jump's left side only, which may be split.
    """
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    while True:
        united = state.select("u", "v").repartition(partitions, "u").mapInArrow(_union, "u long, v long, moved boolean")
        onward = united.groupBy("u", (F.col("u") + F.lit(1)).alias("_u1")).agg(F.min("v").alias("w")).select(F.col("u").alias("n"), "w")
        jumped = united.join(onward, F.col("v") == F.col("n"), "left")
        state = cut(jumped.select("u", F.coalesce("w", "v").alias("v"), (F.col("moved") | F.col("w").isNotNull()).alias("moved")))
        if not state.agg(F.max("moved")).first()[0]:
            break
    pairs = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())
