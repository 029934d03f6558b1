"""A bounded sample of labelled documents for fitting a classifier, and the pieces that the classifiers share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import give_back


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def fit_on_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_class: int, train: Callable, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """The state of a model fitted by ``train(texts, labels, share of label 1)`` on about ``per_class`` documents a class.

    ``usable`` is a condition on ``doc_id`` of the labels.  The sample is chosen
    on the thin label table by a hash of the id, so its size is ``per_class``
    on average at any input size; it is fitted in one task, in the order of the
    hash, and only the fitted arrays reach the driver.  Ids with contradictory
    or null labels are not learnt from; of documents that repeat an id one is
    used.
    """
    votes = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y1"))
    votes = votes.where((F.col("y") == F.col("y1")) & usable)
    totals = {int(r["y"]): r["n"] for r in votes.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    limit = F.when(F.col("y") == 1, F.lit(_cut(per_class, totals.get(1, 0)))).otherwise(F.lit(_cut(per_class, totals.get(0, 0))))
    chosen = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit).select(F.col("doc_id").alias("_i"), "y")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_i"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("h"), "text", F.col("y").cast("long").alias("y"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("text", pa.large_string()), ("y", pa.int64())])
        parts = [pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, schema.types, strict=True)], schema=schema) for b in batches]
        sample = pa.Table.from_batches(parts, schema=schema).sort_by("h").combine_chunks()
        del parts
        texts, y = pa.concat_arrays([*sample["text"].chunks, pa.array([], pa.large_string())]), sample["y"].to_numpy()
        del sample
        state = pickle.dumps(vars(train(texts, y, share)))
        del texts
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])

    fitted = rows.repartition(1).mapInArrow(task, "state binary").collect()
    return pickle.loads(fitted[0]["state"]) if fitted else vars(train(pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64), share))


def _cut(wanted: int, total: int) -> int:
    return int((1 << 30) * min(1.0, wanted / max(1, total)))


def fit_line(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of ``y`` on ``x``; classes are weighted to ``share`` of ones."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, share / max(1, int(y.sum())), (1 - share) / max(1, int((1 - y).sum()))) * len(y)
    middle, scale = float(np.median(x)), float(x.std()) + 1e-9
    z, a, b = (x - middle) / scale, 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - y)
        w = weight * p * (1 - p) + 1e-9
        ga, gb = (g * z).sum() + 0.5 * a, g.sum()
        haa, hab, hbb = (w * z * z).sum() + 0.5, (w * z).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(a / scale), float(b - a * middle / scale)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
