"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of ``WIDTH`` bytes slide over the text in
steps of ``STRIDE``, and the text is covered by chunks of ``CHUNK`` bytes that
overlap by half.  Within a chunk each filter keeps its largest response; over
all chunks of the document, first to last, these are combined by their mean and
their maximum into one probability.

For scoring, embedding and filters fold into one table per filter position
(byte -> response of every filter), so the convolution is eight table look-ups
and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import spans_of, text_array, text_slices
from piisift.llm.labelled import fit_line, fit_on_sample, logistic

WIDTH, STRIDE, CHUNK, FILTERS, EMBED = 8, 4, 512, 24, 8
HALF = CHUNK // 2
#: Documents of each label that the network is fitted on (on average, chosen by hash).
PER_CLASS = 3000
STEPS, BATCH, CHUNKS_A_DOC, RATE = 600, 48, 6, 0.01


def halves(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' bytes, each padded with zeros to whole half chunks, WIDTH zeros at the end; half chunks per text)."""
    data, ends = spans_of(texts)
    sizes = np.diff(ends)
    count = np.maximum(1, -(-sizes // HALF))
    begin = (np.cumsum(count) - count) * HALF
    out = np.zeros(int(count.sum()) * HALF + WIDTH, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(begin - ends[:-1], sizes)] = data
    return out, count


class QualityModel:
    """Tables of filter responses by position and byte, output weights, and the calibration."""

    def __init__(self, embed: np.ndarray, filters: np.ndarray, shift: np.ndarray, out: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.tables = np.einsum("be,kef->kbf", embed, filters).astype(np.float32)
        self.shift, self.out, self.bias, self.slope, self.offset = shift.astype(np.float32), out, bias, slope, offset

    def features(self, texts: pa.Array) -> np.ndarray:
        """Mean and maximum over the chunks of each filter's largest response; one row per text."""
        data, count = halves(texts)
        per_half = HALF // STRIDE
        tops = np.empty((int(count.sum()), len(self.shift)), dtype=np.float32)
        last = np.zeros(len(tops), dtype=bool)
        last[np.cumsum(count) - 1] = True
        for k in range(0, len(tops), 4096):
            n = min(4096, len(tops) - k)
            at = np.arange(n * per_half) * STRIDE + k * HALF
            response = self.tables[0][data[at]]
            for j in range(1, WIDTH):
                response += self.tables[j][data[at + j]]
            response = response.reshape(n, per_half, -1)
            response[last[k : k + n], -1] = -np.inf  # it would reach into the next text; the one before ends with this one's last byte
            tops[k : k + n] = response.max(axis=1)
        tops = np.maximum(tops + self.shift, 0)
        chunk = tops.copy()  # a chunk is a half and the next one of the same text
        chunk[:-1] = np.where(last[:-1, None], tops[:-1], np.maximum(tops[:-1], tops[1:]))
        use = ~last | np.repeat(count == 1, count)
        chunks = np.maximum(count - 1, 1)
        begin = np.cumsum(chunks) - chunks
        mean = np.add.reduceat(chunk[use].astype(np.float64), begin, axis=0) / chunks[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk[use], begin, axis=0)], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.features(texts) @ self.out + self.bias if len(texts) else np.zeros(0)

    def probability(self, texts: pa.Array) -> np.ndarray:
        return logistic(self.slope * self.score(texts) + self.offset)


def train(texts: pa.Array, y: np.ndarray, share: float, seed: int = 7) -> QualityModel:
    """The network, fitted with Adam on random chunks of whole documents; a fifth of the sample is kept back for the calibration."""
    rng = np.random.default_rng(seed)
    params = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 0.5 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
        "shift": np.zeros(FILTERS),
        "out": rng.normal(0, 0.1, 2 * FILTERS),
        "bias": np.zeros(1),
    }
    fit = np.arange(len(y)) % 5 != 0
    if not fit.any() or y[fit].min() == y[fit].max():
        model = QualityModel(params["embed"], params["filters"], params["shift"], 0 * params["out"], 0.0)
        model.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    data, count = halves(texts.filter(pa.array(fit)))
    begin, fit_y = (np.cumsum(count) - count) * HALF, y[fit]
    ones, zeros = np.flatnonzero(fit_y == 1), np.flatnonzero(fit_y == 0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    window = np.arange(0, CHUNK, STRIDE)[:, None] + np.arange(WIDTH)

    for t in range(1, STEPS + 1):
        docs = np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 2)])
        halves_of = np.maximum(count[docs] - 1, 1)
        chunk = (rng.random((BATCH, CHUNKS_A_DOC)) * halves_of[:, None]).astype(np.int64)
        at = (begin[docs][:, None] + chunk * HALF).ravel()
        at = np.minimum(at, len(data) - CHUNK - WIDTH) if len(data) > CHUNK + WIDTH else at * 0
        grid = np.minimum(at[:, None, None] + window, len(data) - 1)
        symbols = data[grid]
        # bytes past a one-half document belong to the next one
        symbols[(grid >= (begin[docs] + count[docs] * HALF).repeat(CHUNKS_A_DOC)[:, None, None])] = 0
        x = params["embed"][symbols].reshape(len(at), len(window), -1)
        response = x @ params["filters"].reshape(-1, FILTERS)
        peak = response.argmax(axis=1)
        top = np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0] + params["shift"]
        hidden = np.maximum(top, 0).reshape(BATCH, CHUNKS_A_DOC, FILTERS)
        best = hidden.argmax(axis=1)
        features = np.concatenate([hidden.mean(axis=1), hidden.max(axis=1)], axis=1)
        p = logistic(features @ params["out"] + params["bias"][0])
        g = (p - fit_y[docs]) / BATCH
        back = g[:, None] * params["out"][None, :]
        g_hidden = np.repeat(back[:, None, :FILTERS] / CHUNKS_A_DOC, CHUNKS_A_DOC, axis=1)
        np.put_along_axis(g_hidden, best[:, None, :], np.take_along_axis(g_hidden, best[:, None, :], axis=1) + back[:, None, FILTERS:], axis=1)
        g_top = g_hidden.reshape(-1, FILTERS) * (top > 0)
        picked = x[np.arange(len(at))[:, None], peak]
        flat = params["filters"].reshape(-1, FILTERS)
        g_x = (g_top[:, :, None] * flat.T[None]).reshape(-1, EMBED)
        g_embed = np.zeros((256, EMBED))
        np.add.at(g_embed, symbols[np.arange(len(at))[:, None], peak].reshape(-1), g_x)
        grads = {
            "embed": g_embed,
            "filters": np.einsum("cf,cfe->ef", g_top, picked).reshape(WIDTH, EMBED, FILTERS),
            "shift": g_top.sum(axis=0),
            "out": features.T @ g + 1e-4 * params["out"],
            "bias": np.array([g.sum()]),
        }
        rate = RATE * min(1.0, 2.0 * (1 - t / (STEPS + 1)))
        for k, grad in grads.items():
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            params[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = QualityModel(params["embed"], params["filters"], params["shift"], params["out"], float(params["bias"][0]))
    model.slope, model.offset = fit_line(model.score(texts.filter(pa.array(~fit))), y[~fit], share)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, **columns) -> QualityModel:
    model = QualityModel.__new__(QualityModel)
    vars(model).update(fit_on_sample(docs, labels, "quality", usable, per_class, train, **columns))
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the probability that the text is of good quality, from its whole length.

    Null and empty texts are one chunk of zeros.  Repeated rows and null ids
    are scored row by row; extra columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.probability(text_array(part)), pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
