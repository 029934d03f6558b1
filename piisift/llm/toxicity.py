"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the bag of its character 3- to 5-grams (with edges) and itself, each
hashed to an embedding; a span of words is the average of its words; a linear
softmax turns it into the probability of being toxic.  Embeddings and softmax
are trained jointly by mini-batches.  Misspellings share most n-grams with the
words they come from, so they share their vectors.

A few words make a document toxic, so spans, not documents, are averaged: a
document is as toxic as its worst span.  Spans of ``SPAN`` words overlap by
half and cover the whole text.  Training starts with random spans under their
document's label and goes on with each document's worst span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import count_words, give_back, mix64, split_words, text_array, text_slices
from piisift.llm.labelled import fit_line, fit_on_sample, logistic

BUCKET_BITS, DIM, SPAN, STEP, CHUNK_WORDS = 17, 8, 16, 8, 20_000
#: Documents of each label that the model is fitted on (on average, chosen by hash).
PER_CLASS = 4000
EPOCHS, WARM, BATCH, RATE = 14, 3, 256, 0.05
#: Scores are calibrated to at least this share of toxic documents: a missed one weighs more than the mere rate says.
LEAST_SHARE = 0.5
EDGE_SIGNS = " \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the given words and of the words themselves."""
    points = np.frombuffer(("<" + ">\n<".join(words) + ">").encode("utf-32-le"), dtype=np.uint32)
    line = points == 10
    owner = np.cumsum(line)
    values = mix64(points.astype(np.uint64) + np.uint64(1))
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        rolled = values.copy()
        for n in range(2, 6):
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + values[n - 1 :]
            if n < 3:
                continue
            inside = (owner[: len(rolled)] == owner[n - 1 :]) & ~line[: len(rolled)] & ~line[n - 1 :]
            buckets.append(mix64(rolled[inside] + np.uint64(n)))
            owners.append(owner[: len(rolled)][inside])
        starts = np.concatenate([[0], np.flatnonzero(line) + 1])
        powers = np.cumprod(np.full(len(points), 0x9E3779B97F4A7C15, dtype=np.uint64))
        place = np.arange(len(points)) - starts[owner]
        whole = np.zeros(len(words), dtype=np.uint64)
        np.add.at(whole, owner[~line], (values * powers[place])[~line])
        buckets.append(mix64(whole))
        owners.append(np.arange(len(words)))
    return np.concatenate([(b >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for b in buckets]), np.concatenate(owners).astype(np.int32)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words per text, code of every word, distinct words): lower case, signs at the edges cut, words of signs only kept."""
    counts, words = split_words(texts)
    coded = words.dictionary_encode()
    lower = pc.utf8_lower(coded.dictionary)
    bare = pc.utf8_trim(lower, EDGE_SIGNS)
    again = pc.if_else(pc.equal(bare, ""), lower, bare).dictionary_encode()
    codes = again.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    return counts, codes, again.dictionary.to_pylist()


def span_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of the overlapping spans of all texts."""
    spans = np.where(counts > 0, np.maximum(1, -(-(counts - SPAN) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(counts)), spans)
    begin = np.cumsum(counts) - counts
    first = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)) * STEP
    return first, np.minimum(first + SPAN, (begin + counts)[text]), text


class ToxicityModel:
    """One number per bucket (embedding times the softmax's weight difference) and the calibration of span scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def worst(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(largest span score per text, index of that span, first words, end words of spans); the bias alone without words."""
        counts, codes, words = coded_words(texts)
        out, at = np.full(len(counts), self.bias), np.full(len(counts), -1)
        if not len(codes):
            return out, at, codes, codes
        score = np.empty(len(words))
        for k in range(0, len(words), CHUNK_WORDS):
            bucket, owner = subwords(words[k : k + CHUNK_WORDS])
            score[k : k + CHUNK_WORDS] = np.bincount(owner, weights=self.weights[bucket]) / np.bincount(owner)
        total = np.concatenate([[0.0], np.cumsum(score[codes])])
        first, end, text = span_starts(counts)
        value = (total[end] - total[first]) / (end - first) + self.bias
        change = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[change]] = np.maximum.reduceat(value, change)
        hit = np.flatnonzero(value == out[text])
        at[text[hit[::-1]]] = hit[::-1]
        return out, at, first, end

    def probability(self, texts: pa.Array) -> np.ndarray:
        return logistic(self.slope * self.worst(texts)[0] + self.offset)


def train(texts: pa.Array, y: np.ndarray, share: float, seed: int = 7) -> ToxicityModel:
    """The jointly trained model; a fifth of the sample is kept back for the calibration."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    fit = np.arange(len(y)) % 5 != 0
    worded = bool(count_words(texts.filter(pa.array(fit))).any()) if fit.any() else False
    if not worded or y[fit].min() == y[fit].max():
        return ToxicityModel(np.zeros(size), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fit_texts, fit_y = texts.filter(pa.array(fit)), y[fit]
    counts, codes, words = coded_words(fit_texts)
    buckets, sizes = [], []
    for k in range(0, len(words), CHUNK_WORDS):
        bucket, owner = subwords(words[k : k + CHUNK_WORDS])
        buckets.append(bucket[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner))
    bucket, per_word = np.concatenate(buckets), np.concatenate(sizes)
    del buckets, words
    word_start = np.cumsum(per_word) - per_word
    first, end, text = span_starts(counts)
    embed = rng.normal(0, 0.1, (size, DIM))
    soft, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    embed_sum, soft_sum, bias_sum = np.full(size, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    balance = np.array([0.5 / (1 - fit_y.mean()), 0.5 / fit_y.mean()])

    def step(spans: np.ndarray) -> None:
        nonlocal soft, bias
        length = end[spans] - first[spans]
        of_span = np.repeat(np.arange(len(spans)), length)
        at = np.arange(len(of_span)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[spans], length)
        distinct, inverse = np.unique(codes[at], return_inverse=True)
        n = per_word[distinct]
        begin = np.cumsum(n) - n
        grams = bucket[np.arange(n.sum()) + np.repeat(word_start[distinct] - begin, n)]
        vectors = np.add.reduceat(embed[grams], begin, axis=0) / n[:, None]
        bag = np.bincount(of_span * len(distinct) + inverse, weights=1.0 / length[of_span], minlength=len(spans) * len(distinct)).reshape(len(spans), -1)
        hidden = bag @ vectors
        logits = hidden @ soft + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        label = fit_y[text[spans]]
        p[np.arange(len(spans)), label] -= 1
        g = p * balance[label][:, None]
        g_soft, g_bias = hidden.T @ g, g.sum(axis=0)
        g_words = bag.T @ (g @ soft.T) / n[:, None]
        g_embed = np.stack([np.bincount(grams, weights=np.repeat(g_words[:, d], n), minlength=size) for d in range(DIM)], axis=1)
        embed_sum[:] += (g_embed**2).mean(axis=1)
        soft_sum[:] += g_soft**2
        bias_sum[:] += g_bias**2
        embed[:] -= RATE * g_embed / np.sqrt(embed_sum)[:, None]
        soft = soft - RATE * g_soft / np.sqrt(soft_sum)
        bias = bias - RATE * g_bias / np.sqrt(bias_sum)

    for epoch in range(EPOCHS):
        if epoch < WARM:
            chosen = rng.permutation(len(first))[: 4 * len(fit_y)]
        else:
            weights = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
            score = np.add.reduceat(weights[bucket], word_start) / per_word
            total = np.concatenate([[0.0], np.cumsum(score[codes])])
            value = (total[end] - total[first]) / (end - first)
            worst = np.lexsort((value, text))[np.flatnonzero(np.diff(text, append=-1))]
            other = rng.permutation(len(first))[: 2 * len(worst)]
            other = other[fit_y[text[other]] == 0][: len(worst) // 2]
            chosen = rng.permutation(np.concatenate([worst, other]))
        for k in range(0, len(chosen), BATCH):
            step(chosen[k : k + BATCH])
    model = ToxicityModel(embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))
    model.slope, model.offset = fit_line(model.worst(texts.filter(pa.array(~fit)))[0], y[~fit], max(share, LEAST_SHARE))
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, **columns) -> ToxicityModel:
    model = ToxicityModel.__new__(ToxicityModel)
    vars(model).update(fit_on_sample(docs, labels, "toxic", usable, per_class, train, **columns))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the probability that the text is toxic, over its whole length.

    Null, empty and white texts get the score of no words.  Repeated rows and
    null ids are scored row by row; extra columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.probability(text_array(part)), pa.float64())], names=["doc_id", "score"])
        give_back()

    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more, all columns kept."""
    from pyspark.sql.types import BooleanType

    @F.arrow_udf(BooleanType())
    def clean(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.array(np.concatenate([model.probability(text_array(part)) < limit for part in text_slices(batch)] or [np.zeros(0, dtype=bool)]))

    return docs.where(clean(F.col(text_col)))
