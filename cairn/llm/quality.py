"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm import textkit as tk
from cairn.llm.common import cut

#: Bytes of a passage, about; labelled documents to learn from at most, and passages of them all at most.
PASSAGE, SAMPLE, SAMPLE_PASSAGES = 600, 4000, 50_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 16, 8, 40, 128, 0.01
THRESHOLD = 0.3

# classes of bytes: small letters, capitals, digits, blanks, line ends, usual marks, other marks, bytes of other letters
KIND = np.full(256, 6, dtype=np.int32)
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A], KIND[0x80:] = 0, 1, 2, 7
KIND[[0x20, 0x09]], KIND[[0x0A, 0x0B, 0x0C, 0x0D]] = 3, 4
KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
#: Words are dealt into so many buckets by their hash.
BUCKETS = 64
FEATURES = 64 + 4 + BUCKETS


def passages(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and where each text's passages begin (and the last end).

    A passage ends before the first word that begins PASSAGE bytes or so after the passage did. Features are shares of
    pairs of neighbouring byte classes, words equal to the word before, distinct words, word length, passage length,
    and shares of words (A to Z lower-cased) by hash. An empty text has one passage of zeros.
    """
    blob = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    w, _ = tk.words(raw, tk.SPACES, True)
    begins = np.flatnonzero(np.diff(np.concatenate(([1], tk.SPACES[blob].view(np.int8)))) == -1)
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    count = np.maximum(1, np.rint(size / PASSAGE).astype(np.int64))
    step = np.maximum(1, -(-size // count))
    text = np.repeat(np.arange(len(raw)), count)
    wanted = start[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step[text]
    following = np.concatenate((begins, [len(blob)]))[np.searchsorted(begins, wanted)]
    inner = (wanted > start[text]) & (following < (start + size)[text])
    first = np.unique(np.concatenate((start, following[inner])))
    bounds = np.concatenate((np.searchsorted(first, start), [len(first)]))
    end = np.concatenate((first[1:], [0]))
    end[bounds[1:] - 1] = start + size
    length = end - first
    kind = KIND[blob]
    pair = kind[:-1] * 8 + kind[1:]
    own = np.repeat(np.arange(len(first)), length)
    inside = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
    shares = np.bincount(own * 64 + pair[np.minimum(inside, max(len(pair) - 1, 0))], minlength=64 * len(first)).reshape(-1, 64) if len(own) else np.zeros((len(first), 64))

    passage = np.searchsorted(first, begins, "right") - 1
    n = np.bincount(passage, minlength=len(first))
    same = np.zeros(len(w), dtype=bool)
    same[1:] = (w[1:] == w[:-1]) & (passage[1:] == passage[:-1])
    keys = np.sort((passage.astype(tk.U) << tk.U(40)) | (w >> tk.U(24)))
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[fresh] >> tk.U(40)).astype(np.int64), minlength=len(first))
    some = np.maximum(n, 1)
    more = np.stack((np.bincount(passage, weights=same, minlength=len(first)) / some, distinct / some, length / some / 10, np.log1p(length) / 10), axis=1)
    more[length == 0] = 0
    kinds = np.bincount(passage * BUCKETS + (w >> tk.U(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS * len(first)).reshape(-1, BUCKETS)
    return np.hstack((shares / np.maximum(length, 1)[:, None], more, kinds / some[:, None])).astype(np.float32), bounds


class Model(NamedTuple):
    """Weights; standardised features -> tanh encoding -> gated attention -> score."""

    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    eb: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        starts, n = bounds[:-1], np.diff(bounds)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.e + self.eb)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        s = (t * g) @ self.a
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
        weight = s / np.repeat(np.add.reduceat(s, starts), n)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))
        return p, x, h, t, g, weight, z

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward(x, bounds)[0]


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Learns encoder, attention and output together from document labels by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    every = np.vstack(bags)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = Model(every.mean(0), every.std(0) + 1e-3, draw(FEATURES, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION), draw(HIDDEN), np.zeros(1))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model[2:]]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            bounds = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
            p, x, h, t, g, weight, _ = model.forward(np.vstack([bags[i] for i in pick]), bounds)
            n = np.diff(bounds)
            dy = (p - labels[pick]) / len(pick)
            z = np.add.reduceat(weight[:, None] * h, bounds[:-1], axis=0)
            dz = np.repeat(dy, n)[:, None] * model.c
            ds = weight * ((h - np.repeat(z, n, axis=0)) * dz).sum(1)
            dt, dg = ds[:, None] * model.a * g * (1 - t * t), ds[:, None] * model.a * t * g * (1 - g)
            dh = (weight[:, None] * dz + dt @ model.v.T + dg @ model.u.T) * (1 - h * h)
            grads = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (ds[:, None] * t * g).sum(0), z.T @ dy, np.array([dy.sum()])]
            step += 1
            new = []
            for w, d, (m, q) in zip(model[2:], grads, moments, strict=True):
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                new.append(w * (1 - 1e-4) - RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-6))
            model = Model(model.mean, model.scale, *new)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from at most `sample` labelled documents, the first by a hash of their id, none of them held out.

    Every passage of such a document is learnt from. The sample ends where it would hold more than SAMPLE_PASSAGES; a
    first document that is longer than that is learnt from all the same. Ids with contradicting labels take no part. None
    if nothing is labelled.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def look(batches):
        for pdf in batches:
            for first, raw in tk.slices(pdf["text"]):
                x, bounds = passages(raw)
                picks = [x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                at = pdf.iloc[first : first + len(raw)]
                yield pd.DataFrame({"doc_id": at["doc_id"].array, "quality": at["quality"].array, "x": [p.tobytes() for p in picks]})

    seen = rows.mapInPandas(look, "doc_id long, quality int, x binary")
    one = cut(seen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")))  # `sample` rows at most
    row = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    at = one.select("doc_id", F.sum(F.octet_length("x") / (4 * FEATURES)).over(row).alias("n"), F.row_number().over(row).alias("k"))
    picked = at.filter((F.col("n") <= SAMPLE_PASSAGES) | (F.col("k") == 1)).select("doc_id")
    got = one.join(F.broadcast(picked), "doc_id").collect()
    if not got:
        return None
    got.sort(key=lambda r: r["doc_id"])
    return train([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in got], np.array([r["quality"] for r in got], dtype=float))


def score_column(model: Model | None, spark, text: str = "text") -> Column:
    if model is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        out = [own.score(*passages(raw)) for _, raw in tk.slices(texts)]
        return pd.Series(np.round(np.concatenate(out), 6) if out else np.zeros(0))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Every passage of the whole text is encoded; gated attention weighs the encodings, and the weighted sum is scored.
    Only the text is looked at. Null texts are scored as empty ones; repeated rows get equal scores; without labels
    every score is 0.5; a null doc_id is not held out and never learnt from; an empty table gives an empty result.
    """
    model = fit(docs, labels, sample)
    score = docs.select("doc_id", score_column(model, docs.sparkSession).alias("score"))
    return score.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    model = fit(docs, labels, sample)
    return docs.filter(score_column(model, docs.sparkSession) >= threshold)
