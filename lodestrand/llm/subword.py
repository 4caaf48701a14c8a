"""Averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its byte n-grams (2 to 4 bytes, white space as one kind of byte, letters'
case kept), its whole words and, if asked for, its pairs of words, hashed to ``BUCKETS`` embedding
rows. Its vector is the mean of those rows, the class scores a linear map of the vector. Training sees a bounded sample of
labelled rows (``sample`` rows in all, dealt evenly over the classes, chosen by a hash of the id);
a fifth of the sample is set aside to calibrate the scores. Scoring folds embeddings and softmax
weights into one table of BUCKETS x classes, so it needs one look-up a feature over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import expand, squeeze, to_batch
from .text import U, pair, pieces, raw, tidied, word_hashes, words

BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
SAMPLE = 2400
SLICE = 1 << 20  # bytes of text that are worked on at once


def bucket_runs(texts: pa.Array, pairs: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the buckets in text order, and where each text's begin (len + 1)."""
    data, offsets = raw(texts)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where(blank, np.uint8(32), data).astype(np.uint32)
    size = np.diff(offsets)
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        if not count.sum():
            continue
        first = np.concatenate([[0], np.cumsum(count)])
        key = data[: len(data) - n + 1].copy()
        for i in range(1, n):
            key |= data[i : len(data) - n + 1 + i] << np.uint32(8 * i)
        inside = np.ones(len(key), bool)
        for i in range(1, n):  # the last bytes of a text begin no n-gram of it
            at = offsets[1:] - i
            at = at[(size >= i) & (at < len(key))]
            inside[at] = False
        key = key[inside].astype(U)
        yield ((key + U(n << 40)) * U(0x9E3779B97F4A7C15) >> U(64 - 17)).astype(np.int32), first
    w = words(texts)
    h = word_hashes(w, 3)
    yield (h >> U(64 - 17)).astype(np.int32), w.first
    if pairs and len(h) > 1:
        inside = np.ones(len(h) - 1, bool)
        last = w.first[1:][w.count > 0] - 1  # a text's last word begins no pair of it
        inside[last[last < len(inside)]] = False
        yield (pair(h[:-1], h[1:])[inside] >> U(64 - 17)).astype(np.int32), np.concatenate([[0], np.cumsum(np.maximum(w.count - 1, 0))])


def row_sums(values: np.ndarray, first: np.ndarray, into: np.ndarray) -> None:
    """Add to ``into`` the sums of the rows first[i]:first[i+1]."""
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        into[full] += np.add.reduceat(values, first[full], axis=0, dtype=np.float64)


@dataclass
class Model:
    classes: list
    table: np.ndarray  # BUCKETS x classes: embedding times softmax weights
    bias: np.ndarray
    scale: np.ndarray  # calibration: scores are softmax(scale * logits + shift)
    shift: np.ndarray
    pairs: bool = False  # whether pairs of words are features

    def logits(self, texts: pa.Array) -> np.ndarray:
        total, count = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for bucket, first in bucket_runs(texts, self.pairs):
            row_sums(self.table[bucket], first, total)
            count += np.diff(first)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.logits(texts) * self.scale + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if x.size else x
    return e / e.sum(axis=1, keepdims=True) if x.size else x


FEATURES = "label string, pick long, buckets binary, counts binary"


def marked(counts: dict[str, int], sample: int) -> Column:
    """Whether a row's (id, label) is below its label's mark."""
    each = max(1, sample // max(len(counts), 1))
    pick, mark = F.xxhash64("id"), F.lit(False)
    for label, n in counts.items():
        share = min(1.0, (each + 4 * each**0.5 + 8) / n)
        mark = F.when(F.col("label") == label, pick <= int(-(2**63) + share * (2**64 - 2**11))).otherwise(mark)
    return mark


def labelled_sample(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """About sample / classes rows (label, pick, text) a label, and at least that many where there
    are, but for a chance of one in ten thousand: those whose ``pick``, a hash of the id, is below a
    mark that the label's number of rows gives. Of rows that repeat id and label one stays. Nothing
    is sorted or dealt by label, so a label of most rows is no hot key."""
    chosen = rows.filter(marked(counts, sample)).select("label", F.xxhash64("id").alias("pick"), "text")
    return chosen.groupBy("label", "pick").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))


def features(rows: DataFrame, pairs: bool = False) -> DataFrame:
    """Each row's distinct buckets, as differences, and how often each occurs; both squeezed."""

    def make(batches):
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                runs = list(bucket_runs(part.column("text"), pairs))
                out = []
                for i, (label, pick) in enumerate(zip(part.column("label").to_pylist(), part.column("pick").to_pylist(), strict=True)):
                    found, n = np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in runs]), return_counts=True)
                    out.append((label, pick, squeeze(np.diff(found.astype(np.int32), prepend=np.int32(0))), squeeze(n.astype(np.uint32))))
                yield to_batch(out, FEATURES)

    return rows.mapInArrow(make, FEATURES)


def train(rows: list, classes: list[str], prior: np.ndarray, width: int = 12, epochs: int = 12, rate: float = 4.0, seed: int = 7, pairs: bool = False) -> Model:
    """SGD over documents in shuffled order with a falling rate, then calibration on the rest."""
    rng = np.random.default_rng(seed)
    k = len(classes)
    y = np.array([classes.index(r[0]) for r in rows])
    docs = []
    for r in rows:
        n = np.frombuffer(r[3], np.float32)
        docs.append((np.frombuffer(r[2], np.int32), n / max(n.sum(), 1)))
    aside = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~aside)
    embedding = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    weights, bias = np.zeros((width, k), np.float32), np.zeros(k, np.float32)
    weights += rng.normal(0, 0.3, weights.shape)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for d in rng.permutation(learn):
            at, share = docs[d]
            if not len(at):
                continue
            x = share @ embedding[at]
            p = softmax((x @ weights + bias)[None])[0]
            p[y[d]] -= 1
            now = rate * (1 - done / steps)
            back = weights @ p
            weights -= 0.05 * now * np.outer(x, p)
            bias -= 0.005 * now * p
            # a mean over n features passes 1/n of the gradient to each; the rate makes up for that
            embedding[at] -= (now * len(at) ** 0.5) * share[:, None] * back[None, :]
            done += 1
    table = (embedding @ weights).astype(np.float32)
    z = np.array([np.r_[d[1] @ table[d[0]]] if len(d[0]) else np.zeros(k) for d in docs]).reshape(len(docs), k) + bias
    scale, shift = calibrate(z[aside], y[aside], prior) if aside.any() else (np.float64(1.0), np.zeros(k))
    return Model(classes, table, bias.astype(np.float64), scale, shift, pairs)


def calibrate(z: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 300) -> tuple[np.float64, np.ndarray]:
    """One scale and a shift a class, by gradient descent on the rows set aside, each class weighted to its share."""
    k = z.shape[1]
    share = np.bincount(y, minlength=k) / max(len(y), 1)
    weight = (prior / np.maximum(share, 1e-9))[y]
    weight /= weight.sum()
    spread = max(float(np.std(z)), 1e-6)
    z, scale, shift = z / spread, 1.0, np.zeros(k)
    for _ in range(rounds):
        p = softmax(z * scale + shift)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        scale = np.clip(scale - 1.0 * (p * z).sum(), 0.1, 50.0)
        shift = shift - 1.0 * p.sum(0)
    return np.float64(scale / spread), shift - shift.mean()


def fit(rows: DataFrame, sample: int = SAMPLE, counts: dict[str, int] | None = None, pairs: bool = False, **settings) -> tuple[Model, list]:
    """Learn from rows (id, label, text), label a non-null string; the model and the sample's features.
    counts: rows of each label, where ``rows`` hold only those chosen."""
    if counts is None:
        counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    classes = sorted(counts)
    if not classes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.float64(1), np.zeros(0)), []
    prior = np.array([counts[c] for c in classes], float)
    each = max(1, sample // len(classes))
    found = sorted((tuple(r) for r in features(labelled_sample(rows, counts, sample), pairs).collect()), key=lambda r: (r[1], r[0]))
    got, taken = [], dict.fromkeys(classes, 0)
    for r in found:  # the least picks of each label, as many as the bound says
        if taken[r[0]] < each:
            taken[r[0]] += 1
            got.append((*r[:2], np.cumsum(expand(r[2], np.int32), dtype=np.int32).tobytes(), expand(r[3], np.uint32).astype(np.float32).tobytes()))
    return train(got, classes, prior / prior.sum(), pairs=pairs, **settings), got


def predict(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """docs: the columns ``carry`` and text; adds best string, chance double and first double
    (the chance of the first class)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "best string, chance double, last double"])

    def score(batches):
        m = shared.value
        names = pa.array([*m.classes, None], pa.string())
        for batch in batches:
            for part in pieces(batch, "text", SLICE):
                if m.classes:
                    p = m.probabilities(part.column("text"))
                    best = p.argmax(axis=1)
                    chance, last = p.max(axis=1), p[:, -1]
                else:
                    best, chance, last = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), names.take(pa.array(best)), pa.array(chance), pa.array(last)], names=[*carry, "best", "chance", "last"])

    return docs.select(*carry, "text").mapInArrow(tidied(score), schema)
