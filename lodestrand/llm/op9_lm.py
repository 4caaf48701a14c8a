"""Language-model scores by deleted interpolation.

Maximum-likelihood n-gram estimates of orders 1 to ``order`` are mixed, with weights that depend
on how often the context was seen (bins of powers of two). The weights come from expectation
maximisation on held-out counts in the deleted sense: every training token in turn is taken out
of the counts it contributed to. Unigrams are smoothed, so no token has probability 0:
(c + 0.1) / (N + 0.1 * (V + 1)).

All n-grams of the corpus are counted, through ``exchange``: a chunk asks for its distinct n-grams
with its own training counts and learns the global ones. What goes to the driver is a histogram of
fixed size for the weights.

Defined results: null or empty text is the end token alone; a null doc_id trains and is not held
out; without any training text every token has the probability that the smoothing gives, 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .storage import Scratch
from .text import U, grams, mix, word_hashes, words

END = U(0x5DEECE66D1234567)
SMOOTH = 0.1
STEP, LOW, HIGH = 0.25, -16.0, 48.0  # bins of log2(estimate / unigram estimate)
BINS = int((HIGH - LOW) / STEP) + 2  # bin 0: the estimate is 0


class Tokens:
    """Tokens of one chunk: its words, then one end for each document."""

    def __init__(self, table: pa.Table, order: int, text: str):
        table = table.combine_chunks()
        w = words(table.column(text).combine_chunks(), lower=True)
        self.order = order
        self.train_doc = np.asarray(table.column("train"))
        docs, pad = len(w.first) - 1, order - 1
        self.n = w.count + 1
        # each document: pad ends as context, its words, one end
        size = self.n + pad
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.full(int(size.sum()), END)
        doc = w.doc
        flat[begin[doc] + pad + np.arange(len(doc)) - w.first[:-1][doc]] = word_hashes(w)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(docs), self.n)
        at = np.arange(len(self.doc)) - self.first[:-1][self.doc]
        self.place = begin[self.doc] + pad + at
        self.at_start = at
        self.flat = flat
        self.train = self.train_doc[self.doc]
        self.index, self.keys = {}, {}
        for m in range(1, order + 1):
            h = mix(grams(flat, m) + U(m))
            self.keys[m], self.index[m] = np.unique(h[self.place - m + 1], return_inverse=True)

    def requests(self, chunk: int, buckets: int) -> list[tuple]:
        out = []
        for m in range(1, self.order + 1):
            count = np.bincount(self.index[m], weights=self.train, minlength=len(self.keys[m])).astype(np.int64)
            out += X.request_rows(chunk, m, self.keys[m], [count], buckets)
        return out

    def counts(self, got: pa.Table) -> tuple[dict, dict]:
        """Of each token: the count of its m-gram, and of the m-gram's context."""
        end_key = mix(np.array([END]) + U(1))[0]
        known = {m: X.answers_of(got, m) for m in self.keys}
        count = {m: known[m][self.index[m]] for m in self.keys}
        ends = known[1][np.searchsorted(self.keys[1], end_key)] if len(self.keys[1]) else 0
        context = {}
        for m in range(2, self.order + 1):
            before = np.concatenate([[0], count[m - 1][:-1]])
            # a context of padding alone was seen once in each training document
            context[m] = np.where(self.at_start == 0, ends, before)
        return count, context


def bucket_of(context: dict, order: int) -> np.ndarray:
    """The longest context that was seen, and the power of two of its count."""
    out = np.zeros(len(next(iter(context.values()))) if context else 0, np.int64)
    for m in range(2, order + 1):
        c = context[m]
        out = np.where(c > 0, m * 64 + np.log2(np.maximum(c, 1)).astype(np.int64), out)
    return out


def estimates(count: dict, context: dict, order: int, n: int, v: int, less: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Smoothed unigrams and the ratio of each higher order; less: occurrences taken out."""
    base = (np.maximum(count[1] - less, 0) + SMOOTH) / (max(n - less, 0) + SMOOTH * (v + 1))
    return base, [np.where(context[m] > less, np.maximum(count[m] - less, 0) / np.maximum(context[m] - less, 1), 0.0) for m in range(2, order + 1)]


def merge(kind: int, keys: np.ndarray, group: np.ndarray, vals: list[np.ndarray]):
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, group, vals[0])
    return total, [int(total.sum()), int((total > 0).sum())]


def learn_weights(cells: list[tuple[int, int, float]], order: int, rounds: int = 60) -> dict[int, np.ndarray]:
    """EM: cells are (bucket, code, tokens); the weights of orders 2.. and, last, of unigrams."""
    by: dict[int, list[tuple[int, float]]] = {}
    for bucket, code, n in cells:
        by.setdefault(bucket, []).append((code, n))
    weights = {}
    for bucket, rows in by.items():
        codes, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        ratio = []
        for _ in range(order - 1):
            at, codes = codes % BINS, codes // BINS
            ratio.append(np.where(at == 0, 0.0, 2.0 ** (LOW + (at - 0.5) * STEP)))
        r = np.stack([*ratio, np.ones(len(n))])
        w = np.full(order, 1 / order)
        for _ in range(rounds):
            share = w[:, None] * r
            w = (share / share.sum(0) * n).sum(1) / n.sum()
        # a floor keeps every token possible whatever the held-out counts say
        w = np.maximum(w, 1e-6)
        weights[int(bucket)] = w / w.sum()
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
CELLS = "bucket long, code long, n double"


def score(spark: SparkSession, docs: DataFrame, order: int = 2, text: str = "text", doc_id: str = "doc_id", held_out=None) -> DataFrame:
    """Scores of all ``docs``. held_out: a condition on the rows not to learn from; the rest trains.

    Columns: the id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams alone) and
    score, the log10 probability of the whole text.
    """
    scratch = Scratch(spark, "lm")
    if held_out is None:
        held_out = F.crc32(F.col(doc_id).cast("string")) % 10 == 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    chunks = X.write_chunks(rows, scratch)
    buckets = X.buckets_for(chunks, 0.4 * order)

    def ask(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk_id").to_pylist(), b.column("payload"), strict=True):
                yield X.to_batch(Tokens(X.unpack(payload.as_py()), order, "text").requests(chunk, buckets), X.REQUESTS)

    known = scratch.write(X.answer(chunks.select("chunk_id", "payload").mapInArrow(ask, X.REQUESTS), merge, 1), "counts")
    scratch.release(2)
    totals = [np.frombuffer(r[0], np.int64) for r in known.filter("chunk_id = -2").select("answer").collect()]
    n, v = (int(sum(t[i] for t in totals)) for i in (0, 1))
    # both passes below read chunks and answers side by side, so that those are moved once
    side = scratch.write(X.answered(chunks, known), "answered")
    scratch.drop(chunks)
    scratch.drop(known)
    scratch.release(2)

    def cells(chunk, table, got):
        t = Tokens(table, order, "text")
        count, context = t.counts(got)
        base, higher = estimates(count, context, order, n, v, 1)
        code = np.zeros(len(base), np.int64)
        for p in reversed(higher):
            at = np.clip(((np.log2(np.maximum(p / base, 1e-300)) - LOW) / STEP).astype(np.int64) + 1, 1, BINS - 1)
            code = code * BINS + np.where(p > 0, at, 0)
        bucket = bucket_of({m: np.maximum(c - 1, 0) for m, c in context.items()}, order)
        if order == 1:
            bucket = np.zeros(len(base), np.int64)
        found, size = np.unique((bucket * BINS ** (order - 1) + code)[t.train], return_counts=True)
        bucket, code = np.divmod(found, BINS ** (order - 1))
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(code, pa.int64()), pa.array(size, pa.float64())], names=["bucket", "code", "n"])

    seen = X.over_answered(side, cells, CELLS).groupBy("bucket", "code").agg(F.sum("n").alias("n"))
    weights = learn_weights([tuple(r) for r in seen.collect()], order)
    scratch.release()

    def finish(chunk, table, got):
        t = Tokens(table, order, "text")
        count, context = t.counts(got)
        base, higher = estimates(count, context, order, n, v, 0)
        bucket = bucket_of(context, order) if order > 1 else np.zeros(len(base), np.int64)
        kinds, where = np.unique(bucket, return_inverse=True)
        table_of = np.array([weights.get(int(k), np.r_[np.zeros(order - 1), 1.0]) for k in kinds]).reshape(len(kinds), order)
        p = table_of[where, -1] * base + sum(table_of[where, i] * h for i, h in enumerate(higher))
        total = lambda x: np.add.reduceat(x, t.first[:-1]) if len(t.n) else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks(), pa.array(~t.train_doc), pa.array(t.n, pa.int64()), pa.array(total((count[1] > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(t.n), n), pa.int64()), pa.array(total(np.log10(base)), pa.float64()), pa.array(total(np.log10(p)), pa.float64())],
            names=[x.split()[0] for x in SCORES.split(", ")],
        )

    return X.over_answered(side, finish, SCORES)
