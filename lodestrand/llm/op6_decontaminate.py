"""Benchmark decontamination by edit distance, through CGK embeddings and bit-sampling LSH.

An item leaks into a document when some stretch of the document's words is within
floor((1 - similarity) * L) word edits of the item's L words (A-Z lower-cased, split at white
space). Items of more than ``LONGEST`` words are compared whole, and besides are several passages
of that size, each of which can leak alone; the whole item has the number behind its passages'.

* *Where to look*: with t edits among L words, some run of ceil((L - t) / (t + 1)) words of the
  passage is intact. Item-sized windows are laid wherever a document holds such a run of a passage,
  on its diagonal; no other place can hold a leak, so nothing is lost.
* *CGK*: a random walk over a window repeats each word or moves on, by random bits of the word and
  the step that all windows share. Two windows at a small edit distance walk alike again soon after
  an edit, so edit distance becomes Hamming distance of the walks.
* *LSH*: a table samples ``POSITIONS`` places of a walk; a window is a candidate where any of
  ``TABLES`` samples of ``WALKS`` walks equals the passage's.
* *Verification*: the exact edit distance, with free ends around the window, decides.
* *Whole long items* skip the walks, which drift apart over many edits: windows that begin within t
  words of each other are laid as one, and those that hold L - t of the item's words are verified.

The benchmark goes to the workers in blocks of at most ``ITEM_BYTES``; documents are never joined.

Defined results: null and empty texts and items match nothing; items of fewer than ``SHORTEST``
words are ignored, since they are no passage; equal items are reported each; rows that repeat an
id are reported each; whole texts are searched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import to_batch
from .storage import Scratch
from .text import U, grams, mix, pieces, tidied, word_hashes, words

SHORTEST, LONGEST = 5, 64
WALKS, TABLES, POSITIONS = 6, 16, 2
ITEM_BYTES = 16 << 20
PAIRS = 1 << 22  # places where a document and the passages share a run, looked at at once
CELLS = 1 << 18  # words of windows of whole items, verified at once
PAD = U(0xFFFFFFFFFFFFFFFF)


def edits(length: int, similarity: float) -> int:
    return math.floor((1 - similarity) * length + 1e-9)


class Passages:
    """The benchmark's passages, with what documents are compared to."""

    def __init__(self, items: list[tuple], similarity: float):
        self.rows = []  # (item id, number of the passage, word hashes)
        texts = pa.array([t for _, t in items], pa.string())
        w = words(texts, lower=True)
        h = word_hashes(w)
        for (item, _), a, b in zip(items, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a < SHORTEST:
                continue
            if b - a <= LONGEST:
                starts, size = [a], b - a
            else:  # whole passages; the last one ends with the item
                starts, size = sorted({*range(a, b - LONGEST + 1, LONGEST), b - LONGEST}), LONGEST
            self.rows += [(item, i, h[s : s + size]) for i, s in enumerate(starts)]
            if b - a > LONGEST:
                self.rows.append((item, len(starts), h[a:b]))
        self.size = np.array([len(r[2]) for r in self.rows], np.int64)
        self.most = np.array([edits(int(n), similarity) for n in self.size], np.int64)
        self.run = -(-(self.size - self.most) // (self.most + 1))
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.flat = np.concatenate([r[2] for r in self.rows]) if self.rows else np.zeros(0, U)
        self.seeds = {}
        for q in np.unique(self.run).tolist():
            of = [(g, p, o) for p in np.flatnonzero(self.run == q) for o, g in enumerate(grams(self.rows[p][2], q))]
            of.sort()
            keys = np.array([x[0] for x in of], U)
            self.seeds[q] = keys, np.array([x[1] for x in of], np.int64), np.array([x[2] for x in of], np.int64)
        self.whole = self.size > LONGEST
        # of a whole long item, windows that begin in the same stretch of so many words are one
        self.stretch = np.where(self.whole, np.maximum(self.most, 1), 1)
        short = ~self.whole
        self.sketch = np.zeros((len(self.rows), WALKS * TABLES), U)
        self.sketch[short] = self.tables(self.flat, self.first[:-1][short], self.size[short])

    def tables(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """LSH keys of windows flat[start:start+size]: a column each of WALKS * TABLES."""
        n = len(start)
        out = np.zeros((n, WALKS * TABLES), U)
        padded = np.append(flat, PAD)
        longest = int(size.max()) if n else 0
        for walk in range(WALKS):
            at = np.zeros(n, np.int64)
            path = np.zeros((n, 2 * longest), U)
            for step in range(2 * longest):
                word = padded[np.where(at < size, np.minimum(start + at, len(flat)), len(flat))]
                path[:, step] = word
                at += (mix(word + U(walk << 20 | step)) >> U(63)).astype(np.int64)
            pick = np.random.default_rng(1000 + walk)
            for table in range(TABLES):
                key = np.full(n, table, U)
                for share in pick.random(POSITIONS):
                    # the same place of a window and of a passage of the same length
                    key = mix(key * U(31) + path[np.arange(n), (share * 2 * size).astype(np.int64)])
                out[:, walk * TABLES + table] = key
        return out

    def windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, word where the window begins), each once."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for q, (keys, passage, offset) in self.seeds.items():
            g = grams(h, q)
            lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            at = np.flatnonzero(hi > lo)
            at = at[doc[at] == doc[at + q - 1]]
            block = np.cumsum((hi - lo)[at]) // PAIRS
            for at in np.split(at, np.flatnonzero(np.diff(block)) + 1):
                many = (hi - lo)[at]
                ends = np.cumsum(many)
                pick = np.repeat(lo[at] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)
                d, p = np.repeat(doc[at], many), passage[pick]
                start = np.repeat(at, many) - offset[pick] - first[d]
                found.append(np.unique(np.stack([d, p, first[d] + start // self.stretch[p] * self.stretch[p]]), axis=1))
        every = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
        return every[0], every[1], every[2]

    def leaks(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, passage, first word, word behind the last, edits), the best of each document and passage."""
        if not len(self.rows) or not len(h):
            return []
        doc, passage, start = self.windows(h, first)
        best: dict[tuple[int, int], tuple] = {}
        long = self.whole[passage]
        for n in np.unique(self.size[passage[long]]).tolist():
            of = np.flatnonzero(self.size[passage] == n)
            each = max(1, CELLS // (2 * n))
            for part in range(0, len(of), each):
                d, p, s = (x[of[part : part + each]] for x in (doc, passage, start))
                held = np.flatnonzero([self.holds(h, first, *x) for x in zip(d, p, s, strict=True)])
                d, p, s = d[held], p[held], s[held]
                for i, hit in enumerate(self.verify(h, first, d, p, s, n)):
                    if hit is not None and hit < best.get((d[i], p[i]), (1 << 30,)):
                        best[d[i], p[i]] = hit
        doc, passage, start = doc[~long], passage[~long], start[~long]
        for part in range(0, len(doc), 4096):
            d, p, s = (x[part : part + 4096] for x in (doc, passage, start))
            begin = np.maximum(s, first[d])
            size = np.minimum(np.minimum(s + self.size[p], first[d + 1]) - begin, self.size[p])
            # a window that would leave its document keeps its place but is padded
            flat, at = padded_windows(h, begin, size, self.size[p])
            near = (self.tables(flat, at, self.size[p]) == self.sketch[p]).any(axis=1)
            d, p, s = d[near], p[near], s[near]
            for n in np.unique(self.size[p]).tolist():
                own = np.flatnonzero(self.size[p] == n)
                for i, hit in zip(own.tolist(), self.verify(h, first, d[own], p[own], s[own], n), strict=True):
                    if hit is not None and hit < best.get((d[i], p[i]), (1 << 30,)):
                        best[d[i], p[i]] = hit
        return [(int(d), int(p), begin, end, cost) for (d, p), (cost, begin, end) in sorted(best.items())]

    def holds(self, h: np.ndarray, first: np.ndarray, d: int, p: int, s: int) -> bool:
        """Whether the text around a window has as many of the passage's words as a leak leaves intact."""
        text = h[max(s - self.most[p], first[d]) : min(s + self.stretch[p] + self.size[p] + self.most[p], first[d + 1])]
        return np.isin(self.rows[p][2], text).sum() >= self.size[p] - self.most[p]

    def verify(self, h: np.ndarray, first: np.ndarray, d: np.ndarray, p: np.ndarray, s: np.ndarray, n: int) -> list[tuple[int, int, int] | None]:
        """Exact edit distances of passages of n words to the text around their windows."""
        if not len(d):
            return []
        slack = int(self.most[p].max())
        low = s - slack
        at = low[:, None] + np.arange(n + 2 * slack + int(self.stretch[p].max()) - 1)
        inside = (at >= first[d][:, None]) & (at < first[d + 1][:, None])
        text = np.where(inside, h[np.clip(at, 0, len(h) - 1)], PAD)
        item = self.flat[self.first[p][:, None] + np.arange(n)]
        cost, end = alignment(item, text)
        back, length = alignment(item[:, ::-1], np.stack([np.roll(t[::-1], -(len(t) - e)) for t, e in zip(text, end, strict=True)]))
        return [(int(c), int(lo + e - m), int(lo + e)) if c <= most else None for c, e, m, lo, most in zip(cost, end, length, low, self.most[p], strict=True)]


def padded_windows(h: np.ndarray, begin: np.ndarray, size: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows copied one behind the other, filled up with PAD to their full size."""
    at = np.concatenate([[0], np.cumsum(full)])
    flat = np.full(int(at[-1]), PAD)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at[:-1], size) + inside] = h[np.repeat(begin, size) + inside]
    return flat, at[:-1]


def alignment(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of items against rows of texts, free ends in the text: least edits, and the end of the
    first stretch that has them."""
    width = text.shape[1] + 1
    step = np.arange(width)
    row = np.zeros((len(item), width), np.int64)
    for i in range(item.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (text != item[:, i : i + 1]))
        row = np.minimum.accumulate(new - step, axis=1) + step
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def blocks(items: DataFrame, text: str, item_id: str) -> list[list[tuple]]:
    """The benchmark in blocks of bounded size."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(size / ITEM_BYTES))
    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[tuple(r) for r in rows.filter(part == i).orderBy("item", "text").collect()] for i in range(n)]


LEAKS = "doc_id long, item_id long, passage int, start_word long, end_word long, distance int, item_words int"


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row for each document and passage that leaks into it; word positions count from 0."""
    Scratch(spark, "leaks")
    out = None
    for block in blocks(items, text, item_id):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            passages = Passages(shared.value, similarity)
            for batch in batches:
                for part in pieces(batch, "text"):
                    w = words(part.column("text"), lower=True)
                    ids = part.column("doc_id").to_pylist()
                    yield to_batch([(ids[d], passages.rows[p][0], passages.rows[p][1], int(a - w.first[d]), int(b - w.first[d]), cost, int(passages.size[p])) for d, p, a, b, cost in passages.leaks(word_hashes(w), w.first)], LEAKS)

        found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), LEAKS)
        out = found if out is None else out.union(found)
    return out


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, similarity: float = 0.8, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` into which no passage leaks, as they are, with all their columns."""
    Scratch(spark, "leaks")
    for block in blocks(items, text, item_id):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            passages = Passages(shared.value, similarity)
            for batch in batches:
                for part in pieces(batch, text):
                    w = words(part.column(text), lower=True)
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in passages.leaks(word_hashes(w), w.first)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
