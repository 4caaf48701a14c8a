"""Packing of token sequences with non-negative least squares.

A document's ids are cut into whole windows and a tail. How tails share windows is decided on the
histogram of tail lengths, which has window - 1 entries whatever the corpus: all combinations of
two or three lengths that fill a window exactly are enumerated, non-negative least squares gives
how often to repeat each, the counts are rounded down, and what is left is packed greedily: the
longest tail, then the longest that still fit, then a piece cut off another tail to close the gap.
So no sequence has padding but, at most, the last one.

A tail is known by its length and its rank among tails of that length; ranks come from counts in
each part of the staged table and those counts' running sums. The plan names ranges of ranks, and
its size depends on the window alone, so it may be broadcast.

Defined results: null and empty texts are the end id alone; rows that repeat an id are documents
of their own; an empty table gives an empty result; a text of any length is cut into windows.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as T
from .exchange import expand, squeeze, to_batch
from .storage import Scratch
from .text import pieces, tidy

WINDOW = 1024


def combinations(window: int) -> np.ndarray:
    """All a <= b <= c with a + b + c = window; a is 0 in pairs."""
    rows = []
    for a in range(window // 3 + 1):
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        rows.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradient.

    A has one column a combination, with 1 at each of its lengths; it is applied, never stored."""
    target = histogram.astype(float).copy()
    target[0] = 0

    def apply(x):
        out = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=len(target))
        out[0] = 0
        return out

    back = lambda r: r[combos].sum(axis=1)
    x = v = np.full(len(combos), 1 / max(len(combos), 1))
    for _ in range(30):  # largest eigenvalue of A'A by power iteration
        v = back(apply(v))
        size = np.linalg.norm(v)
        v = v / max(size, 1e-12)
    step = 1 / max(size * 1.05, 1e-12)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(apply(y) - target), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


class Ranks:
    """Tails of one length that are still to pack: runs (tail, first rank, count, offset in the tail)."""

    def __init__(self):
        self.left: dict[int, deque] = defaultdict(deque)
        self.count: dict[int, int] = defaultdict(int)

    def add(self, length: int, run: tuple[int, int, int, int]) -> None:
        if run[2] > 0:
            self.left[length].append(run)
            self.count[length] += run[2]

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.count[length] -= n
        while n:
            tail, rank, have, offset = self.left[length].popleft()
            use = min(n, have)
            out.append((tail, rank, use, offset))
            if have > use:
                self.left[length].appendleft((tail, rank + use, have - use, offset))
            n -= use
        return out


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Rows (tail, from rank, count, offset in the tail, length, first sequence, offset there) and
    the number of sequences; histogram[i]: tails of length i."""
    ranks = Ranks()
    for length in range(1, window):
        ranks.add(length, (length, 0, int(histogram[length]), 0))
    rows, sequences = [], 0

    def place(length: int, used: int, n: int, at: int, first: int, keep: bool = False) -> None:
        """n pieces of ``used`` ids off tails of ``length``, at ``at`` of n sequences."""
        for tail, rank, count, offset in ranks.take(length, n):
            rows.append((tail, rank, count, offset, used, first, at))
            if keep:
                ranks.add(length - used, (tail, rank, count, offset + used))
            first += count

    combos = combinations(window)
    repeats = np.floor(least_squares(combos, histogram) + 1e-6).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        n = int(repeats[i])
        if n <= 0:
            break
        lengths = [int(x) for x in combos[i] if x]
        need = {x: lengths.count(x) for x in lengths}
        n = min(n, *(ranks.count[x] // c for x, c in need.items()))
        at = 0
        for x in lengths if n > 0 else []:
            place(x, x, n, at, sequences)
            at += x
        sequences += max(n, 0)

    present = sorted((x for x, c in ranks.count.items() if c), reverse=True)
    while present:
        used: dict[int, int] = defaultdict(int)
        lengths, gap = [], window
        for x in present:  # the longest first, each as often as it fits
            n = min(gap // x, ranks.count[x] - used[x])
            lengths += [x] * n
            used[x] += n
            gap -= x * n
        cut = next((x for x in present if x > gap and used[x] < ranks.count[x]), 0) if gap else 0
        if cut:
            used[cut] += 1
        n = min(ranks.count[x] // c for x, c in used.items() if c)
        at = 0
        for x in lengths:
            place(x, x, n, at, sequences)
            at += x
        if cut:
            place(cut, gap, n, at, sequences, keep=True)
        sequences += n
        present = sorted((x for x, c in ranks.count.items() if c), reverse=True)
    return np.array(rows, np.int64).reshape(-1, 7), sequences


STAGED = "part long, doc_id long, n_tokens long, tail int, rank long, windows_before long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def staged(docs: DataFrame, path: str, end: int, window: int, text: str, doc_id: str) -> DataFrame:
    """A document's ids, its tail and, within its part of the table, the tail's rank and the windows before."""

    def run(batches):
        encoder = T.encoder(path)
        part = TaskContext.get().partitionId()
        seen, before = np.zeros(window, np.int64), 0
        for batch in batches:
            for piece in pieces(batch, "text", T.SLICE):
                ids, first = T.with_end(*encoder.encode(piece.column("text")), end)
                ids = ids.astype(np.uint32)
                rows = []
                for i, a, b in zip(piece.column("doc_id").to_pylist(), first[:-1], first[1:], strict=True):
                    tail = int(b - a) % window
                    rows.append((part, i, int(b - a), tail, int(seen[tail]), before, squeeze(ids[a:b])))
                    seen[tail] += 1
                    before += int(b - a) // window
                yield to_batch(rows, STAGED)
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STAGED)


def pack(spark: SparkSession, docs: DataFrame, path: str, end: int = 0, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, start (ids before it in its document), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset (its place in that sequence)."""
    scratch = Scratch(spark, "packing")
    kept = scratch.write(staged(docs, path, end, window, text, doc_id), "ids")
    histogram = np.zeros(window, np.int64)
    for r in kept.groupBy("tail").count().collect():
        histogram[r[0]] = r[1]
    rows, sequences = plan(histogram, window)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    shared = spark.sparkContext.broadcast(rows[order])

    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tails = kept.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"n_tokens div {window}")).alias("windows"))
    rank_base = tails.select("part", "tail", before(Window.partitionBy("tail").orderBy("part"), "n").alias("rank_base"))
    parts = tails.groupBy("part").agg(F.sum("windows").alias("windows"))
    window_base = parts.select("part", before(Window.orderBy("part"), "windows").alias("window_base"))
    based = kept.join(rank_base.join(window_base, "part"), ["part", "tail"])

    def run(batches):
        table = shared.value
        tail_at = np.searchsorted(table[:, 0], np.arange(window + 1))
        for batch in batches:
            for piece in pieces(batch, "ids", 2 << 20):
                out = []
                for i, n, tail, rank, base, whole, whole_base, data in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "n_tokens", "tail", "rank", "rank_base", "windows_before", "window_base", "ids")), strict=True):
                    ids = expand(data, np.uint32).astype("<u4")
                    first = sequences + whole_base + whole
                    for w in range(n // window):
                        out.append((i, w * window, window, ids[w * window : (w + 1) * window].tobytes(), n, first + w, 0))
                    if tail:
                        own = table[tail_at[tail] : tail_at[tail + 1]]
                        at = rank + base
                        for _, lo, count, offset, length, sequence, place in own[(own[:, 1] <= at) & (at < own[:, 1] + own[:, 2])].tolist():
                            start = n - tail + offset
                            out.append((i, start, length, ids[start : start + length].tobytes(), n, sequence + at - lo, place))
                yield to_batch(out, PIECES)

    return based.mapInArrow(run, PIECES)


def digest(spark: SparkSession, docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    return pack(spark, docs, path, end).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
