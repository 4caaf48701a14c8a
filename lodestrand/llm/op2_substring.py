"""Removal of repeated word spans by De Bruijn compaction.

``k`` consecutive words of a document are an edge between the nodes of their first and last
``k - 1`` words. Documents walk this graph. Four passes over chunks of documents:

1. *Seeds*: of each k-window one short n-gram is selected by its hash (winnowing), so equal
   windows select equal seeds. Seeds that two documents share mark the windows that can repeat;
   the others are certainly unique and take no further part.
2. *Nodes*: the marked windows of a document form walks. Every node learns the edges that enter
   and leave it, in all documents; an end of a walk counts as an edge of its own.
3. *Compaction*: a node with one way in and one way out is inside a nonbranching path, all others
   are cuts. Cutting all walks there leaves compacted paths, and all occurrences of an edge lie in
   occurrences of the same path. Paths are keyed and verified by 128 bits over all their words, read
   again at the source coordinates: two independent 64-bit hashes, both of which must agree.
4. *Removal*: a path also found in a document with a smaller id covers the words to remove.

Each pass answers through ``exchange``: a key costs one entry a chunk, so passages that thousands
of documents share stay small.

Defined results: null or empty text, and texts of fewer than k words, lose nothing; a row whose
doc_id is null loses nothing and makes no other row lose anything; rows that repeat a doc_id are
not "smaller" than each other, so neither loses words to the other; all input columns are kept
under their own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import exchange as X
from .storage import Scratch
from .text import U, Words, grams, mix, pair, word_hashes, words

NO_DOC = np.int64(2**63 - 1)


def seed_size(k: int) -> tuple[int, int]:
    """Words of a seed and seeds of a window."""
    size = max(1, min(k, 5 if k < 32 else 16))
    return size, k - size + 1


class Walks:
    """Windows of one chunk. A window is known by the index of its first word."""

    def __init__(self, texts: pa.Array, ids: pa.Array, k: int):
        self.k = k
        self.w: Words = words(texts)
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(int(NO_DOC)))
        self.h = word_hashes(self.w)
        self.doc = self.w.doc
        self.id = self.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        n = max(0, len(self.h) - k + 1)
        self.starts = np.flatnonzero((self.w.room()[:n] >= k) & (self.id[:n] != NO_DOC))
        self._selected()

    def _selected(self) -> None:
        """The seed that each window selects, by its position."""
        size, many = seed_size(self.k)
        seeds = mix(grams(self.h, size))
        if not len(self.starts):
            self.seeds, self.chosen = seeds, np.zeros(0, np.int64)
            return
        # a sliding minimum by doubling; equal hashes are equal seeds, so ties do not matter
        low, width = seeds, 1
        while width * 2 <= many:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[: len(seeds) - many + 1], low[many - width : many - width + len(seeds) - many + 1])
        self.seeds, self.chosen = seeds, low[self.starts]

    def seed_requests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct selected seeds, and the least and largest document that has each."""
        return extremes(self.chosen, self.id[self.starts])

    def mark(self, repeated: np.ndarray) -> None:
        """Keep the windows whose seed is repeated (a flag for each distinct seed, sorted)."""
        keys, at = np.unique(self.chosen, return_inverse=True)
        self.starts = self.starts[repeated.astype(bool)[at]] if len(keys) else self.starts
        s = self.starts
        self.edge = grams(self.h, self.k)[s] if len(s) else np.zeros(0, U)
        # a walk goes on while the next window of the same document is marked too
        joined = (s[1:] == s[:-1] + 1) & (self.doc[s[1:]] == self.doc[s[:-1]]) if len(s) else np.zeros(0, bool)
        self.begins = np.concatenate([[True], ~joined]) if len(s) else np.zeros(0, bool)

    def node_requests(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct nodes, each with the one pair of edges in and out that it has here; 0 where it has
        several, or where a walk ends."""
        if not len(self.starts):
            return np.zeros(0, U), np.zeros(0, U)
        last = np.concatenate([self.begins[1:], [True]])
        before = np.concatenate([[U(0)], self.edge[:-1]])
        through = np.where(self.begins, U(0), pair(before, self.edge) | U(1))
        tail = self.tails(last)
        keys, low, high = extremes(np.concatenate([self.nodes(), tail]), np.concatenate([through, np.zeros(len(tail), U)]))
        return keys, np.where(low == high, low, U(0))

    def nodes(self) -> np.ndarray:
        return mix(grams(self.h, self.k - 1)[self.starts]) if self.k > 1 else np.ones(len(self.starts), U)

    def tails(self, last: np.ndarray) -> np.ndarray:
        return mix(grams(self.h, self.k - 1)[self.starts[last] + 1]) if self.k > 1 else np.ones(int(last.sum()), U)

    def cut(self, cuts: np.ndarray) -> None:
        """Cut the walks where their node is a cut; each piece is then a whole compacted path."""
        s = self.starts
        if not len(s):
            self.piece = np.zeros((0, 2), np.int64)
            self.key = self.check = np.zeros(0, U)
            return
        node = self.nodes()
        last = np.concatenate([self.begins[1:], [True]])
        keys = np.unique(np.concatenate([node, self.tails(last)]))
        is_cut = cuts.astype(bool)[np.searchsorted(keys, node)]
        first = np.flatnonzero(self.begins | is_cut)
        edges = np.diff(np.append(first, len(s)))
        self.piece = np.stack([s[first], s[first] + edges + self.k - 1], axis=1)  # words [from, to)
        # 128 bits over the words at the source coordinates: two independent prefix hashes
        self.key = self.span_hash(self.h, 0)
        self.check = self.span_hash(word_hashes(self.w, 1), 1)

    def span_hash(self, h: np.ndarray, seed: int) -> np.ndarray:
        base = int(mix(np.array([seed + 11], U))[0]) | 1
        powers = power_table(base, len(h) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(h * powers[:-1])])
        inverse = power_table(pow(base, -1, 1 << 64), len(h) + 1)
        begin, end = self.piece[:, 0], self.piece[:, 1]
        return mix(((total[end] - total[begin]) * inverse[begin]) + (end - begin).astype(U))

    def path_requests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct paths, by key, then check; the least document that holds each, and each piece's path."""
        doc = self.id[self.piece[:, 0]] if len(self.piece) else np.zeros(0, np.int64)
        keys, where = X.grouped(self.key, self.check)
        check, least = np.zeros(len(keys), U), np.full(len(keys), NO_DOC)
        check[where] = self.check
        np.minimum.at(least, where, doc)
        return keys, check, least, where

    def removed(self, least: np.ndarray) -> np.ndarray:
        """Flags of the words to remove; least: the smallest document of each distinct path."""
        keys, _, _, where = self.path_requests()
        gone = np.zeros(len(self.h) + 1, np.int64)
        if len(keys):
            hit = self.piece[least[where] < self.id[self.piece[:, 0]]]
            np.add.at(gone, hit[:, 0], 1)
            np.add.at(gone, hit[:, 1], -1)
        return np.cumsum(gone)[:-1] > 0


def power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k *= 2
    return out


def extremes(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the least and the largest value of each."""
    if not len(keys):
        return keys, values, values
    order = np.argsort(keys, kind="stable")
    sorted_keys, sorted_values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[first], np.minimum.reduceat(sorted_values, first), np.maximum.reduceat(sorted_values, first)


SEED, NODE, PATH = 0, 1, 2


def merge(kind: int, keys: np.ndarray, group: np.ndarray, vals: list[np.ndarray]) -> np.ndarray:
    if kind == NODE:  # pairs of edges are unsigned; 0, where a walk ends, is their least
        vals = [v.view(U) for v in vals]

    def extreme(at: int, values: np.ndarray) -> np.ndarray:
        limits = np.iinfo(values.dtype)
        out = np.full(len(keys), limits.min if at else limits.max, values.dtype)
        (np.maximum if at else np.minimum).at(out, group, values)
        return out

    if kind == PATH:  # vals: check, document
        return extreme(0, vals[1])
    low = extreme(0, vals[0])
    # seeds that two documents share; nodes with an end (0) or a second pair of edges, which are cuts
    several = low != extreme(1, vals[-1])
    return (several | (low == 0) if kind == NODE else several).astype(np.int64)


def spans(chunks: DataFrame, scratch: Scratch, k: int, finish: Callable[[Walks, pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Run the four passes; ``finish(walks, documents, removed)`` makes a chunk's result rows."""

    def walks(table: pa.Table) -> Walks:
        table = table.combine_chunks()
        return Walks(table.column(text).combine_chunks(), table.column(doc_id).combine_chunks(), k)

    buckets = X.buckets_for(chunks, 0.4)

    def seeds(batches):
        for b in batches:
            for chunk, payload in zip(b.column("chunk_id").to_pylist(), b.column("payload"), strict=True):
                keys, low, high = walks(X.unpack(payload.as_py())).seed_requests()
                yield X.to_batch(X.request_rows(chunk, SEED, keys, [low, high], buckets), X.REQUESTS)

    repeated = scratch.write(X.answer(chunks.select("chunk_id", "payload").mapInArrow(seeds, X.REQUESTS), merge, 2), "seeds")

    def nodes(chunk, table, got):
        w = walks(table)
        w.mark(X.answers_of(got, SEED))
        keys, through = w.node_requests()
        yield X.to_batch(X.request_rows(chunk, NODE, keys, [through], buckets), X.REQUESTS)

    cuts = scratch.write(X.answer(X.with_answers(chunks, repeated, nodes, X.REQUESTS), merge, 1), "nodes")
    known = repeated.unionByName(cuts)
    scratch.release()

    def paths(chunk, table, got):
        w = walks(table)
        w.mark(X.answers_of(got, SEED))
        w.cut(X.answers_of(got, NODE))
        keys, check, least, _ = w.path_requests()
        yield X.to_batch(X.request_rows(chunk, PATH, keys, [check, least], buckets), X.REQUESTS)

    sources = scratch.write(X.answer(X.with_answers(chunks, known, paths, X.REQUESTS), merge, 2, checked=True), "paths")
    known = known.unionByName(sources)
    scratch.release()

    def last(chunk, table, got):
        w = walks(table)
        w.mark(X.answers_of(got, SEED))
        w.cut(X.answers_of(got, NODE))
        yield from finish(w, table, w.removed(X.answers_of(got, PATH)))

    return X.with_answers(chunks, known, last, schema)


def kept_texts(w: Words, gone: np.ndarray, glue: bytes = b" ") -> Iterator[bytes]:
    """Each document's kept words, joined by one space."""
    data = w.data.tobytes()
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        at = lo + np.flatnonzero(~gone[lo:hi])
        yield glue.join(data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True))


def trimmed_texts(w: Words, gone: np.ndarray, texts: pa.Array) -> Iterator[str | None]:
    """Each text without its removed spans; texts that lose nothing stay as they are, byte for byte.

    What is left of a text keeps its own white space; what stood behind a removed span goes with it.
    """
    data = w.data.tobytes()
    texts = texts.to_pylist()
    for i, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        own = gone[lo:hi]
        if not own.any():
            yield texts[i]
            continue
        edge = np.diff(np.concatenate([[0], (~own).astype(np.int8), [0]]))
        runs = zip(lo + np.flatnonzero(edge == 1), lo + np.flatnonzero(edge == -1), strict=True)
        yield " ".join(data[w.start[a] : w.end[b - 1]].decode("utf-8", "replace") for a, b in runs)


def remove_repeats(spark: SparkSession, docs: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``; texts lose the spans of k words or more that a document
    with a smaller id holds too. A text that loses all its words becomes empty."""
    scratch = Scratch(spark, "substring")
    chunks = X.write_chunks(docs, scratch, text)

    def finish(w: Walks, table: pa.Table, gone: np.ndarray):
        table = table.combine_chunks()
        at = table.schema.get_field_index(text)
        new = pa.array(trimmed_texts(w.w, gone, table.column(text).combine_chunks()), table.schema.field(at).type)
        yield from table.set_column(at, table.schema.field(at), new).combine_chunks().to_batches()

    return spans(chunks, scratch, k, finish, docs.schema, text, doc_id)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(spark: SparkSession, docs: DataFrame, k: int = 13) -> DataFrame:
    """Counts of words and removed words, and the SHA-256 of the kept words joined by one space."""
    scratch = Scratch(spark, "substring")
    chunks = X.write_chunks(docs.select("doc_id", "text"), scratch)

    def finish(w: Walks, table: pa.Table, gone: np.ndarray):
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.w.first])
        sha = [hashlib.sha256(x).hexdigest() for x in kept_texts(w.w, gone)]
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(w.w.count, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return spans(chunks, scratch, k, finish, DIGEST)
