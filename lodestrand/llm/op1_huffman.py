"""Token files: ids under one canonical, length-limited Huffman code.

Writing takes three phases. Texts become ids once and are kept compressed. The ids' global counts
give a code of at most ``LIMIT`` bits (package-merge), kept as (id, length) pairs: the canonical
code follows from the lengths. Then documents are dealt in ascending id order, by ranges, and
packed into blocks of whole documents.

A *token file* is a folder of two Parquet tables. ``codebook``: id, length. ``blocks``: shard,
block, the block's document ids and lengths, n_tokens, the bits, and the bit offset of every
``STEP``-th token. Blocks are independent of each other and begin on a word boundary, so any block
can be read alone; within a block all checkpoints are decoded side by side, a token at a time, by
one look-up in a table of 2**LIMIT entries.

Defined results: a null text is empty and holds the end id alone; null ids come first; rows that
repeat an id all appear; an empty table gives an empty file; a text of any length is one document
of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as T
from .exchange import expand, squeeze, to_batch
from .storage import Scratch
from .text import pieces, tidy

LIMIT = 20
STEP = 256
BLOCK_TOKENS = 1 << 19
SHARD_TOKENS = 4 << 20
LOWEST = -(2**63)
BLOCKS = "shard int, block int, doc_ids binary, doc_lengths binary, n_tokens long, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit in {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        rank = np.argsort(merged, kind="stable")
        row, is_leaf = merged[rank], rank < n
    levels.append(is_leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of (id, length) pairs: codes ascend by length, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        step = np.int64(1) << (LIMIT - self.lengths)
        self.begin = np.concatenate([[0], np.cumsum(step)])
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (self.begin[:-1] >> (LIMIT - self.lengths)).astype(np.uint64)
        self.length[self.ids] = self.lengths

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for each LIMIT-bit prefix."""
        if not hasattr(self, "_table"):
            step = np.diff(self.begin)
            spare = (1 << LIMIT) - int(self.begin[-1])
            self._table = np.concatenate([np.repeat(self.ids, step), np.zeros(spare, np.int64)]).astype(np.uint32), np.concatenate([np.repeat(self.lengths, step), np.ones(spare, np.int64)]).astype(np.uint8)
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits as big-endian 32-bit words, and the bit offset of every STEP-th token."""
        length = self.length[ids]
        ends = np.cumsum(length)
        begin = ends - length
        words = int(ends[-1] + 31) // 32 if len(ids) else 0
        word, inside = begin >> 5, (begin & 31).astype(np.uint64)
        wide = self.code[ids] << (np.uint64(64) - length.astype(np.uint64) - inside)
        # no two codes share a bit, so sums are the same as OR and stay exact below 2**32
        total = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words + 1)
        total += np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)[: words + 1]
        return total[:words].astype(">u4").tobytes(), begin[::STEP].astype(np.int64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        symbol, size = self.table()
        words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2 + STEP * LIMIT // 32, np.uint64)])
        window = (words[:-1] << np.uint64(32)) | words[1:]
        at = checkpoints.astype(np.int64).copy()
        out = np.empty((STEP, len(at)), np.uint32)
        for i in range(STEP):
            key = ((window[at >> 5] << (at & 31).astype(np.uint64)) >> np.uint64(64 - LIMIT)).astype(np.int64)
            out[i] = symbol[key]
            at += size[key]
            np.minimum(at, (len(window) - 1) << 5, out=at)  # the last lane runs on past its end
        return out.T.reshape(-1)[:n]


STAGED = "doc_id long, n_tokens long, ids binary"


def tokenized(docs: DataFrame, path: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the compressed ids of each document, the end id included."""

    def run(batches):
        encoder = T.encoder(path)
        for batch in batches:
            for part in pieces(batch, "text", T.SLICE):
                ids, first = T.with_end(*encoder.encode(part.column("text")), end)
                ids = ids.astype(np.uint32)
                rows = [(i, int(b - a), squeeze(ids[a:b])) for i, a, b in zip(part.column("doc_id").to_pylist(), first[:-1], first[1:], strict=True)]
                yield to_batch(rows, STAGED)
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STAGED)


def global_counts(staged: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            total = np.zeros(0, np.int64)
            for x in batch.column("ids"):
                found = np.bincount(expand(x.as_py(), np.uint32))
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(spark: SparkSession, docs: DataFrame, folder: str, path: str, end: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the token file ``folder`` of all ``docs``, in ascending id order."""
    scratch = Scratch(spark, "tokens")
    staged = scratch.write(tokenized(docs, path, end, text, doc_id), "ids")
    counted = sorted(tuple(r) for r in global_counts(staged).collect())  # one row an id of the vocabulary
    ids, n = (np.array([c[i] for c in counted], np.int64) for i in (0, 1))
    lengths = code_lengths(n)
    book = spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, lengths, strict=True)], "id long, length int")
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((ids, lengths))
    scratch.release()

    def run(batches: Iterator[pa.RecordBatch]):
        code = Code(*shared.value)
        shard, block = TaskContext.get().partitionId(), 0
        held, doc_ids, sizes, size = [], [], [], 0

        def flush():
            bits, checkpoints = code.encode(np.concatenate(held))
            return to_batch([(shard, block, np.array(doc_ids, np.int64).tobytes(), squeeze(np.array(sizes, np.int64)), sum(sizes), bits, squeeze(checkpoints))], BLOCKS)

        for batch in batches:
            for i, n_tokens, x in zip(batch.column("key").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                held.append(expand(x.as_py(), np.uint32))
                doc_ids.append(i)
                sizes.append(n_tokens)
                size += n_tokens
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block += 1
                    held, doc_ids, sizes, size = [], [], [], 0
        if held:
            yield flush()

    total = int(n.sum()) if len(n) else 0
    keyed = staged.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), "n_tokens", "ids")
    ordered = keyed.repartitionByRange(max(1, total // SHARD_TOKENS + 1), "key").sortWithinPartitions("key")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    scratch.drop(staged)
    scratch.release()


DOCS = "doc_id long, start long, n_tokens long, ids binary"
FEW_BLOCKS = 100_000  # rows of 16 bytes that a join may broadcast


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document of a token file."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    book = np.array([tuple(r) for r in spark.read.schema("id long, length int").parquet(f"{folder}/codebook").collect()], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((book[:, 0], book[:, 1]))

    def run(batches):
        code = None
        for batch in batches:
            for begin, doc_ids, sizes, n, bits, checkpoints in zip(*(batch.column(c) for c in ("begin", "doc_ids", "doc_lengths", "n_tokens", "bits", "checkpoints")), strict=True):
                code = code or Code(*shared.value)
                ids = code.decode(bits.as_py(), expand(checkpoints.as_py(), np.int64), n.as_py()).astype("<u4")
                size = expand(sizes.as_py(), np.int64)
                ends = np.cumsum(size)
                rows = [(None if i == LOWEST else i, begin.as_py() + int(b - s), int(s), ids[b - s : b].tobytes()) for i, s, b in zip(np.frombuffer(doc_ids.as_py(), np.int64).tolist(), size, ends, strict=True)]
                for at in range(0, len(rows), 512):
                    yield to_batch(rows[at : at + 512], DOCS)

    # tokens before each block: of the shards before, then of the shard's blocks before
    sizes = blocks.select("shard", "block", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    starts = sizes.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("block_start")).join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("begin"))
    if sizes.count() <= FEW_BLOCKS:
        starts = F.broadcast(starts)
    return blocks.join(starts, ["shard", "block"]).select("begin", "doc_ids", "doc_lengths", "n_tokens", "bits", "checkpoints").mapInArrow(run, DOCS)


def digest(spark: SparkSession, docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write all documents to a token file in the shared folder and read it back."""
    folder = f"{Scratch(spark, 'tokenfile').root}/file"
    write(spark, docs, folder, path, end)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
