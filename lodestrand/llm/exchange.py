"""A distributed table of 64-bit keys that chunks of documents ask and are answered from.

Documents are written once as chunks of a few MB (a row each: compressed Arrow). A pass
over the chunks sends each chunk's *distinct* keys, sorted, to buckets by the keys' high
bits; a bucket merges what all chunks sent and answers every chunk in the order of its
keys. So a key reaches its bucket at most once from each chunk, however often it occurs:
a word or passage that a third of all documents hold costs as many entries as there are
chunks. The number of buckets follows the number of words, which bounds what one task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .text import U, pieces, tidied, words

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 2 << 20
CHUNKS = "chunk_id long, n_rows long, n_words long, payload binary"
REQUESTS = "bucket int, chunk_id long, kind int, keys binary, vals binary"
ANSWERS = "chunk_id long, bucket int, kind int, answer binary"
ANSWERED = "chunk_id long, payload binary, answers binary"


def pack(table: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, plane by plane (high bytes are mostly alike), compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def write_chunks(docs: DataFrame, scratch: Scratch, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``docs`` as chunks, whole documents each; returns the table of chunks."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            number += 1
            n = len(words(table.column(text)).start)
            return pa.RecordBatch.from_pydict({"chunk_id": [number], "n_rows": [table.num_rows], "n_words": [n], "payload": [pack(table)]}, pa.schema([("chunk_id", pa.int64()), ("n_rows", pa.int64()), ("n_words", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for part in pieces(batch, text, chunk_bytes // 2):
                held.append(part)
                size += part.nbytes
                if size >= chunk_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return scratch.write(docs.mapInArrow(tidied(chunk), CHUNKS), "chunks")


def buckets_for(chunks: DataFrame, share: float = 1.0) -> int:
    """Buckets for about ``share`` keys a word."""
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    return max(12, int(total * share / BUCKET_KEYS) + 1)


def split_by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in the sorted distinct keys (buckets + 1 positions)."""
    bucket = (keys >> U(32)) * U(buckets) >> U(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))


def request_rows(chunk_id: int, kind: int, keys: np.ndarray, vals: list[np.ndarray], buckets: int) -> list[tuple]:
    """One row for each bucket that gets keys; vals: arrays of 8-byte numbers beside the keys."""
    at = split_by_bucket(keys, buckets)
    # sorted keys go as differences, which have fewer bytes that vary
    return [(b, chunk_id, kind, squeeze(np.diff(keys[lo:hi], prepend=U(0))), squeeze(np.concatenate([v[lo:hi].view(np.int64) for v in vals])) if vals else b"") for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


Merge = Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], list[np.ndarray] | np.ndarray]


def grouped(keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the number of each entry's group; with ``check``, entries are of one
    group only where that agrees too (a key then appears once for each of its checks)."""
    if check is None:
        return np.unique(keys, return_inverse=True)
    order = np.lexsort((check, keys))
    k, c = keys[order], check[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])[: len(k)]
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    return k[new], group


def answer(requests: DataFrame, merge: Callable, width: int, checked: bool = False) -> DataFrame:
    """Answers to ``requests``: ``merge(kind, keys, group, vals)`` sees what one bucket got,
    the keys' distinct group numbers and ``width`` arrays of values, and returns an 8-byte
    number for each group. Rows of kind -1 are the sums that merge may return second. checked: the
    first array of values is 64 bits more of each key."""

    def reduce(table: pa.Table) -> pa.Table:
        out = []
        kinds = np.asarray(table.column("kind"))
        chunk, bucket = table.column("chunk_id").to_pylist(), table.column("bucket")[0].as_py()
        for kind in np.unique(kinds):
            rows = np.flatnonzero(kinds == kind)
            each = [np.cumsum(expand(table.column("keys")[int(r)].as_py(), U), dtype=U) for r in rows]
            size = np.array([len(x) for x in each])
            got = [expand(table.column("vals")[int(r)].as_py(), np.int64).reshape(width, -1) for r in rows] if width else []
            vals = [np.concatenate([x[i] for x in got]) for i in range(width)]
            keys, group = grouped(np.concatenate(each), vals[0] if checked else None)
            result = merge(int(kind), keys, group, vals)
            result, totals = result if isinstance(result, tuple) else (result, None)
            at = np.concatenate([[0], np.cumsum(size)])
            for i, r in enumerate(rows):
                out.append((chunk[r], bucket, int(kind), squeeze(result[group[at[i] : at[i + 1]]])))
            if totals is not None:
                out.append((-1 - int(kind), bucket, int(kind), np.asarray(totals, np.int64).tobytes()))
        return pa.Table.from_batches([to_batch(out, ANSWERS)])

    return requests.groupBy("bucket").applyInArrow(tidied(reduce), ANSWERS)


def answers_of(table: pa.Table, kind: int, dtype=np.int64) -> np.ndarray:
    """A chunk's answers of one kind, in the order of its sorted keys."""
    rows = np.flatnonzero(np.asarray(table.column("kind")) == kind)
    rows = rows[np.argsort(np.asarray(table.column("bucket"))[rows], kind="stable")]
    return np.concatenate([np.zeros(0, dtype), *(expand(table.column("answer")[int(r)].as_py(), np.int64).view(dtype) for r in rows)])


def with_answers(chunks: DataFrame, answers: DataFrame, use: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Join each chunk with its answers: ``use(chunk_id, documents, answers)`` gives result batches."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [b for i in range(left.num_rows) for b in use(left.column("chunk_id")[i].as_py(), unpack(left.column("payload")[i].as_py()), right)]
        return pa.Table.from_batches(got) if got else pa.Table.from_batches([to_batch([], schema)])

    return chunks.select("chunk_id", "payload").groupBy("chunk_id").cogroup(answers.filter("chunk_id >= 0").groupBy("chunk_id")).applyInArrow(tidied(apply), schema)


def answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk beside its answers in one row, for operators that pass over both more than once."""

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        own = pack(right.select(["bucket", "kind", "answer"]))
        return pa.Table.from_batches([to_batch([(c, p, own) for c, p in zip(left.column("chunk_id").to_pylist(), left.column("payload").to_pylist(), strict=True)], ANSWERED)])

    return chunks.select("chunk_id", "payload").groupBy("chunk_id").cogroup(answers.filter("chunk_id >= 0").groupBy("chunk_id")).applyInArrow(tidied(put), ANSWERED)


def over_answered(rows: DataFrame, use: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``use(chunk_id, documents, answers)`` on each row of what ``answered`` gave."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from use(b.column("chunk_id")[i].as_py(), unpack(b.column("payload")[i].as_py()), unpack(b.column("answers")[i].as_py()))

    return rows.mapInArrow(tidied(apply), schema)
