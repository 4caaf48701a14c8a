"""Large binaries by byte ranges: a data source whose partitions are ranges of files.

No file becomes one cell, whatever its size: a row is a range of at most ``blockSize`` bytes and the
``overlap`` bytes behind it. Paths are opened by pyarrow's file systems (local, hdfs, s3, gs, abfs, by the
path's scheme), as a task must seek; a folder stands for all files in it.

    spark.dataSource.register(ByteRanges)
    spark.read.format("byte_ranges").option("path", folder).option("blockSize", 8 << 20).load()
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import attach

BLOCK = 8 << 20
#: Bytes of a header that are read first, and at most.
HEAD, MOST = 256 << 10, 64 << 20


def opened(path: str):
    """A file that can seek."""
    system, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(at)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder, in the order of their paths."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    scheme = uri.split("://", 1)[0] + "://" if "://" in uri else ""
    system, at = pafs.FileSystem.from_uri(uri if scheme else f"file://{uri}")
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file)


class Range(InputPartition):
    def __init__(self, path: str, start: int, size: int, file_size: int):
        self.path, self.start, self.size, self.file_size = path, start, size, file_size


class Files:
    """Options that all sources here share: path (one or several, by commas)."""

    def __init__(self, options: dict):
        self.files = [f for p in options["path"].split(",") for f in listed(p)]


class ByteRanges(DataSource):
    """(path, file_size, start, size, content): content is the range's bytes and up to ``overlap`` more."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, file_size long, start long, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader, Files):
    def __init__(self, options: dict):
        Files.__init__(self, options)
        self.block, self.overlap = int(options.get("blocksize") or options.get("blockSize") or BLOCK), int(options.get("overlap") or 0)

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(self.block, n - at), n) for p, n in self.files for at in range(0, max(n, 1), self.block)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with opened(partition.path) as f:
            f.seek(partition.start)
            yield partition.path, partition.file_size, partition.start, partition.size, f.read(min(partition.size + self.overlap, partition.file_size - partition.start))


class FileHashes(DataSource):
    """(path, file_size, sha256): a file is one stream, of which one block is held at a time."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, file_size long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return HashReader(self.options)


class HashReader(DataSourceReader, Files):
    def __init__(self, options: dict):
        Files.__init__(self, options)

    def partitions(self) -> list[Range]:
        return [Range(p, 0, n, n) for p, n in self.files]

    def read(self, partition: Range) -> Iterator[tuple]:
        digest = hashlib.sha256()
        with opened(partition.path) as f:
            while block := f.read(BLOCK):
                digest.update(block)
        yield partition.path, partition.file_size, digest.hexdigest()


def source(spark: SparkSession, kind: type[DataSource], path: str, **options) -> DataFrame:
    attach(spark).dataSource.register(kind)
    return spark.read.format(kind.name()).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def occurrences(spark: SparkSession, path: str, tokens: list[str], block: int = BLOCK) -> DataFrame:
    """(path, token, at): every place at which one of the tokens (as UTF-8) begins, overlapping ones too.

    Ranges overlap by the longest token less one byte, and a hit counts in the range in which it begins,
    so that one across a border is found, and found once. All tokens are looked for in one pass."""
    patterns = sorted({t.encode() for t in tokens if t})
    if not patterns:
        return spark.createDataFrame([], "path string, token string, at long")
    ranges = source(spark, ByteRanges, path, blockSize=block, overlap=max(map(len, patterns)) - 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p.decode("latin-1"), p)
        automaton.make_automaton()
        for b in batches:
            for where, start, size, content in zip(*(b.column(c) for c in ("path", "start", "size", "content")), strict=True):
                hits = [(p.decode(), begin) for end, p in automaton.iter(content.as_py().decode("latin-1")) if (begin := end - len(p) + 1) < size.as_py()]
                for i in range(0, len(hits), 65536):
                    part = hits[i : i + 65536]
                    yield pa.RecordBatch.from_pydict({"path": [where.as_py()] * len(part), "token": [t for t, _ in part], "at": [start.as_py() + a for _, a in part]})

    return ranges.mapInArrow(search, "path string, token string, at long")


def mentioned(spark: SparkSession, path: str, tokens: list[str], block: int = BLOCK) -> DataFrame:
    """(path, token, n): how often each file holds each of the tokens that it holds."""
    return occurrences(spark, path, tokens, block).groupBy("path", "token").agg(F.count(F.lit(1)).alias("n"))


def content_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, renamed): stem.<8 hex digits>.ext for each file."""
    hashed = source(spark, FileHashes, path)
    name = F.element_at(F.split("path", "/"), -1)
    return hashed.select("path", "file_size", "sha256", F.concat(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?\z", 1), F.lit("."), F.substring("sha256", 1, 8), F.regexp_extract(name, r"(\.[^.]*)\z", 1)).alias("renamed"))


class Header:
    """Values off the beginning of a file, of which more is read as they need it: HEAD bytes first, then as
    many again as there are, ``most`` in all."""

    def __init__(self, file, size: int, most: int):
        self.file, self.size, self.most, self.data, self.at = file, size, most, b"", 0

    def need(self, n: int, what: str) -> None:
        while self.at + n > len(self.data):
            if self.at + n > min(self.size, self.most):
                raise EOFError(f"{what} beyond {'the file' if self.size <= self.most else f'the first {self.most} bytes'}")
            more = self.file.read(min(max(HEAD, len(self.data)), min(self.size, self.most) - len(self.data)))
            if not more:
                raise EOFError(f"{what} beyond the file")
            self.data += more

    def number(self, kind: str, what: str = "value"):
        size = struct.calcsize("<" + kind)
        self.need(size, what)
        (value,) = struct.unpack_from("<" + kind, self.data, self.at)
        self.at += size
        return value

    def string(self, what: str = "string") -> str:
        n = self.number("Q", what)
        self.need(n, what)
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def skip(self, n: int, what: str = "value") -> None:
        self.need(n, what)
        self.at += n


#: GGUF's numbers of metadata types, as struct writes them; 8 is a string, 9 an array.
NUMBERS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


def metadata(head: Header, wanted: bool) -> Iterator[tuple[str, str]]:
    """(key, value as text) of strings and numbers; arrays are passed over."""
    for _ in range(head.number("Q", "number of keys")):
        key = head.string("key")
        kind = head.number("I", key)
        if kind == 8:
            value = head.string(key)
            if wanted:
                yield key, value
        elif kind == 9:
            inner, n = head.number("I", key), head.number("Q", key)
            if inner == 8:
                for _ in range(n):
                    head.skip(head.number("Q", key), key)
            elif inner in NUMBERS:
                head.skip(n * struct.calcsize("<" + NUMBERS[inner]), key)
            else:
                raise ValueError(f"{key}: an array of type {inner}")
        elif kind in NUMBERS:
            value = head.number(NUMBERS[kind], key)
            if wanted:
                yield key, str(value).lower() if kind == 7 else str(value)
        else:
            raise ValueError(f"{key}: a value of type {kind}")


def gguf_header(head: Header, parts: str = "both", key: str | None = None) -> Iterator[tuple]:
    """(kind, name, value, dims, dtype) of a header, as far as it is asked for; fails where it is cut or none."""
    head.need(4, "magic")
    if head.data[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    head.at = 4
    head.number("I", "version")
    tensors = head.number("Q", "number of tensors")
    for name, value in metadata(head, parts != "tensors"):
        if key is None or name == key:
            yield "meta", name, value, None, None
            if key is not None:
                return
    for _ in range(tensors if parts != "meta" else 0):
        name = head.string("tensor")
        dims = [head.number("Q", name) for _ in range(head.number("I", name))]
        dtype = head.number("I", name)
        head.number("Q", name)
        yield "tensor", name, None, dims, dtype


def gguf_rows(data: bytes) -> Iterator[tuple]:
    """The rows of a header that is at hand; a cut one ends early, other files give nothing."""
    with contextlib.suppress(EOFError, ValueError):
        yield from gguf_header(Header(io.BytesIO(data), len(data), len(data)))


class Gguf(DataSource):
    """(path, kind, name, value, dims, dtype, bytes_read) of GGUF headers; kind is meta, tensor or error.

    ``parts``: meta, tensors or both. meta alone ends before the index of tensors; ``key`` ends at a key. A
    file that is no GGUF file, or whose header goes on beyond ``most`` bytes, gives an error row behind
    what could be read."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "path string, kind string, name string, value string, dims array<long>, dtype int, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return GgufReader(self.options)


class GgufReader(DataSourceReader, Files):
    def __init__(self, options: dict):
        Files.__init__(self, options)
        self.parts, self.key, self.most = options.get("parts") or "both", options.get("key"), int(options.get("most") or MOST)

    def partitions(self) -> list[Range]:
        return [Range(p, 0, n, n) for p, n in self.files]

    def read(self, partition: Range) -> Iterator[tuple]:
        with opened(partition.path) as f:
            head = Header(f, partition.file_size, self.most)
            row = lambda *x: (partition.path, *x, len(head.data))
            try:
                for found in gguf_header(head, self.parts, self.key):
                    yield row(*found)
            except (EOFError, ValueError) as fault:
                yield row("error", None, str(fault), None, None)


def gguf(spark: SparkSession, path: str, parts: str = "both", key: str | None = None, most: int = MOST) -> DataFrame:
    """The headers of GGUF files under a path; see ``Gguf``."""
    options = {"parts": parts, "most": most} | ({"key": key} if key else {})
    return source(spark, Gguf, path, **options)


def architectures(spark: SparkSession, path: str) -> DataFrame:
    """(path, architecture, error): reads each header up to that key alone; null with the reason without it."""
    rows = gguf(spark, path, "meta", "general.architecture", HEAD)
    names = spark.createDataFrame([(p,) for p, _ in listed(path)], "path string")
    found = rows.groupBy("path").agg(F.max(F.when(F.col("kind") == "meta", F.col("value"))).alias("architecture"), F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"))
    return names.join(found, "path", "left").withColumn("error", F.when(F.col("architecture").isNull(), F.coalesce("error", F.lit("general.architecture is not in the metadata"))))
