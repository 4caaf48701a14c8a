"""Readers and writers. All paths go through Spark, so any file system it knows will do."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fold
from ..functions import text as X
from ..functions.markdown import html_to_markdown
from ..operators.blend import ranked
from ..operators.retrieval import publishable
from ..session import written

#: File types that hold text, and folders that are passed over.
EXTENSIONS = ("md", "mdx", "txt", "html", "htm", "js", "mjs", "cjs", "json", "ts")
SKIPPED = ("node_modules", "dist", "build", ".git", ".finetune", ".finetune-venv", "vendor", "__pycache__", ".next", "coverage")
LARGEST = 2_000_000


def text_files(spark: SparkSession, folder: str, largest: int = LARGEST) -> DataFrame:
    """(path, text, hash) of a folder's text files, cleaned; HTML as Markdown. Paths are relative."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    local = F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:/*(?=/)", "")
    root = F.lit("/" + folder.split(":", 1)[-1].strip("/") + "/")
    relative = F.when(local.startswith(root), F.substring(local, F.length(root) + 1, F.length(local))).otherwise(F.element_at(F.split(local, "/"), -1))
    kind = F.lower(F.regexp_extract(relative, r"\.([^./]*)\z", 1))
    kept = found.select(relative.alias("path"), kind.alias("kind"), "length", "content").filter(F.col("kind").isin(*EXTENSIONS) & (F.col("length") <= largest)).filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED])))
    raw = kept.withColumn("raw", F.col("content").cast("string")).drop("content")
    page = F.col("kind").isin("html", "htm")
    out = raw.withColumn("text", F.when(page, html_to_markdown(F.when(page, F.col("raw")))).otherwise(X.clean_text(F.col("raw"))))
    return out.select("path", "text", X.hash16(F.col("text")).alias("hash"))


def json_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are passed over, bad ones fail. A missing file is empty on request."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


MANIFEST = "id string, base string, artifacts struct<mlc:string,webllm:string,onnx:string,gguf:string>, models array<struct<id:string,label:string,base:string,source:string,artifacts:struct<mlc:string,webllm:string,onnx:string,gguf:string>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, label, base, source, mlc, webllm, onnx, gguf): a manifest's entries; one of the older
    form is one entry."""
    raw = json_array(spark, path, MANIFEST)
    entry = lambda e, i: F.struct(i.alias("pos"), F.coalesce(e["id"], F.concat(F.lit("model-"), i.cast("string"))).alias("id"), e["label"].alias("label"), e["base"].alias("base"), e["source"].alias("source"), e["artifacts"].alias("artifacts"))
    listed = F.transform("models", entry)
    old = F.array(F.struct(F.lit(0).alias("pos"), F.coalesce("id", F.lit("default")).alias("id"), F.lit(None).cast("string").alias("label"), F.col("base").alias("base"), F.lit("tuned").alias("source"), F.col("artifacts").alias("artifacts")))
    rows = F.when(F.coalesce(F.size("models"), F.lit(0)) > 0, listed).when(F.col("artifacts").isNotNull(), old)
    return raw.select(F.explode(rows).alias("e")).select("e.pos", "e.id", "e.label", "e.base", "e.source", "e.artifacts.*")


def external_data(content: Column) -> Column:
    """Names of data files that an ONNX graph's bytes mention."""
    return F.array_distinct(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"([A-Za-z0-9_./-]+\.onnx_data(?:_[0-9]+)?)"), F.lit(1)))


def write_index(chunks: DataFrame, idf: DataFrame, embedder_id: str, folder: str) -> None:
    """Chunks, idf table and metadata of an index; rows that are not public never leave."""
    publishable(chunks).write.mode("overwrite").parquet(f"{folder}/chunks")
    idf.write.mode("overwrite").parquet(f"{folder}/idf")
    chunks.sparkSession.createDataFrame([(1, embedder_id)], "version int, embedder string").write.mode("overwrite").parquet(f"{folder}/meta")


def read_index(spark: SparkSession, folder: str, embedder_id: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and idf table of an index; an index of another embedder is refused."""
    own = spark.read.parquet(f"{folder}/meta").first()["embedder"]
    if own != embedder_id:
        raise ValueError(f"the index was made with {own}, not {embedder_id}")
    return spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/idf")


def train_valid(rows: DataFrame, order: str) -> DataFrame:
    """Adds split: the last tenth (one row at least) is valid; a single row is in both."""
    n = rows.count()
    held = max(1, n // 10)
    numbered = ranked(rows, [order], "at")
    valid = numbered.filter(F.col("at") >= n - held).withColumn("split", F.lit("valid"))
    train = (numbered if n <= held else numbered.filter(F.col("at") < n - held)).withColumn("split", F.lit("train"))
    return train.unionByName(valid).drop("at")


FOLDED = "part long, n long, run binary"
FEW_RUNS = 256  # rows of about 1 KB (256 KB where ids have characters beyond Latin-1) that the driver composes


def index_key(chunks: DataFrame, embedder_id: str, order: list[str], chunk_id: str = "id", text: str = "text") -> str:
    """rag:<hash>:<chunks>: the 32-bit FNV-1a of the embedder's id and of each chunk's "id:length:" in
    order, as UTF-16 code units and lengths in them. Null ids and texts are empty.

    The chunks are ranged by ``order``; a range's run of characters becomes one row, and runs compose in
    groups of FEW_RUNS until as few are left."""
    line = F.concat(F.coalesce(F.col(chunk_id).cast("string"), F.lit("")), F.lit(":"), (F.octet_length(F.encode(X.text(text), "UTF-16BE")) / 2).cast("long").cast("string"), F.lit(":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = fold.NOTHING, 0
        for b in batches:
            for begin in range(0, b.num_rows, 4096):
                lines = b.column(0).slice(begin, 4096).to_pylist()
                whole, n = whole.then(fold.piece(fold.units("".join(lines)))), n + len(lines)
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "run": [whole.bytes()]})

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "run")), strict=True))
        whole = reduce(fold.Piece.then, (fold.Piece.read(r[2]) for r in rows))
        return pa.table({"part": [rows[0][0] // FEW_RUNS], "n": [sum(r[1] for r in rows)], "run": [whole.bytes()]})

    runs = written(chunks.select(line.alias("line"), *order).repartitionByRange(*order).sortWithinPartitions(*order).select("line").mapInArrow(run, FOLDED))
    while runs.limit(FEW_RUNS + 1).count() > FEW_RUNS:
        runs = written(runs.groupBy(F.expr(f"part div {FEW_RUNS}")).applyInArrow(compose, FOLDED))
    state, n = fold.piece(fold.units(embedder_id)).apply(fold.START), 0
    for r in sorted(runs.collect()):
        state, n = fold.Piece.read(bytes(r["run"])).apply(state), n + r["n"]
    return f"rag:{fold.base36(state)}:{n}"
