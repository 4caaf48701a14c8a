"""An index that is changed in place, scope by scope.

Chunks and token counts lie in partitions of a scope and a batch. Document frequencies add up over
partitions, so they are kept as one count a token and partition: adding a batch writes its own
partitions, purging a scope removes that scope's folders, and nothing else is read or written. A
batch that is added again (a job that was cut off and is repeated) replaces itself.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.retrieval import ALL_SCOPES, PUBLIC, scope_of

COUNTS = "token string, n long"  # token null: the partition's chunks
META = "version int, embedder string, top_k int, min_score double, schema string"


def key(scope: str | None) -> str:
    """The folder name of a scope, which may hold any characters."""
    return "s" + hashlib.sha256(((scope or "").strip() or PUBLIC).encode()).hexdigest()


def key_of(scope: Column) -> Column:
    return F.concat(F.lit("s"), F.sha2(scope, 256))


class StoredIndex:
    """An index in a folder. ``chunks`` have an id, text and scope; null scopes are public, null texts
    have no tokens, rows that repeat an id are chunks of their own, and further columns are kept."""

    def __init__(self, spark: SparkSession, folder: str, embedder_id: str | None = None):
        """Opens an index; one of another embedder than that named is refused."""
        self.spark, self.folder = spark, folder.rstrip("/")
        meta = spark.read.schema(META).parquet(f"{self.folder}/meta").first()
        if embedder_id is not None and meta["embedder"] != embedder_id:
            raise ValueError(f"the index was made with {meta['embedder']}, not {embedder_id}")
        self.embedder, self.schema = meta["embedder"], meta["schema"]
        self.top_k = 4 if meta["top_k"] is None else meta["top_k"]
        self.min_score = 0.05 if meta["min_score"] is None else meta["min_score"]

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: str, embedder_id: str = "lexical-512", top_k: int | None = None, min_score: float | None = None) -> StoredIndex:
        """An empty index for chunks of ``schema``, with its hints for retrieval."""
        row = [(1, embedder_id, top_k, min_score, schema)]
        spark.createDataFrame(row, META).write.mode("error").parquet(f"{folder.rstrip('/')}/meta")
        return cls(spark, folder)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        whole = f"{schema}, part string, batch string"
        if not self._fs(path)[1]:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(path)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return (lambda: fs.delete(where, True)), fs.exists(where)

    def append(self, chunks: DataFrame, batch: str) -> None:
        """Adds a batch. ``batch`` names it for good: the same name again replaces its rows in the scopes
        that it has rows in. Counts follow the chunks, from the rows as they were written."""
        name = "b" + hashlib.sha256(batch.encode()).hexdigest()[:32]
        rows = chunks.withColumn("scope", scope_of("scope")).withColumns({"part": key_of(F.col("scope")), "batch": F.lit(name)})
        self._write(rows.select(*self.spark.createDataFrame([], self.schema).columns, "part", "batch"), "chunks")
        stored = self._read("chunks", self.schema).filter(F.col("batch") == name)
        tokens = F.array_distinct(F.coalesce(retrieval.lexical_tokens(F.col("text")), F.array().cast("array<string>")))
        counted = stored.select("part", "batch", F.explode(F.concat(tokens, F.array(F.lit(None).cast("string")))).alias("token"))
        self._write(counted.groupBy("part", "batch", "token").agg(F.count(F.lit(1)).alias("n")).select("token", "n", "part", "batch"), "counts")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{self.folder}/{name}")

    def purge(self, scope: str) -> tuple[int, int]:
        """Removes a scope's folders. Returns how many chunks went and how many stay, from the counts."""
        part = key(scope)
        sizes = self._read("counts", COUNTS).filter("token IS NULL")
        gone = F.col("part") == part
        n = sizes.agg(F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("gone"), F.coalesce(F.sum(F.when(~gone, F.col("n"))), F.lit(0)).alias("rest")).first()
        for name in ("chunks", "counts"):  # chunks first: what is purged is never found, even if this is cut off
            delete, there = self._fs(f"{self.folder}/{name}/part={part}")
            if there:
                delete()
        return n["gone"], n["rest"]

    def chunks(self, scopes: object) -> DataFrame:
        """The chunks of the scopes named, or of ALL_SCOPES; other scopes' folders are not read."""
        rows = self._read("chunks", self.schema)
        if scopes is not ALL_SCOPES and scopes is not None:
            rows = rows.filter(F.col("part").isin([key(s) for s in ([scopes] if isinstance(scopes, str) else scopes)]))
        return retrieval.visible(rows, scopes).drop("part", "batch")

    def inverse_frequency(self) -> DataFrame:
        """(token, df, idf) over all chunks: one row a token and partition is read, no text."""
        counts = self._read("counts", COUNTS)
        total = counts.filter("token IS NULL").agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))
        df = counts.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("df"))
        return df.crossJoin(F.broadcast(total)).select("token", "df", F.ln(1 + F.col("total") / (1 + F.col("df"))).alias("idf"))  # one row

    def search(self, queries: DataFrame, query: str, scopes: object, key: str = "id", k: int | None = None, least: float | None = None) -> DataFrame:
        """Lexical search under the stored frequencies, with the index's own hints where none are given."""
        dims = retrieval.embedder(self.embedder).dims
        return retrieval.lexical_search(self.chunks(scopes), queries, key, query, ALL_SCOPES, self.top_k if k is None else k, self.min_score if least is None else least, dims, idf=self.inverse_frequency())
