"""Lexical and dense retrieval over chunks.

Scopes are a boundary: a search names the scopes it may see, or ``ALL_SCOPES``; no scope named means
nothing is seen. Scopes are filtered before anything is ranked.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

PUBLIC = "public"
ALL_SCOPES = object()
DIMS = 512
SMALL_QUERIES = 10_000  # rows of a query side that may be broadcast
BLOCK = 1000  # chunks, and queries, of a block of a lexical search
#: Fixed value: what the model is told about its passages.
INSTRUCTIONS = "Answer using the numbered passages below. Cite the passages you use like [1]. If they do not contain the answer, say so."


def scope_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(X.trim(c), F.lit("")), F.lit(PUBLIC))


def visible(chunks: DataFrame, scopes: object) -> DataFrame:
    """The rows of the scopes named: a string, several, or ALL_SCOPES."""
    if scopes is ALL_SCOPES:
        return chunks
    if scopes is None:
        raise ValueError("name the scopes to search, or ALL_SCOPES")
    named = [scopes] if isinstance(scopes, str) else list(scopes)
    return chunks.filter(scope_of("scope").isin([(s or "").strip() or PUBLIC for s in named])) if named else chunks.filter(F.lit(False))


def scope_list(chunks: DataFrame) -> DataFrame:
    return chunks.select(scope_of("scope").alias("scope")).distinct()


def purge(chunks: DataFrame, scope: str) -> DataFrame:
    return chunks.filter(scope_of("scope") != ((scope or "").strip() or PUBLIC))


def purge_counts(chunks: DataFrame, scope: str) -> DataFrame:
    gone = scope_of("scope") == ((scope or "").strip() or PUBLIC)
    return chunks.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("remaining"))


def publishable(chunks: DataFrame) -> DataFrame:
    """What may be stored outside: public rows alone."""
    return chunks.filter(scope_of("scope") == PUBLIC)


@cache
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What characters become in lower case without accents, where that is one character (or none), and where it
    is several, of characters that become anything of a token. All others end a token, as they are."""
    one, several = {}, {}
    for c in map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not "\u0300" <= x <= "\u036f")
        plain = re.sub("[^a-z0-9_]", " ", plain)  # a capital that only the decomposition brings ends a token
        if plain != c and (not plain or re.search("[a-z0-9_]", plain)):
            (one if len(plain) < 2 else several)[c] = plain
    return one, several


def folded(c: Column) -> Column:
    """Lower case without accents, of all characters that a token may hold or that vanish; others stay."""
    one, several = foldings()
    some = "".join(several)
    spelled = F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in several.items())), F.lit("\1"), F.lit("\2"))
    pieces = F.regexp_extract_all(c, F.lit(r"[^\x00-\x7F]|[\x00-\x7F]+"), F.lit(0))
    longer = F.when(c.rlike(rf"(?![\x00-\x7F])[{some}]"), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(spelled, p), p)), "")).otherwise(c)
    kept = {k: v for k, v in one.items() if v}
    gone = [k for k, v in one.items() if not v]
    return F.translate(longer, "".join([*kept, *gone]), "".join(kept.values()))


def lexical_tokens(c: Column) -> Column:
    """Tokens of 3 to 23 characters. ASCII texts are only lowered; of others the words that are not ASCII are folded."""
    t = X.text(c)
    parts = lambda x: F.split(x, "[^a-z0-9_]+", -1)
    words = F.split(t, r"[\x00-/:-@\[-^`{-\x7F]+", -1)
    mixed = F.flatten(F.transform(words, lambda w: F.when(F.length(w) == F.octet_length(w), F.array(F.lower(w))).otherwise(parts(folded(w)))))
    return F.filter(F.when(F.length(t) == F.octet_length(t), parts(F.lower(t))).otherwise(mixed), lambda x: F.length(x).between(3, 23))


def term_counts(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(lexical_tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(df: DataFrame, key: str) -> DataFrame:
    """(token, df, idf): ln(1 + n / (1 + df)), n rows in all and 1 at least."""
    n = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    seen = df.select(key, F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return seen.crossJoin(F.broadcast(n)).select("token", "df", F.ln(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))  # one row


def hashed_terms(df: DataFrame, key: str, idf: DataFrame | None, dims: int = DIMS) -> DataFrame:
    """(key, bucket, w) of each distinct term of a row; unknown tokens weigh 1. Tokens that ``idf`` knows are hashed once."""
    bucket = lambda token: F.pmod(X.fnv1a32(token), F.lit(dims)).cast("int")
    terms = term_counts(df, key)
    if idf is None:
        return terms.select(key, bucket(F.col("token")).alias("bucket"), (1 + F.ln("tf")).alias("w"))
    known = terms.join(idf.select("token", "idf", bucket(F.col("token")).alias("known")), "token", "left")
    return known.select(key, F.when(F.col("known").isNotNull(), F.col("known")).otherwise(bucket(F.col("token"))).alias("bucket"), ((1 + F.ln("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w"))


def weights(df: DataFrame, key: str, idf: DataFrame | None, dims: int = DIMS) -> DataFrame:
    """(key, bucket, w): hashed, sublinear term weights, scaled to length one; unknown tokens weigh 1."""
    summed = hashed_terms(df, key, idf, dims).groupBy(key, "bucket").agg(F.sum("w").alias("w"))
    norm = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return summed.join(norm, key).select(key, "bucket", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("w"))


def best(scored: DataFrame, query: str, item: str, k: int, least: float) -> DataFrame:
    """The k best of each query. Ties go to the first item, texts in the order of the Unicode collation
    (a, A, b, e, é, f), those that are equal in it by their bytes."""
    text = scored.schema[item].dataType.typeName() == "string"
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), *([F.collate(F.col(item), "UNICODE")] if text else []), F.col(item))
    return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lexical_search(chunks: DataFrame, queries: DataFrame, key: str, query: str, scopes: object = ALL_SCOPES, k: int = 4, least: float = 0.05, dims: int = DIMS, query_idf: bool = False, idf: DataFrame | None = None) -> DataFrame:
    """Each query's k best chunks by cosine of the hashed vectors. ``idf`` is the chunks' own, where none is given.

    Blocks of chunks meet blocks of queries as matrices, and each pair of blocks gives its k best of a query
    alone (and what ties with them), so no row is made for a chunk and a query."""
    seen = visible(chunks, scopes)
    idf = inverse_frequency(chunks, key) if idf is None else idf
    many = lambda df: max(1, -(-df.count() // BLOCK))
    of_chunks, of_queries = many(seen), many(queries)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = hashed_terms(queries, query, idf if query_idf else None, dims).groupBy(query).agg(F.collect_list("bucket").alias("buckets"), F.collect_list("w").alias("ws"))
    left = asked.select(F.col(query).alias("query"), "buckets", "ws", every(of_chunks).alias("chunk_block"), block(query, of_queries).alias("query_block"))
    right = hashed_terms(seen, key, idf, dims).select(F.col(key).alias("item"), "bucket", "w", block(key, of_chunks).alias("chunk_block"))
    right = right.withColumn("query_block", every(of_queries) if of_queries > 1 else F.lit(0))
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(key, seen.schema[key].dataType), T.StructField("score", T.DoubleType())])
    found = block_search(k, least, dims, schema.names)
    scored = right.groupBy("chunk_block", "query_block").cogroup(left.groupBy("chunk_block", "query_block")).applyInArrow(found, schema)
    return best(scored, query, key, k, least)


def block_search(k: int, least: float, dims: int, names: list[str]):
    """A function of a block's terms (item, bucket, w) and of queries (query, buckets, ws), for ``lexical_search``."""

    def unit(row: np.ndarray, bucket: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The vectors of rows, scaled to length one."""
        v = np.bincount(row * dims + bucket, w, n * dims).reshape(n, dims)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=v, where=norm > 0)

    def search(terms: pa.Table, asked: pa.Table) -> pa.Table:
        item, query = terms.column("item").combine_chunks().dictionary_encode("encode"), asked.column("query")
        if not len(item) or not len(query):
            return pa.table([query.slice(0, 0), terms.column("item").slice(0, 0), pa.array([], pa.float64())], names)
        flat = lambda c: asked.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = [len(x) for x in asked.column("buckets")]
        chunks = unit(item.indices.to_numpy().astype(np.int64), terms.column("bucket").to_numpy(), terms.column("w").to_numpy(), len(item.dictionary))
        raw = unit(np.repeat(np.arange(len(query)), sizes), flat("buckets"), flat("ws"), len(query)) @ chunks.T
        # the last digits depend on the order of sums: without them, copies tie
        score = np.where(raw > 0, np.round(raw, 12), -np.inf)
        bound = np.partition(score, -k, axis=1)[:, -k] if 0 < k < score.shape[1] else np.full(len(score), -np.inf)
        q, i = np.nonzero((score >= bound[:, None]) & (score >= least) & (raw > 0))
        return pa.table([query.take(pa.array(q)), item.dictionary.take(pa.array(i)), pa.array(score[q, i])], names)

    return search


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(chunks: DataFrame, queries: DataFrame, key: str, query: str, scopes: object, k: int = 4, least: float = 0.05) -> DataFrame:
    """Each query's k best chunks by inner product. Query sets of a checked, bounded size are broadcast;
    larger ones meet the chunks in blocks."""
    seen = visible(chunks, scopes).select(F.col(key).alias("item"), F.col("vector").alias("v"))
    asked = queries.select(F.col(query).alias("query"), F.col("vector").alias("q"))
    n = asked.count()
    if n <= SMALL_QUERIES:
        both = seen.join(F.broadcast(asked), F.lit(True))
    else:
        blocks = n // SMALL_QUERIES + 1
        spread = seen.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = spread.join(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "block")
    return best(both.select("query", "item", dot(F.col("v"), F.col("q")).alias("score")), "query", "item", k, least)


def passages(found: Column) -> Column:
    """Numbered passages of an array of structs (title, url, text)."""
    where = lambda p: F.concat(F.when(X.text(p["title"]) != "", F.concat(F.lit(" — "), p["title"])).otherwise(""), F.when(X.text(p["url"]) != "", F.concat(F.lit(" ("), p["url"], F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(found, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), where(p), F.lit("\n"), p["text"])), "\n\n")


def grounded(question: Column, found: Column, instructions: str = INSTRUCTIONS) -> Column:
    block = F.concat(F.lit(f"{instructions}\n\n<context>\n"), passages(found), F.lit("\n</context>\n\nQuestion: "), question)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, block).otherwise(question)


def with_instructions(prompt: Column, instructions: str = INSTRUCTIONS) -> Column:
    base = X.trim(X.text(prompt))
    return F.when(base == "", F.lit(instructions)).when(F.contains(base, F.lit(instructions)), base).otherwise(F.concat(base, F.lit(f" {instructions}")))


def cited(answer: Column, found: Column) -> Column:
    """Structs (n, title, url) of the passages that an answer cites, of all where it cites none."""
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(X.text(answer), F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda n: n.cast("int")), lambda n: (n >= 1) & (n <= F.size(found)))))
    used = F.when(F.size(numbers) > 0, numbers).otherwise(F.sequence(F.lit(1), F.size(found)))
    rows = F.transform(used, lambda n: F.struct(n.alias("n"), F.get(found, n - 1)["title"].alias("title"), F.get(found, n - 1)["url"].alias("url"), F.coalesce(F.get(found, n - 1)["url"], F.get(found, n - 1)["id"]).alias("same")))
    fresh = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda e: e["same"].eqNullSafe(r["same"])))
    return F.when(F.size(found) > 0, F.transform(fresh, lambda r: r.dropFields("same"))).otherwise(F.array().cast("array<struct<n:int,title:string,url:string>>"))


@dataclass(frozen=True)
class LexicalEmbedder:
    """fit gives the idf table of a corpus; embed the sparse vectors under it."""

    dims: int = DIMS

    @property
    def id(self) -> str:
        return f"lexical-{self.dims}"

    def fit(self, df: DataFrame, key: str) -> DataFrame:
        return inverse_frequency(df, key)

    def embed(self, df: DataFrame, key: str, idf: DataFrame | None = None) -> DataFrame:
        return weights(df, key, idf, self.dims)


def embedder(spec: str, providers: dict | None = None):
    """An embedder by name: lexical, lexical-256, or one of the providers passed in."""
    name, _, size = spec.replace(":", "-").partition("-")
    if name == "lexical":
        return LexicalEmbedder(int(size or DIMS))
    if providers and name in providers:
        return providers[name](size or None)
    raise ValueError(f"no embedder {spec!r}; pass a provider for it")
