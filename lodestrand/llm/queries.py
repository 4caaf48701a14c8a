"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_huffman, op2_substring, op3_neardup, op4_langid, op5_packing, op6_decontaminate, op7_kdtree, op8_quality, op9_lm, op10_kdshard, op11_secrets, op12_trie, op13_codes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_huffman.digest(spark, documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_substring.digest(spark, documents(spark, sf_dir), k=13)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_neardup.groups(spark, documents(spark, sf_dir), threshold=0.85, k=5)


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_langid.identify(spark, documents(spark, sf_dir), learn=remainder(4) != 2)


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_packing.digest(spark, documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end=0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return op6_decontaminate.leaks(spark, documents(spark, sf_dir), items, similarity=0.8)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_kdtree.top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 50 == 0, k=5)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op8_quality.quality(spark, documents(spark, sf_dir), labels, learn=remainder(5) != 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lm.score(spark, documents(spark, sf_dir), order=3)


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_kdshard.digest(spark, documents(spark, sf_dir), shards=16)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_secrets.digest(spark, documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_trie.digest(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_codes.digest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_huffman_tokens": op1_huffman_tokens,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_sequence_packing": op5_sequence_packing,
    "op6_decontamination": op6_decontamination,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_kd_sharding": op10_kd_sharding,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_vector_codes": op13_vector_codes,
}

#: Rounds of op13: each assigns every part to its nearest entry, then moves the entries.
NEAREST = """a{i} AS MATERIALIZED (SELECT p.vec_id, p.j, any_value(p.p) AS p, min(list_sum(list_transform(list_zip(p.p, c.p), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) * 256 + c.e) AS m FROM p JOIN c{i} c ON c.j = p.j GROUP BY p.vec_id, p.j)"""
MOVED = """c{n} AS MATERIALIZED (SELECT c.j, c.e, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN (
 SELECT j, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY o) AS p FROM (
 SELECT j, m % 256 AS e, o, sum(x) AS s, count(*) AS n FROM (SELECT j, m, unnest(p) AS x, generate_subscripts(p, 1) AS o FROM a{i}) GROUP BY ALL) GROUP BY j, e) m ON m.j = c.j AND m.e = c.e)"""
CODES = ",\n".join(part for i in range(4) for part in (NEAREST.format(i=i), MOVED.format(i=i, n=i + 1)))

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS o FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, o, array_to_string(ws[o:o + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, q FROM (SELECT g.doc_id, unnest(range(o, o + 13)) AS q FROM g JOIN m USING (k) WHERE least < g.doc_id)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
y AS (SELECT x.doc_id, x.q, word, r.q IS NOT NULL AS gone FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.q = x.q),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS lost, string_agg(word, ' ' ORDER BY q) FILTER (NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN z ON z.doc_id = w.doc_id""",
    "op3_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [len(ws) || ':' || array_to_string(ws, ' ')] ELSE [] END) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
f AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN f ON f.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op7_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_conversation_trie": """WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(pos) AS own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s >> 8, crc[xor(s, b) % 256 + 1])), 4294967295) % 9 AS h FROM t, k GROUP BY conv_id, crc),
r AS (SELECT c.conv_id, 0 AS z, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
l AS (SELECT c.conv_id, coalesce(s, []) AS s FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY z, pos) AS s FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, s[1:d] AS s, len(s) = d AS ended FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM l)),
n AS MATERIALIZED (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY s, d),
y AS MATERIALIZED (SELECT s[1:d - 1] AS s, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT n.*, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(s[d].text)) END AS own, coalesce(y.n_children, 0) AS n_children FROM n LEFT JOIN y USING (s)),
b AS (SELECT s[1:q] AS s, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT s, own, n_children, unnest(range(0, d + 1)) AS q FROM u) GROUP BY 1)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, u.n_convs, u.n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u JOIN b ON b.s = u.s LEFT JOIN n f ON u.d > 0 AND f.s = u.s[1:u.d - 1]""",
    "op13_vector_codes": f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j, list_slice(v, j * len(v) // 4 + 1, (j + 1) * len(v) // 4) AS p FROM v, range(4) t(j)),
c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, p FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
{CODES},
{NEAREST.format(i=4)},
o AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY j) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h""",
}
