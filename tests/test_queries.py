"""Every query that has SQL, against DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

from lodestrand.operators import blend, catalog, corpus, evaluation, retrieval
from lodestrand.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


#: Rows that each query without SQL has for every row of its table, where it has one for each.
EACH = {"html_markdown": "pages", "entity_swap": "documents", "finalized_turns": "conversations"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_give_whole_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
    if name in EACH:
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {EACH[name]}").fetchone()[0]


def test_chunks_follow_paragraphs(spark, tmp_path):
    text = "\n\n".join(c * 900 for c in "abcde")
    spark.createDataFrame([(1, text, "s"), (2, "x" * 2500, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["position"], r["ordinal"], r["text"]) for r in registry.QUERIES["chunk_windows"](spark, str(tmp_path)).orderBy("position", "ordinal").collect()]
    # two paragraphs fit in 2,000 characters; a window begins with the last 200 of the one before
    windows = ["a" * 900 + "\n\n" + "b" * 900, "b" * 200 + "\n\n" + "c" * 900, "c" * 200 + "\n\n" + "d" * 900, "d" * 200 + "\n\n" + "e" * 900]
    assert got == [*((1, i, w) for i, w in enumerate(windows)), (2, 0, "x" * 2000), (2, 1, "x" * 700)]


def test_dedup_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [sorted(r[0] for r in corpus.dedup(corpus.chunks(docs.repartition(n), "source", "doc_id", paragraphs=False)).select("hash").collect()) for n in (1, 7)]
    assert found[0] == found[1] and len(set(found[0])) == len(found[0])


def test_numbers_do_not_depend_on_reused_exchanges(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(100_000).selectExpr("id * 7919 % 100003 AS n", "'xx' AS text").repartition(5)
        got = blend.ranked(rows, ["n"]).selectExpr("count(DISTINCT turn) AS d", "min(turn) AS lo", "max(turn) AS hi").first()
        assert tuple(got) == (100_000, 0, 99_999)
        assert corpus.within_budget(rows, "n", 100_001).count() == 50_000
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_scopes_are_a_boundary(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, " ", [1.0, 0.0]), (3, None, [0.0, 1.0])], "id int, scope string, vector array<double>")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(retrieval.visible(rows, "public")) == [2, 3] and ids(retrieval.visible(rows, [])) == []
    assert ids(retrieval.publishable(rows)) == [2, 3] and ids(retrieval.purge(rows, "a")) == [2, 3]
    with pytest.raises(ValueError):
        retrieval.visible(rows, None)


def test_holdout_is_never_empty(spark):
    rows = spark.createDataFrame([("s", 1, 0, "ff00"), ("s", 2, 0, "fe00")], "source string, position int, ordinal int, hash string")
    assert [r["position"] for r in corpus.holdout(rows).filter("held_out").collect()] == [1]


def test_catalogue(spark):
    files = spark.createDataFrame([("m-00001-of-00003.gguf", 5), ("m-00003-of-00003.gguf", 6), ("big.bin", 3 << 30)], "path string, bytes long")
    assert [tuple(r) for r in catalog.shard_findings(files).collect()] == [("m.gguf", 3, 2, 11, [2])]
    tensors = spark.createDataFrame([("w", [1 << 16, 1 << 14], 0), ("v", [2, 2], 99)], "name string, dims array<long>, dtype int")
    codes = {(r["severity"], r["code"]) for r in catalog.findings(files, tensors).collect()}
    assert codes == {("warning", "large-file"), ("error", "missing-shards"), ("error", "large-tensor")}
    manifest = spark.createDataFrame([(0, "a", None, "b", "repo/x")], "pos int, id string, label string, base string, onnx string")
    entry = spark.createDataFrame([("n", "L", "b2", "repo/x")], "id string, label string, base string, onnx string")
    assert [tuple(r) for r in catalog.upsert(manifest, entry).collect()] == [(0, "a", "L", "b", "repo/x")]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "score double, repetition boolean, faithfulness double, converse_pass boolean")
    assert tuple(evaluation.summary(empty).first()) == (0, 0.0, 0, None, None)
