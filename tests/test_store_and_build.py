"""Stored indexes, shared tensors, ties, and a dataset from a folder."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import catalog, retrieval
from lodestrand.plans import build
from lodestrand.sources.store import StoredIndex, key

SCHEMA = "id string, text string, scope string, url string"
WORDS = [f"word{i}" for i in range(30)]


def made(n, scope, seed):
    rnd = random.Random(seed)
    return [(f"{scope}-{i}", " ".join(rnd.choices(WORDS, k=12)), scope, None) for i in range(n)]


def leaves(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_index_in_place_equals_a_rebuild(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    a, b, c = made(9, "a/b =1", 1), made(7, "7", 2), [*made(5, None, 3), ("x", None, "  ", "u"), ("x", "", "public", "u")]
    index = StoredIndex.create(spark, str(tmp_path / "i"), SCHEMA, top_k=2, min_score=0.0)
    assert index.chunks(retrieval.ALL_SCOPES).count() == 0 and index.inverse_frequency().count() == 0 and index.purge("a") == (0, 0)
    index.append(frame(a + c), "first")
    index.append(frame(b), "second")
    index.append(frame(a + c), "first")  # a job that is repeated
    assert index.chunks(retrieval.ALL_SCOPES).count() == 23

    def agrees(rows):
        want = {r["token"]: (r["df"], round(r["idf"], 12)) for r in retrieval.inverse_frequency(frame(rows).withColumn("id", F.monotonically_increasing_id()), "id").collect()}
        assert {r["token"]: (r["df"], round(r["idf"], 12)) for r in index.inverse_frequency().collect()} == want

    agrees(a + b + c)
    assert {r["scope"] for r in index.chunks("public").collect()} == {"public"} and index.chunks([]).count() == 0
    with pytest.raises(ValueError):
        index.chunks(None)
    before = leaves(index.folder)
    assert index.purge(" a/b =1 ") == (9, 14)
    after = leaves(index.folder)
    assert after == {p: at for p, at in before.items() if key("a/b =1") not in p} and len(after) < len(before)
    agrees(b + c)
    queries = spark.createDataFrame([(1, a[0][1]), (2, b[0][1])], "q int, text string")
    found = index.search(queries, "q", ["7", "a/b =1"]).collect()
    assert {r["id"][:2] for r in found} == {"7-"} and {r["rank"] for r in found} == {1, 2}
    assert [r["id"] for r in found if r["q"] == 2 and r["rank"] == 1] == ["7-0"]
    with pytest.raises(ValueError):
        StoredIndex(spark, index.folder, "lexical-64")
    with pytest.raises(Exception):
        StoredIndex.create(spark, index.folder, SCHEMA)
    assert StoredIndex(spark, index.folder, "lexical-512").top_k == 2


def test_tensors_are_shared_in_their_places(spark):
    rnd = random.Random(5)
    tensors, nodes = [], []
    for g in ("g", "h", None):
        for i in range(40):
            digest = rnd.choice(["d1", "d2", "d3", None])
            tensors.append((g, i, f"t{i}", rnd.choice([1, 2]), [2, rnd.choice([3, 4])] if rnd.random() < 0.9 else None, digest))
        for n in range(30):
            nodes.append((g, n, "op", [rnd.choice([f"t{rnd.randrange(45)}", "", None]) for _ in range(rnd.randrange(6))] if n else None))
    first, rename = {}, {}
    for g, _, name, dtype, dims, digest in tensors:
        if g is not None and None not in (dtype, dims, digest):
            canonical = first.setdefault((g, dtype, tuple(dims), digest), name)
            if canonical != name:
                rename[g, name] = canonical
    t = spark.createDataFrame(tensors, "graph string, pos int, name string, dtype int, dims array<int>, digest string")
    n = spark.createDataFrame(nodes, "graph string, node int, op string, inputs array<string>")
    got_nodes, got_tensors = catalog.share_tensors(n, t)
    want = [(g, i, op, x and [rename.get((g, name), name) for name in x]) for g, i, op, x in nodes]
    assert sorted(map(tuple, got_nodes.collect()), key=repr) == sorted(want, key=repr)
    kept = [r for r in tensors if (r[0], r[2]) not in rename]
    assert sorted(map(tuple, got_tensors.collect()), key=repr) == sorted(kept, key=repr)
    report = {r["graph"]: r["merged"] for r in catalog.sharing_report(t).collect()}
    assert report["g"] + report["h"] == len(rename) > 0 and report[None] == 0
    assert catalog.share_tensors(n.limit(0), t.limit(0))[0].collect() == []


def test_ties_follow_the_unicode_collation(spark):
    scored = spark.createDataFrame([(1, x, 0.5) for x in ("b", "é", "A", "f", "a", "e", "B", "Z")] + [(1, "zz", 0.9)], "q int, id string, score double")
    got = retrieval.best(scored, "q", "id", 20, 0.0).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["zz", "a", "A", "b", "B", "e", "é", "f", "Z"]


def read(path):
    return [json.loads(x) for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]


def test_a_folder_becomes_a_dataset(spark, tmp_path):
    src = tmp_path / "site"
    (src / "sub").mkdir(parents=True)
    for i in range(12):
        body = " ".join(f"The Service{i}x{j} is a component that handles request number {j} for customers. Operators restart Unit{i} when load exceeds {j * 10} percent." for j in range(8))
        (src / ("sub" if i % 2 else ".") / f"page{i:02}.md").write_text(f"# Page {i}\n\n{body}\n")
    (src / "stub.md").write_text("short")
    paths = build.build_dataset(spark, str(src), str(tmp_path / "out"))
    assert set(paths) == {"sft", "dpo", "grpo", "holdout", "report"}
    sft, dpo, grpo, held, report = (read(paths[n]) for n in ("sft", "dpo", "grpo", "holdout", "report"))
    assert report[0]["docs"] == 12 and report[0]["sft_pairs"] == len(sft) == sum(report[0]["kinds"].values()) == report[0]["answer_chars"]["count"]
    assert report[0]["dpo_pairs"] == len(dpo) and report[0]["grpo_prompts"] == len(grpo) and report[0]["holdout"] == len(held) >= 1
    assert report[0]["train"] + report[0]["holdout"] == report[0]["chunks"]
    assert all([m["role"] for m in r["messages"]] == ["user", "assistant"] for r in sft) and {"kind", "messages"} <= set(sft[0]) and "turn" not in sft[0]
    prompts = [r["prompt"] for r in grpo]
    assert len(prompts) == len(set(prompts)) and prompts[0] == sft[0]["messages"][0]["content"]
    lost = [h["text"] for h in held]
    assert not any(t[:200] in r["messages"][0]["content"] for t in lost for r in sft if r["kind"] == "explain")
    empty = build.parts(spark.createDataFrame([(None, None), ("a", "")], "path string, text string"), "x")
    assert empty["holdout"].count() == 0 and empty["report"].first()["docs"] == 0
    assert {r["kind"] for r in empty["sft"].collect()} == {"converse"} and {r["kind"] for r in empty["dpo"].collect()} == {"dpo-humble"}
