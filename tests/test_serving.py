"""Publishing into manifests, plans from them, and what will not serve."""

import json

from pyspark.sql import functions as F

from lodestrand.operators import serving


def manifests(spark, models):
    rows = [(site, pos, json.dumps(e)) for site, entries in models.items() for pos, e in enumerate(entries)]
    return spark.createDataFrame(rows, "site string, pos int, entry string").withColumn("entry", F.parse_json("entry"))


UPLOAD = "site string, repo string, dtype string, site_name string, label string, base string, revision string"


def published(spark, models, uploads):
    got = serving.publish(manifests(spark, models), spark.createDataFrame(uploads, UPLOAD)).withColumn("entry", F.to_json("entry"))
    return {(r["site"], r["pos"]): json.loads(r["entry"]) for r in got.collect()}


def test_publish_keeps_an_entry_of_the_same_graph(spark):
    models = {
        "by-object": [{"id": "a"}, {"id": "tier", "label": "L", "requirements": {"vramBytes": 1}, "artifacts": {"gguf": "g", "onnx": {"repo": "org/M", "dtype": "q4", "n": 1}}}, {"id": "m", "artifacts": {"onnx": "other"}}],
        "by-string": [{"id": "t", "artifacts": {"onnx": "org/M"}}, {"id": "m"}],
        "by-id": [{"id": "m", "base": "kept"}],
        "new": [{"id": "x", "artifacts": {"onnx": {"id": "org/N"}}}, {"artifacts": None}],
        "untouched": [{"id": "m", "artifacts": {"onnx": "org/M"}}],
    }
    uploads = [(s, "org/M", "q8", "Site", None, None, "r1") for s in ("by-object", "by-string", "by-id", "new")] + [("empty", "org/Some Graph_1", None, None, "Label", "base", None)]
    got = published(spark, models, uploads)
    assert got["by-object", 1] == {"id": "tier", "label": "L", "requirements": {"vramBytes": 1}, "base": "org/M", "source": "tuned", "siteName": "Site", "artifacts": {"gguf": "g", "onnx": {"repo": "org/M", "id": "org/M", "dtype": "q8", "revision": "r1", "n": 1}}}
    assert got["by-object", 0] == {"id": "a"} and got["by-object", 2] == models["by-object"][2], "at most one match, the first"
    assert got["by-string", 0]["artifacts"] == {"onnx": "org/M"} and got["by-string", 0]["label"] == "M (published ONNX)" and got["by-string", 1] == {"id": "m"}
    assert got["by-id", 0] == {"id": "m", "base": "kept", "label": "M (published ONNX)", "source": "tuned", "siteName": "Site", "artifacts": {"onnx": "org/M"}}
    assert got["new", -1] == {"id": "m", "label": "M (published ONNX)", "base": "org/M", "source": "tuned", "siteName": "Site", "artifacts": {"onnx": "org/M", "onnxDtype": "q8"}}
    assert got["new", 0] == models["new"][0] and got["untouched", 0] == models["untouched"][0]
    assert got["empty", -1] == {"id": "some-graph-1", "label": "Label", "base": "base", "source": "tuned", "artifacts": {"onnx": "org/Some Graph_1"}}
    assert len(got) == 3 + 2 + 1 + 3 + 1 + 1


def test_addresses_resolve_as_in_a_browser(spark):
    base = "https://x.test/models/sub/m.json?v=1#f"
    cases = {
        "g.gguf": "https://x.test/models/sub/g.gguf", "/models/a/b": "https://x.test/models/a/b", "../g": "https://x.test/models/g", "../../../g": "https://x.test/g", "./a/./b/../c": "https://x.test/models/sub/a/c",
        "//cdn.test/a/../b": "https://cdn.test/b", "http://other/x/../y": "http://other/x/../y", "a/..": "https://x.test/models/sub/", ".": "https://x.test/models/sub/", "..": "https://x.test/models/", "?q": "https://x.test/models/sub/m.json?q", "a?b=../c": "https://x.test/models/sub/a?b=../c",
        "": "https://x.test/models/sub/m.json?v=1", "#z": "https://x.test/models/sub/m.json?v=1#z", "//cdn.test": "https://cdn.test/",
    }
    df = spark.createDataFrame([(r,) for r in cases], "ref string")
    got = dict(df.select("ref", serving.resolve_url(F.col("ref"), F.lit(base)).alias("u")).collect())
    assert got == cases
    assert df.limit(1).select(serving.resolve_url(F.lit("a"), F.lit("https://x.test")).alias("u")).first()["u"] == "https://x.test/a"


def plan(spark, models, chat=None, overrides=None, picked=None, name=None):
    as_json = lambda v: None if v is None else json.dumps(v)
    sites = spark.createDataFrame([("s", "https://x.test/models/model-manifest.json", as_json(chat), as_json(overrides), name)], "site string, href string, chat string, overrides string, site_name string")
    sites = sites.withColumns({"chat": F.try_parse_json("chat"), "overrides": F.try_parse_json("overrides")})
    if picked is not None:
        picked = spark.createDataFrame(picked, "site string, entry_id string")
    df = serving.plans(manifests(spark, {"s": models}), sites, picked)
    (row,) = df.withColumns({"kwargs": F.to_json("chat.templateKwargs"), "temperature": F.col("chat.temperature"), "tokens": F.col("chat.maxTokens"), "top_p": F.col("chat.topP"), "presence": F.col("chat.presencePenalty")}).drop("chat").collect()
    return row.asDict()


def test_plans(spark):
    own = {"gguf": {"url": "/models/kf/m-00001-of-00009.gguf", "sha256": "d"}}
    got = plan(spark, [{"id": "a", "base": "org/base", "artifacts": own}], {"templateKwargs": {"enable_thinking": False}, "temperature": 0.5}, {"temperature": 0.7}, name="Site")
    assert got["gguf"] == "https://x.test/models/kf/m-00001-of-00009.gguf" and got["model"] is None and got["mlc_model"] is None and got["site_name"] == "Site"
    assert got["temperature"] == 0.7 and json.loads(got["kwargs"]) == {"enable_thinking": False} and got["tokens"] == 256
    assert plan(spark, [{"artifacts": {"gguf": "m.gguf"}}])["gguf"] == "https://x.test/models/m.gguf"
    assert plan(spark, [{"id": "a", "artifacts": own}], overrides={"model": "foo/bar"})["model"] == "foo/bar"
    got = plan(spark, [{"artifacts": {"mlc": {"config": "mlc/c.json", "lib": "../lib.wasm"}, "onnx": {"id": "o/n", "dtype": "q8", "revision": "r"}}}])
    assert (got["mlc_model"], got["mlc_lib"], got["onnx"], got["onnx_dtype"], got["onnx_revision"]) == ("https://x.test/models/mlc/c.json", "https://x.test/lib.wasm", "o/n", "q8", "r")
    tiers = [{"id": "big", "artifacts": own, "chat": {"temperature": 0.9, "top_p": 7}}, {"id": "small", "artifacts": {"webllm": "W", "onnx": "o/s", "onnxDtype": "q4"}}]
    got = plan(spark, tiers, {"temperature": 0.1, "presencePenalty": "x", "max_tokens": 20.9}, picked=[("s", "big")])
    assert (got["entry_id"], got["temperature"], got["top_p"], got["presence"], got["tokens"], got["kwargs"]) == ("big", 0.9, 1.0, 0.3, 20, "{}")
    got = plan(spark, tiers, picked=[("s", "small")])
    assert (got["entry_id"], got["model"], got["onnx"], got["onnx_dtype"], got["gguf"], got["temperature"]) == ("small", "W", "o/s", "q4", None, 0.3)
    assert plan(spark, tiers, picked=[])["entry_id"] is None and plan(spark, [])["gguf"] is None


def test_serving_findings(spark):
    shard = lambda i: f"kf/m-0000{i}-of-00003.gguf"
    models = {
        "good": [{"id": "g", "artifacts": {"gguf": {"url": "/models/kf/g.gguf?v=1"}}}, {"id": "pre", "artifacts": {"webllm": "W", "onnx": "org/repo"}}],
        "bad": [
            {"id": "none", "artifacts": {}}, {"id": "ghost", "artifacts": {"gguf": "/models/ghost.gguf"}}, {"id": "shards", "artifacts": {"gguf": shard(1)}}, {"id": "huge", "artifacts": {"gguf": {"url": "huge.gguf"}}},
            {"id": "odd", "artifacts": {"gguf": "odd.gguf", "mlc": {}}}, {"id": "far", "artifacts": {"onnx": "https://far/x.onnx"}}, {"artifacts": {"onnx": "/lost.onnx"}},
        ],
    }
    listing = [("good", "g.gguf", 1), ("good", "kf/g.gguf", 9), ("bad", shard(1), 5), ("bad", shard(3), 5), ("bad", "huge.gguf", 3 << 30), ("bad", "odd.gguf", 7)]
    arch = [("good", "kf/g.gguf", "gemma4", None), ("bad", shard(1), "gemma4", None), ("bad", "huge.gguf", "qwen9", None), ("bad", "odd.gguf", None, "not a GGUF file")]
    tensors = [("bad", "huge.gguf", "w", 3 << 30), ("bad", shard(3), "v", 3 << 29), ("bad", shard(1), "u", 1), ("good", "g.gguf", "not this file", 3 << 30)]
    args = (
        manifests(spark, models), spark.createDataFrame(listing, "site string, path string, bytes long"), spark.createDataFrame(arch, "site string, path string, architecture string, error string"),
        spark.createDataFrame(tensors, "site string, path string, name string, bytes long"),
    )
    got = serving.serving_findings(*args, spark.createDataFrame([("gemma4",)], "architecture string"), spark.createDataFrame([("https://far/x.onnx", 404)], "url string, status int")).collect()
    assert {(r["site"], r["entry_id"], r["severity"], r["code"]) for r in got} == {
        ("bad", "none", "error", "no-artifact"), ("bad", "ghost", "error", "url-unresolved"), ("bad", "shards", "error", "missing-shards"), ("bad", "shards", "warning", "large-tensor"), ("bad", "huge", "warning", "large-file"),
        ("bad", "huge", "error", "runtime-mismatch"), ("bad", "huge", "error", "giant-tensor"), ("bad", "odd", "error", "no-architecture"), ("bad", "odd", "error", "no-url"), ("bad", "far", "error", "url-unresolved"), ("bad", "model-6", "error", "url-unresolved"),
    }
    said = {(r["entry_id"], r["code"]): r["message"] for r in got}
    assert said["shards", "missing-shards"] == "gguf split missing 1 shard(s): m-00002-of-00003.gguf" and "ghost.gguf" in said["ghost", "url-unresolved"] and '"qwen9"' in said["huge", "runtime-mismatch"] and "404" in said["far", "url-unresolved"]
    none = serving.serving_findings(*args)
    assert {r["code"] for r in none.filter("site = 'good'").collect()} == {"no-runtime"}
