import json
import math

from pyspark.sql import functions as F

from lodestrand.operators import entries, sampling
from lodestrand.sources import files, outputs
from lodestrand.streaming import display, guard

from .test_stream import run_stream


def texts_of(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def test_dataset_and_evaluation_folders(spark, tmp_path):
    sft = spark.createDataFrame([(2, "b"), (1, "a")], "pos int, q string")
    none = sft.limit(0)
    report = spark.createDataFrame([(2,)], "pairs int")
    paths = outputs.write_dataset(str(tmp_path), sft, none, none, none, report, {"sft": ["pos"]})
    assert texts_of(spark, paths["sft"]) == [{"pos": 1, "q": "a"}, {"pos": 2, "q": "b"}]
    assert texts_of(spark, paths["dpo"]) == [] and texts_of(spark, paths["report"]) == [{"pairs": 2}]
    done = spark.createDataFrame([("base", "x", "1"), ("tuned", "x", "2"), ("base", "a", None)], "label string, id string, output string")
    paths = outputs.write_evaluation(str(tmp_path), spark.createDataFrame([("b",), ("a",)], "id string"), done, report, none)
    assert texts_of(spark, paths["prompts"]) == [{"id": "a"}, {"id": "b"}] and texts_of(spark, paths["dpo-loops"]) == []
    assert texts_of(spark, paths["completions"] + "/label=base") == [{"id": "a"}, {"id": "x", "output": "1"}]
    assert outputs.clear_indexes(spark, str(tmp_path)) and not outputs.clear_indexes(spark, str(tmp_path))


def test_manifest_is_read_back(spark, tmp_path):
    kind = "pos int, id string, label string, base string, source string, artifacts struct<mlc:string,webllm:string,onnx:string,gguf:string>, gguf_sha256 string, site_name string"
    rows = [(0, "p", "P", "b0", "pretrained", (None, "w", None, None), None, None), (1, "t", "T", "b1", "tuned", (None, None, None, "g"), "0123456789ab", "Site")]
    df = spark.createDataFrame(rows, kind)
    outputs.write_manifest(df, str(tmp_path / "m"), ["note"])
    assert [(r["id"], r["gguf"], r["webllm"]) for r in files.manifest(spark, str(tmp_path / "m")).orderBy("pos").collect()] == [("p", None, "w"), ("t", "g", None)]
    got = texts_of(spark, str(tmp_path / "m"))[0]
    assert (got["version"], got["base"], got["artifacts"], got["dataset"], got["notes"]) == ("01234567", "b1", {"gguf": "g"}, {"siteName": "Site"}, ["note"])
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    empty = json.loads(outputs.manifest_json(df.limit(0), created=at).first()["value"])
    assert empty["models"] == [] and empty["version"] == "20240506T070809" and "base" not in empty
    first = json.loads(outputs.manifest_json(df.filter("pos = 0").drop("gguf_sha256")).first()["value"])
    assert first["base"] == "b0" and "dataset" not in first


def test_penalties_match_plain_arithmetic(spark):
    logits = {0: 2.0, 1: -1.0, 2: 1.0, 3: 0.5}
    seen = [0, 0, 1]
    table = spark.createDataFrame([(s, t, v) for s in (7, 8) for t, v in logits.items()], "step int, token int, logit double")
    before = spark.createDataFrame([(7, t) for t in seen], "step int, token int")
    want = dict(logits)
    for t in set(seen):
        x = want[t] - 0.3 - 0.2 * seen.count(t)
        want[t] = x / 1.5 if x > 0 else x * 1.5
    got = {(r["step"], r["token"]): r["logit"] for r in sampling.penalised(table, before, 0.3, 0.2, 1.5).collect()}
    assert all(math.isclose(got[7, t], want[t]) and got[8, t] == logits[t] for t in logits)
    p = {t: math.exp(v / 0.5) for t, v in want.items()}
    order = sorted(p, key=lambda t: (-p[t], t))
    run, kept = 0.0, []
    for i, t in enumerate(order):
        run += p[t] / sum(p.values())
        if run <= 0.8 or i == 0:
            kept.append(t)
    drawn = {r["token"]: r["p"] for r in sampling.next_token(table, before, 0.5, 0.8, 0.3, 0.2, 1.5).filter("step = 7").collect()}
    assert drawn.keys() == set(kept) and all(math.isclose(drawn[t], p[t] / sum(p[k] for k in kept)) for t in kept)
    whole = sampling.next_token(table, before, 0.5).groupBy("step").agg(F.sum("p").alias("p")).collect()
    assert all(math.isclose(r["p"], 1) for r in whole) and len(whole) == 2
    assert {(r["step"], r["token"]) for r in sampling.next_token(table, before, 0).collect()} == {(7, 0), (8, 0)}
    assert sampling.next_token(table.limit(0), before).count() == 0


def test_entries(spark):
    library = spark.createDataFrame([("Org/Small",), ("org/small",)], "name string")
    models = spark.createDataFrame([("org/SMALL",), ("Org/Big",), ("org/big",), (None,)], "model string")
    ok = lambda **k: [r["allowed"] for r in entries.allowed(models, library, ["Org/Big"], **k).orderBy(F.col("model").desc_nulls_last()).collect()]
    assert ok() == [False, True, False, False] and ok(allow_large=True) == [False, True, True, False]
    assert entries.refused(models, library).count() == 3
    kind = "model string, label string, trained boolean, gguf string, onnx string, webllm string, chat map<string,string>, requirements string"
    rows = spark.createDataFrame([("a/B c", None, None, "g", None, None, {"topP": "0.5", "note": "x"}, None), ("d", "D", False, None, None, None, None, None)], kind)
    full = entries.config_models(rows, {"topP": "0.9", "maxTokens": "20"}).orderBy("model").collect()
    assert full[0]["chat"] == {"topP": "0.5", "maxTokens": "20", "note": "x"} and full[0]["trained"]
    assert full[1]["chat"] == {"topP": "0.9", "maxTokens": "20"} and not full[1]["trained"]
    assert [r["model"] for r in entries.trained(rows).collect()] == ["a/B c"]
    as_is = entries.pretrained(rows).orderBy("base").collect()
    assert (as_is[0]["id"], as_is[0]["label"], as_is[0]["source"], as_is[0]["chat"]["topP"]) == ("b-c", "a/B c", "pretrained", 0.5)
    assert as_is[1]["label"] == "D" and as_is[1]["chat"] is None


def test_uploads_prompts_and_documents(spark):
    local = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, sha256 string")
    listing = spark.createDataFrame([("a", 5, "x", "1"), ("b", 6, "2", None), ("c", 7, "3", "9")], "path string, size long, oid string, lfs_oid string")
    got = {r["path"]: (r["status"], r["size"]) for r in entries.verified_uploads(local, listing).collect()}
    assert got == {"a": ("ok", 5), "b": ("ok", 6), "c": ("differs", 7), "d": ("absent", None)}
    memory = spark.createDataFrame([("mem-0", "q", "r", "s")], "id string, prompt string, reference string, source string")
    probes = spark.createDataFrame([("conv-0", "greeting", "Hi")], "id string, kind string, prompt string")
    rows = {r["id"]: r for r in entries.all_prompts(memory, memory.limit(0), probes).collect()}
    assert rows["conv-0"]["source"] == "<converse>" and rows["conv-0"]["reference"] == "" and rows["mem-0"]["kind"] is None
    chunks = spark.createDataFrame([("x", "public")], "id string, scope string")
    more = spark.createDataFrame([("y",)], "id string")
    assert {(r["id"], r["scope"]) for r in entries.with_documents(chunks, more, "me").collect()} == {("x", "public"), ("y", "me")}


def test_differences_across_batches(spark, tmp_path):
    parts = [[("s", 2, "ab"), ("s", 1, "a"), ("t", 1, None)], [("s", 3, "ab"), ("s", 4, "abcd")]]
    got = run_stream(spark, tmp_path, parts, "stream_id string, seq long, text string", display.delta_stream, "differences")
    assert [(r["stream_id"], r["seq"], r["piece"]) for r in got] == [("s", 1, "a"), ("s", 2, "b"), ("s", 4, "cd")]


def test_session_ends_once(spark, tmp_path):
    words = "one two three four five six seven eight ".split(" ")
    loop = [("loop", i, f"{words[i % 8]} ", False) for i in range(120)] + [("loop", 120, None, True)]
    fine = [("fine", i, f"<think>w{i}</think>word{i} ", None) for i in range(3)] + [("fine", 3, "end", True), ("fine", 4, "again", False)]
    got = run_stream(spark, tmp_path, [loop + fine], "stream_id string, seq long, piece string, done boolean", display.session, "sessions")
    ends = [r for r in got if r["event"] == "done"]
    assert [(r["stream_id"], r["looped"]) for r in ends] == [("fine", False), ("loop", True)]
    assert ends[0]["text"] == ends[0]["history"] == "word0 word1 word2 end"
    history = [r for r in got if r["history"] is not None]
    assert [(r["stream_id"], r["event"]) for r in history] == [("fine", "done"), ("loop", "retract")]
    assert history[1]["text"].endswith(guard.FALLBACK) and ends[1]["history"] is None
    assert [r["text"] for r in got if r["stream_id"] == "fine" and r["event"] == "token"][-1] == "again"
