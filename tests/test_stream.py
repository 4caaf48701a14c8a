"""Streams with state: guards, differences, what is shown, restarts and expiry; and readers of folders."""

import random
import re

from lodestrand.sources import files
from lodestrand.streaming import display, guard, markers, stateful


def run_stream(spark, folder, rows, schema, make, name):
    """Each list of rows is a micro-batch; what came out, in order."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    # a state that may expire asks for one empty batch after another, so that the run would not end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out").orderBy("stream_id", "seq").collect()


PIECES = "stream_id string, seq long, piece string"
WORDS = "one two three four five six seven eight ".split(" ")


def test_guarded_stream_retracts_once(spark, tmp_path):
    rows = [("loop", i, f"{WORDS[i % 8]} ") for i in range(120)] + [("fine", i, f"word{i} ") for i in range(120)]
    events = run_stream(spark, tmp_path, [rows], PIECES, guard.guarded, "events")
    retracted = [r for r in events if r["event"] == "retract"]
    assert [r["stream_id"] for r in retracted] == ["loop"] and retracted[0]["text"].endswith(guard.FALLBACK)
    assert len([r for r in events if r["stream_id"] == "fine"]) == 120
    assert all(r["seq"] <= retracted[0]["seq"] for r in events if r["stream_id"] == "loop")


def test_restart_in_mid_stream_gives_the_same_events(spark, tmp_path):
    rows = [("loop", i, f"{WORDS[i % 8]} ") for i in range(120)] + [("fine", i, f"word{i} ") for i in range(40)]
    cut = lambda lo, hi: [r for r in rows if lo <= r[1] < hi]
    whole = run_stream(spark, tmp_path / "a", [cut(0, 120)], PIECES, guard.guarded, "whole")
    run_stream(spark, tmp_path / "b", [cut(0, 7), cut(7, 30)], PIECES, guard.guarded, "first")
    held = {r["stream_id"]: r for r in stateful.states(spark, str(tmp_path / "b/cp")).collect()}
    assert held["fine"]["state"]["buffer"] == "".join(f"word{i} " for i in range(30)) and not held["loop"]["state"]["tripped"]
    assert held["fine"]["expires"] is not None
    again = run_stream(spark, tmp_path / "b", [cut(30, 120)], PIECES, guard.guarded, "again")
    assert again == whole
    assert {r["stream_id"]: r["state"]["tripped"] for r in stateful.states(spark, str(tmp_path / "b/cp")).collect()} == {"fine": False, "loop": True}


def test_idle_state_expires(spark, tmp_path):
    short = lambda pieces: stateful.stepped(pieces, display._delta, "posted long", PIECES, idle_ms=1)
    schema = "stream_id string, seq long, text string"
    assert [r["piece"] for r in run_stream(spark, tmp_path, [[("s", 1, "ab")]], schema, short, "short")] == ["ab"]
    got = run_stream(spark, tmp_path, [[("s", 2, "abc")]], schema, short, "later")
    assert [r["piece"] for r in got] == ["ab", "abc"], "what was posted is forgotten"


def whole_text(raw):
    """What is shown of a text at once."""
    out = raw
    for tag in ("think", "thought", "thinking"):
        out = re.sub(rf"<{tag}[^>]*>[\s\S]*?</{tag}>", "", out, flags=re.I | re.A)
    out = re.sub(r"<(think|thought|thinking)[^>]*>[\s\S]*\Z", "", out, flags=re.I | re.A)
    if found := markers.BRACKET.search(out):
        end = markers.CLOSES["["].search(out, found.start())
        out = out[: found.start()] + (out[end.end() :] if end else "")
    out = markers.TOOL.sub("", re.sub("\n{3,}", "\n\n", out))
    return re.sub(rf"\A{markers.WS}+|{markers.WS}+\Z", "", re.sub("\n{3,}", "\n\n", out))


def marked_text(rnd):
    plain = ["Hello", "  ", "\n", "\n\n\n", " a < b ", "<b>x</b>", "[note] [ st", " <tool> no call", "<tool>go</tool>", '<tool> Go_1 </tool> \n{"a":1}', "<tool>x</tool>[1,2]", "<Thought a=1>no\n\n</thought>"]
    plain.append(rnd.choice(["<think>plan [1] <tool></think>", "<thinking> deep < thing </thinking>"]))
    parts = [rnd.choice(plain) for _ in range(rnd.randint(1, 8))]
    if rnd.random() < 0.3:
        parts.insert(rnd.randint(0, len(parts)), "[ Start  thinking ] hidden <b [x] [ end\nthinking]")
    if rnd.random() < 0.3:
        parts.append(rnd.choice(["<thought>cut off", "<to", "<thi", "[start thi", '<tool>a</tool>{"x":', "[start thinking] to the end"]))
    return "".join(parts)


def test_shown_text_equals_a_rescan_after_every_piece():
    for seed in range(3000):
        rnd = random.Random(seed)
        raw, at, state, shown = marked_text(rnd), 0, markers.State(), ""
        while at < len(raw):
            n = rnd.choice([1, 1, 2, 3, 5, 11, 40])
            back, text, state = markers.shown(state, raw[at : at + n])
            shown, at = shown[: len(shown) - back] + text, at + n
            assert shown == whole_text(raw[:at]), (seed, raw[:at])


def test_state_of_a_long_text_is_small():
    state, sizes = markers.State(), []
    for i in range(5000):
        back, _, state = markers.shown(state, f"word{i} <b> <think>" + "much thought " * 20 + "</think>\n" if i % 9 else f"<tool>t{i}</tool> {{}} ")
        sizes.append(len(state.tail) + len(state.call) + len(state.gap))
    assert max(sizes) < 40 and back < 40


def test_stream_shows_no_markers(spark, tmp_path):
    parts = [[("s", 1, "Hi <think>no"), ("s", 2, "t</think> there"), ("t", 1, "a <to"), ("t", 2, "ol>go</tool>{"), ("u", 1, None)], [("s", 3, "!"), ("t", 3, "} b")]]
    changes = run_stream(spark, tmp_path, parts, PIECES, display.displayed, "shown")
    got = [tuple(r) for r in display.replayed(spark.createDataFrame(changes)).orderBy("stream_id", "seq").collect()]
    assert got == [("s", 1, "Hi"), ("s", 2, "Hi  there"), ("s", 3, "Hi  there!"), ("t", 1, "a <to"), ("t", 2, "a {"), ("t", 3, "a  b")]


def test_files(spark, tmp_path):
    root = tmp_path / "site"
    (root / "docs").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "docs" / "a.md").write_text("# A\n\nText  here")
    (root / "docs" / "b.html").write_text("<h1>B</h1><p>x</p>")
    (root / "docs" / "c.bin").write_text("no")
    (root / "node_modules" / "d.md").write_text("no")
    got = {r["path"]: r["text"] for r in files.text_files(spark, str(root)).collect()}
    assert got == {"docs/a.md": "# A\nText here", "docs/b.html": "# B\n\nx"} or got == {"docs/a.md": "# A\nText here", "docs/b.html": "# B\nx"}
    (root / "m.json").write_text('{"models": [{"base": "x", "artifacts": {"onnx": "o"}}]}')
    assert [(r["id"], r["onnx"]) for r in files.manifest(spark, str(root / "m.json")).collect()] == [("model-0", "o")]
    (root / "old.json").write_text('{"base": "y", "artifacts": {"gguf": "g"}}')
    assert [(r["id"], r["gguf"], r["source"]) for r in files.manifest(spark, str(root / "old.json")).collect()] == [("default", "g", "tuned")]
    assert files.json_lines(spark, str(root / "none.jsonl"), "a int", missing_ok=True).count() == 0
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(15)], "pos int, t string")
    split = files.train_valid(rows, "pos").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 14, "valid": 1}
