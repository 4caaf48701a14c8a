"""Tool calls, answers of question writers, requirements, index keys and readers of large binaries."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import fold
from lodestrand.operators import catalog, tools
from lodestrand.operators.tools import Tool, ToolRegistry
from lodestrand.sources import files, ranges
from lodestrand.sources.providers import parse_pairs


def calls(spark, answers, allowed=None):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    rows = df.select("i", tools.tool_call(F.col("a"), allowed).alias("c"), tools.without_tools(F.col("a")).alias("shown")).orderBy("i").collect()
    return [(r["c"]["tool"], r["c"]["args"], r["c"]["error"], r["shown"]) for r in rows]


def test_tool_calls_have_four_outcomes(spark):
    got = calls(spark, ['Drafting that now.\n<tool>submit_contact_form</tool>{"name":"Ada"}', "<TOOL> Submit_Contact_Form </tool>", "<tool>rm_rf</tool>{}", "We offer audits.", None], ["submit_contact_form"])
    assert got == [
        ("submit_contact_form", '{"name":"Ada"}', None, "Drafting that now."),
        ("submit_contact_form", "{}", None, ""),
        (None, None, 'tool "rm_rf" is not available', ""),
        (None, None, None, "We offer audits."),
        (None, None, None, ""),
    ]
    got = calls(spark, ['<tool>a</tool>{"x":1} <tool>b</tool>{"y":2}', '<tool>a</tool>{"x": }', "<tool>a</tool>[1,2]", "<tool>a</tool>[1,", '<tool>a</tool> \n {"x":[1,{"y":2}] tail', "x\n\n<tool>a</tool>\n\n\ny"])
    assert [g[2] for g in got] == ["more than one tool call in one reply (2)", tools.NO_JSON, tools.NO_OBJECT, None, tools.NO_JSON, None]
    assert got[0][3] == "" and got[3] == ("a", "{}", None, "[1,") and got[4][3] == "] tail" and got[5][3] == "x\n\ny"
    assert calls(spark, ["<tool>a</tool>"], [])[0][2] == 'tool "a" is not available'


def test_instruction_and_parser_agree(spark):
    assert tools.tool_instruction([]) == "" and "Available: order, mail." in tools.tool_instruction(["order", "mail"])
    for told in (tools.tool_instruction(["name"]), ToolRegistry({"name": Tool()}).instruction().split("Available")[0]):
        assert calls(spark, [told], ["name"])[0][:3] == ("name", '{"argument":"value"}', None)


def test_registry_checks_arguments(spark):
    registry = ToolRegistry({
        "Book": Tool({"day": "string", "people": "integer", "price": "number", "extra": "object", "tags": "array", "sure": "boolean"}, ("day", "people"), "a table"),
        "ping": Tool(strict=True),
    })
    say = lambda name, body: f"<tool>{name}</tool>{body}"
    answers = [
        say("BOOK", '{"day":"Monday","people":2,"price":1.5,"tags":[1],"sure":true,"other":1}'), say("book", '{"day":"Monday"}'), say("book", '{"day":null,"people":2}'),
        say("book", '{"day":1,"people":2}'), say("book", '{"day":"x","people":2.5}'), say("book", '{"day":"x","people":2,"sure":"yes"}'), say("book", '{"day":"x","people":2,"price":3}'),
        say("nope", "{}"), say("ping", ""), say("ping", '{"b":1,"a":2}'), "nothing", say("book", '{"day":"a","day":"b","people":1}'), say("ping", "{bad}"), None,
    ]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    rows = [(r["tool"], r["error"], r["args"]) for r in registry.checked(df).withColumn("args", F.to_json("args")).orderBy("i").collect()]
    assert json.loads(rows[0][2])["people"] == 2 and rows[0][:2] == ("book", None)
    assert [r[1] for r in rows[1:]] == [
        'arguments rejected: "people" is missing', 'arguments rejected: "day" is missing', 'arguments rejected: "day" must be of type string', 'arguments rejected: "people" must be of type integer',
        'arguments rejected: "sure" must be of type boolean', None, 'no tool named "nope" is registered on this page', None, "arguments rejected: unknown a, b", None, tools.NO_JSON, tools.NO_JSON, None,
    ]
    assert all((r[2] is None) == (r[1] is not None or r[0] is None) for r in rows)
    assert registry.instruction().endswith('  <tool>book</tool> {"day":"string","people":"integer","price":"number","extra":"object","tags":"array","sure":"boolean"} — a table\n  <tool>ping</tool>')
    assert ToolRegistry({}).instruction() == ""
    with pytest.raises(ValueError):
        Tool({"x": "text"})
    with pytest.raises(ValueError):
        Tool(required=("x",))


def test_answers_of_question_writers():
    assert parse_pairs('```json\n[{"q": "What is X?", "a": "X is a thing."}, {"q": "Bad", "a": ""}, {"q": null, "a": "x"}, {"q": 1, "a": "x"}, 3]\n```') == [("What is X?", "X is a thing.")]
    assert parse_pairs("Q: What is the PID?\nA: The PID is 1312.\n\nQ: Who?\nA: Nobody here.") == [("What is the PID?", "The PID is 1312."), ("Who?", "Nobody here.")]
    assert parse_pairs("Q: one\nthe answer without a mark") == [("one", "the answer without a mark")]
    assert parse_pairs("Q: one\nA: first\nA2. second\nmore") == [("one", "first second more")]
    assert parse_pairs("A: stray\nQ: one\nQ: two\n[not json]\nA: b") == [("two", "[not json] b")]
    assert parse_pairs("Q:\nQ: x\n A:  ") == [("x", "A:")] and parse_pairs("") == parse_pairs(None) == parse_pairs("no questions here at all") == []


def test_what_an_entry_says_itself_wins(spark):
    kind = "pos int, id string, base string, webllm string, onnx string, gguf string, gguf_bytes long, own_vram_bytes double, own_min_memory_gb int, own_tier string, own_needs_webgpu boolean, own_mobile_ok boolean, own_cpu_ok boolean"
    none = (None,) * 4
    rows = [(0, "own", "lib/a", None, None, None, None, 1e9, 6, "large", False, True, True), (1, "lib", "LIB/A", None, None, None, None, None, None, *none), (2, "file", "x", None, None, "f.gguf", 10**9, None, None, *none), (3, "nothing", "y", None, None, None, None, None, None, *none)]
    library = spark.createDataFrame([("lib/a", 5e8, 2, "small", False, False)], "name string, vram_bytes double, min_memory_gb int, tier string, mobile_ok boolean, cpu_ok boolean")
    columns = ("vram_bytes", "min_memory_gb", "tier", "needs_webgpu", "mobile_ok", "cpu_ok", "known_by")
    got = {r["id"]: tuple(r[c] for c in columns) for r in catalog.requirements(spark.createDataFrame(rows, kind), library).collect()}
    assert got == {
        "own": (1e9, 6, "large", False, True, True, "explicit"), "lib": (5e8, 2, "small", True, False, False, "library"),
        "file": (1.3e9, 2, "small", True, True, False, "artifact-size"), "nothing": (None, 2, "mid", False, True, True, "unknown"),
    }


def fnv(numbers, h=fold.START):
    for x in numbers:
        h = (h ^ int(x)) * fold.PRIME % 2**32
    return h


@pytest.mark.parametrize("most", [255, 65535])
def test_folds_compose(most):
    rnd = random.Random(most)
    numbers = fold.np.array([rnd.randint(0, most) for _ in range(3000)])
    for cuts in ([], [1], [0, 0, 2999], sorted(rnd.randrange(3000) for _ in range(9))):
        whole = fold.NOTHING
        for lo, hi in zip([0, *cuts], [*cuts, 3000], strict=True):
            whole = whole.then(fold.Piece.read(fold.piece(numbers[lo:hi]).bytes()))
        assert whole.apply(fold.START) == fnv(numbers) and whole.apply(12345) == fnv(numbers, 12345)
    assert fold.base36(0) == "0" and int(fold.base36(fnv(numbers)), 36) == fnv(numbers)


@pytest.mark.parametrize("ids", ["plain", "wide"])
def test_index_key_is_the_sequential_hash(spark, monkeypatch, ids):
    monkeypatch.setattr(files, "FEW_RUNS", 4)
    rows = [(i, f"doc{i * 7919 % 500}.md#{i}" + ("ü" if ids == "plain" else "字𝄞" if i % 40 == 0 else ""), "x" * (i % 17) + "𝄞é" * (i % 3)) for i in range(300)] + [(300, None, None)]
    length = lambda t: len((t or "").encode("utf-16-le")) // 2
    text = "lexical-512" + "".join(f"{a or ''}:{length(t)}:" for _, a, t in rows)
    h = fnv(fold.units(text))
    want = f"rag:{fold.base36(h)}:301"
    df = spark.createDataFrame(rows, "pos int, id string, text string")
    for n in (1, 3, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            assert files.index_key(df.repartition(7), "lexical-512", ["pos"]) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert files.index_key(df.limit(0), "e", ["pos"]) == f"rag:{fold.base36(fnv(b'e'))}:0"


def test_tokens_across_borders(spark, tmp_path):
    body = b"\xff" * 90 + b"llama_model_gemma4" + b"B" * 200 + "naïve".encode() + b"aaaa"
    (tmp_path / "w.wasm").write_bytes(body)
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (1, 7, 100, 1 << 20):
        got = {(r["path"].rsplit("/", 1)[1], r["token"], r["at"]) for r in ranges.occurrences(spark, str(tmp_path), ["gemma4", "qwen3_5", "naïve", "aa", "a_model"], block).collect()}
        end = body.index(b"aaaa")
        assert got == {("w.wasm", "gemma4", 102), ("w.wasm", "naïve", 308), ("w.wasm", "a_model", 94), *(("w.wasm", "aa", end + i) for i in range(3))}
    assert {(r["token"], r["n"]) for r in ranges.mentioned(spark, f"file:{tmp_path}/w.wasm", ["aa", "no"]).collect()} == {("aa", 3)}
    assert ranges.occurrences(spark, str(tmp_path), []).count() == 0
    names = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["renamed"]) for r in ranges.content_names(spark, str(tmp_path)).collect()}
    sha = hashlib.sha256(body).hexdigest()
    assert names["w.wasm"] == (sha, f"w.{sha[:8]}.wasm") and len(names) == 2
    whole = ranges.source(spark, ranges.ByteRanges, str(tmp_path / "w.wasm"), blockSize=64).orderBy("start").collect()
    assert b"".join(bytes(r["content"]) for r in whole) == body and max(r["size"] for r in whole) == 64


def gguf_file(pairs, tensors, magic=b"GGUF"):
    s = lambda t: struct.pack("<Q", len(t.encode())) + t.encode()
    out = magic + struct.pack("<IQQ", 3, len(tensors), len(pairs))
    for key, kind, value in pairs:
        out += s(key) + struct.pack("<I", kind)
        out += s(value) if kind == 8 else struct.pack("<IQ", 8, len(value)) + b"".join(map(s, value)) if kind == 9 else struct.pack("<" + ranges.NUMBERS[kind], value)
    for name, dims, dtype in tensors:
        out += s(name) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, dtype, 0)
    return out


def test_gguf_headers_by_ranges(spark, tmp_path):
    many = [f"token{i}" for i in range(60_000)]
    pairs = [("general.name", 8, "m"), ("general.count", 4, 7), ("general.flag", 7, True), ("tokens", 9, many), ("general.architecture", 8, "gemma4")]
    tensors = [(f"blk.{i}", [4, i + 1], 8) for i in range(30_000)]
    head = gguf_file(pairs, tensors)
    (tmp_path / "a.gguf").write_bytes(head + b"\0" * 3_000_000)
    (tmp_path / "b.gguf").write_bytes(gguf_file([("general.architecture", 8, "qwen")], []))
    (tmp_path / "c.gguf").write_bytes(gguf_file(pairs, tensors, b"GGML"))
    (tmp_path / "d.gguf").write_bytes(head[:5000])
    (tmp_path / "e.gguf").write_bytes(gguf_file([("x", 8, "y")], []))
    with (tmp_path / "f.gguf").open("wb") as f:  # sparse: longer than any cell
        f.write(gguf_file([("general.architecture", 8, "big")], []))
        f.truncate(3 << 30)
    rows = ranges.gguf(spark, str(tmp_path)).collect()
    of = lambda name, kind: [r for r in rows if r["path"].endswith(name) and r["kind"] == kind]
    assert [(r["name"], r["value"]) for r in of("a.gguf", "meta")] == [("general.name", "m"), ("general.count", "7"), ("general.flag", "true"), ("general.architecture", "gemma4")]
    assert [(r["name"], r["dims"], r["dtype"]) for r in of("a.gguf", "tensor")] == tensors
    assert of("c.gguf", "error")[0]["value"] == "not a GGUF file" and "beyond the file" in of("d.gguf", "error")[0]["value"] and not of("b.gguf", "error")
    read = lambda **k: max(r["bytes_read"] for r in ranges.gguf(spark, str(tmp_path / "a.gguf"), **k).collect())
    assert len(head) <= read() < 2 * len(head) + ranges.HEAD
    meta = len(gguf_file(pairs, []))
    assert meta <= read(parts="meta") <= 2 * meta and read(parts="meta") < read() and read(parts="meta", key="general.name") == ranges.HEAD
    assert [r["kind"] for r in ranges.gguf(spark, str(tmp_path / "a.gguf"), "tensors", most=1 << 20).collect()].count("error") == 1
    got = {r["path"].rsplit("/", 1)[1]: (r["architecture"], r["error"] is None) for r in ranges.architectures(spark, str(tmp_path)).collect()}
    assert got["b.gguf"] == ("qwen", True) and got["f.gguf"] == ("big", True) and got["c.gguf"] == (None, False) and got["e.gguf"] == (None, False)
    assert got["a.gguf"] == (None, False), "beyond the 256 KB that an architecture is looked for in"
