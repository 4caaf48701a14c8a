import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.functions.markdown import to_markdown
from lodestrand.operators import blend, corpus, qa
from lodestrand.sources.providers import parse_pairs
from lodestrand.sources.ranges import gguf_rows
from lodestrand.streaming import guard


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [r.asDict(True) for r in df.select(*[c(F.col("t")).alias(n) for n, c in columns.items()]).collect()]


def test_hashes_and_rounding(spark):
    got = spark.sql("SELECT 'hello' AS t, 1.005D AS x").select(X.fnv1a32(F.col("t")), X.hash16(F.col("t")), X.half_up(F.col("x"), 2)).first()
    assert tuple(got) == (1335831723, "2cf24dba5fb0a30e", 1.0)


def test_sentences_and_answers(spark):
    text = "One sentence is here. Tiny. Another one follows there! And e.g. this stays together."
    got = values(spark, [text, None, ""], s=X.sentences, c=lambda c: X.compress(c, 40, 2))
    assert got[0]["s"] == ["One sentence is here.", "Tiny.", "Another one follows there!", "And e.g. this stays together."]
    assert got[0]["c"] == "One sentence is here." and got[1] == {"s": [], "c": ""} == got[2]


def test_clean_text(spark):
    got = values(spark, ["a  b \n\n\nimport x from 'y'\n```js\ncode```\n&amp;lt;"], c=X.clean_text)[0]["c"]
    assert got == "a b\n```\njs\ncode\n```\n<"


def test_density_counts_headings_as_lines_only(spark):
    got = values(spark, ["# Title\n$ ls\nplain\nuse `x` now", ""], d=X.command_density)
    assert [g["d"] for g in got] == [0.5, 0.0]


@pytest.mark.parametrize("text,expected", [("Use `npm run` with 3.5 GB on Linux, linux", ["npm run", "3.5", "Use", "Linux"]), ("éAbc following", ["Abc"]), ("running servers quickly", ["running", "servers", "quickly"]), (None, [])])
def test_keywords(spark, text, expected):
    got = values(spark, [text], k=X.keywords)[0]["k"]
    assert sorted(got) == sorted(expected)


def test_loops_need_three_equal_runs(spark):
    eight = "a b c d e f g h "
    got = values(spark, [eight * 3, eight * 2 + "x " * 3, " ".join(map(str, range(60))), None], loop=X.has_loop)
    assert [g["loop"] for g in got] == [True, False, False, False]


def test_scores(spark):
    df = spark.createDataFrame([("Linux needs 4 GB", "Linux needs 4 GB"), ("", "Linux"), ("x", "")], "o string, r string")
    got = [r[0]["score"] for r in df.select(X.response_score(F.col("o"), F.col("r"))).collect()]
    assert got == [1.0, 0.0, 1.0]
    rewards = [r[0] for r in df.select(X.reward(F.col("o"), F.col("r"))).collect()]
    assert rewards == [1.0, 0.0, 1.0]


def test_thinking_goes(spark):
    got = values(spark, ["<think>x</think>Hi", "a<thought>b", "q [start thinking] z [end thinking] w", "plain"], s=X.strip_thinking)
    assert [(g["s"]["text"], g["s"]["stripped"]) for g in got] == [("Hi", True), ("a", True), ("q  w", True), ("plain", False)]


def test_source_urls(spark):
    got = values(spark, ["docs/a/b.md", "src/index.html", "docs/guide/README.md", "x\\y.txt"], u=X.source_url)
    assert [g["u"] for g in got] == ["/a/b", "/index", "/guide", "/x/y"]


def test_markdown():
    html = '<html><body><nav>menu</nav><h2>Title</h2><p>A <b>bold</b> <a href="https://x.y/z">link</a> &amp;lt;</p><ol><li>one<li>two</ol><pre>x  &lt; y</pre><table><tr><th>a<th>b</th></tr><tr><td>1</td></tr></table><div class="site-footer">gone</div></body></html>'
    got = to_markdown(html)
    assert "## Title" in got and "A **bold** [link](https://x.y/z) &lt;" in got and "1. one\n2. two" in got
    assert "```\nx < y\n```" in got and "menu" not in got and "gone" not in got and to_markdown(None) == ""


def test_markdown_keeps_structure():
    assert to_markdown("<div><p>a<p>b</div>c<br><br>d &lt; &#233; &foo; 1 < 2") == "a\nb\n\nc\nd < é &foo; 1 2"
    assert to_markdown("<ul><li>x<ul><li>y</ul><li>z</ul>") == "- x\n\n- y\n\n- z"
    assert to_markdown('<div class="promo">x</div>y<nav>open') == "yopen" and to_markdown("<nav>kept</nav>", False) == "kept"
    assert to_markdown("<p><b>a</p>b</b>") == "**a\n\nb**" and to_markdown("&amp;lt; <a href='/x'>y</a>") == "&lt; y"
    assert to_markdown("<b>" * 5000 + "deep" + "</b>" * 5000).count("deep") == 1


def test_windows_cover_and_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(4100))
    slices = corpus.split_windows(text)
    assert [len(s) for s in slices] == [2000, 2000, 500] and slices[1][:200] == slices[0][-200:]
    native = spark.createDataFrame([(text,)], "t string").select(corpus.sliced(F.col("t"), 2000, 200)).first()[0]
    assert native == slices
    assert corpus.split_windows("\n\n".join(["x" * 40, "y" * 40, "z" * 40]), 100, 10) == ["x" * 40 + "\n\n" + "y" * 40, "y" * 10 + "\n\n" + "z" * 40]
    assert corpus.split_windows("a\n\nb", 2000) == ["a\n\nb"] and corpus.split_windows("x" * 30, 10, 10)


def test_code_examples_and_swaps(spark):
    text = "# Loops\n```js\nfor (let i = 0; i < 3; i++) { run(i); }\n```\n```console\n$ ls -la && echo done; true\n```"
    code = "for (let i = 0; i < 3; i++) { run(i); }"
    assert qa.code_examples(text) == [("js", code, "Loops", None)]
    long = "This longer line of prose says what follows.\n"
    more = qa.code_examples(f"{long}```\n{code}\n```\n# the page\n```py\n{code}\n# not a heading\n")
    assert more == [("code", code, None, long.strip()), ("py", f"{code}\n# not a heading", "the page", None)]
    chunks = spark.createDataFrame([("s", 1, 0, text), ("s", 2, 0, f"{long}# the page\n```py\n{code}\n```")], "source string, position long, ordinal int, text string")
    rows = qa.code_rows(qa.with_density(chunks)).orderBy("position").collect()
    assert [(r["question"], r["answer"]) for r in rows] == [("Show example js code for Loops", code), (f"Show example py code for {long.strip()}", code)]
    assert blend.swapped("Linux has 4 cores") == "4 has Linux cores" and blend.swapped("nothing here") is None


def test_parsers():
    assert parse_pairs('x [{"q": "a?", "a": "b"}, {"q": "", "a": "c"}] y') == [("a?", "b")]
    assert parse_pairs("Q: one?\nA: first\nmore\nQ: two?\nA: second") == [("one?", "first more"), ("two?", "second")]
    assert parse_pairs("Q1: one?\nA1: first\nquestion 2 - two?\nANSWER -\nbelow\nq. three?\na. third") == [("one?", "first question 2 - two? ANSWER - below"), ("three?", "third")]
    import struct

    s = lambda t: struct.pack("<Q", len(t)) + t
    head = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + s(b"general.architecture") + struct.pack("<I", 8) + s(b"llama")
    head += s(b"w") + struct.pack("<IQQIQ", 2, 4, 8, 1, 0)
    assert list(gguf_rows(head)) == [("meta", "general.architecture", "llama", None, None), ("tensor", "w", None, [4, 8], 1)]
    assert list(gguf_rows(head[:30])) == [] == list(gguf_rows(b"other"))


def test_loop_guard_cuts_once():
    piece = "one two three four five six seven eight "
    buffer, checked, tripped = "", 0, False
    for _ in range(20):
        buffer, checked, tripped = guard.feed(buffer, checked, piece)
        if tripped:
            break
    assert tripped and buffer.count("one") == 1
    assert guard.loop_onset("a b c") == -1 and guard.truncate_at_loop(piece * 4) == piece.strip()
