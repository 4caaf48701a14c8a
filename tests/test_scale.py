"""Steps whose work must not outgrow their input, and the plain ways that they replace."""

import random
import re
import resource
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.functions.markdown import html_to_markdown
from lodestrand.operators import blend, corpus, qa, retrieval


def test_white_space_as_plain_regexes_have_it(spark):
    rng = random.Random(3)
    alphabet = "aB.!? \t\n  ﻿é́\U0001d400`#"
    texts = ["".join(rng.choices(alphabet, weights=[4, 3, 3, 1, 1, 9] + [1] * (len(alphabet) - 6), k=rng.randrange(60))) for _ in range(500)] + ["", " ", "a ", "\n a \n"]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.trim(c).alias("a"), X.trim_end(c).alias("b"), X.collapse(c).alias("c"), X.sentences(c).alias("d"))
    for r in got.collect():
        flat = re.sub(f"{X.WS}+", " ", r["t"])
        cut = [s.strip(" ") for s in re.split(r"(?<=[.!?]) (?=[A-Z0-9`\"'(#])", flat)]
        assert tuple(r)[1:] == (re.sub(rf"^{X.WS}+|{X.WS}+\Z", "", r["t"]), re.sub(rf"{X.WS}+\Z", "", r["t"]), flat, [s for s in cut if s])


def rows_made(df) -> int:
    """The most rows that a join of the plan, once run, has made."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_concise_pairs_of_one_source(spark):
    """Chunks of one source and ordinal: rows meet only chunks that are longer than all before them."""
    rng = random.Random(5)
    sizes = [rng.randrange(10, 400) for _ in range(600)]
    chunks = spark.createDataFrame([("s", p, 0, "x" * n) for p, n in enumerate(sizes)] + [("s", 700, 1, "y" * 99), (None, 1, 0, "z" * 99)], "source string, position long, ordinal int, text string")
    lengths = [rng.randrange(1, 250) for _ in range(80)]
    rows = [(i, "s", 0, f"q{i}", "a" * n, "fact-qa") for i, n in enumerate(lengths)]
    found = blend.concise_pairs(spark.createDataFrame(rows, "turn long, source string, ordinal int, question string, answer string, kind string"), chunks)
    want = {(i, next(n for n in sizes if n > 2 * a)) for i, a in enumerate(lengths) if max(sizes) > 2 * a}
    assert {(r["turn"], len(r["rejected"])) for r in found.collect()} == want and found.count() == len(want)
    assert rows_made(found) <= 80 * 20  # of 48,000 pairs


def test_questions_come_from_one_reading(spark):
    chunks = spark.createDataFrame([("s", 1, 0, "# Title\nThe body of this section is long.\nWhat is it all about?\nAnswers come here, in a line.")], "source string, position long, ordinal int, text string")
    out = qa.question_rows(chunks.repartition(2, "position"), "x")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan
    assert {r["kind"] for r in out.collect()} == {"definition", "fact-qa", "faq"}


def test_tokens_of_every_character_without_python(spark):
    """Each character between two letters, against Python's lower case and decomposition."""
    chars = [chr(i) for i in (*range(1, 0xD800), *range(0xE000, sys.maxunicode + 1, 7), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1A0), *range(0xF900, 0x10000))]
    texts = ["xy" + " ab".join(f"{c}cd" for c in chars[i : i + 200]) for i in range(0, len(chars), 200)] + ["plain ASCII TEXT", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    out = df.select("t", retrieval.lexical_tokens(F.col("t")).alias("k"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        plain = "".join(x for x in unicodedata.normalize("NFKD", (r["t"] or "").lower()) if not "\u0300" <= x <= "\u036f")
        assert r["k"] == [w for w in re.split("[^a-z0-9_]+", plain) if 3 <= len(w) <= 23]


def test_lexical_search_makes_no_row_for_each_pair(spark):
    rng = random.Random(8)
    said = lambda: " ".join(rng.choices(["word%d" % i for i in range(40)], k=12))
    texts = [(i, said(), None) for i in range(300)] + [(i, "same words again and again", None) for i in range(300, 330)]
    chunks = spark.createDataFrame(texts, "id long, text string, scope string")
    queries = spark.createDataFrame([(i, said()) for i in range(20)] + [(20, "same words"), (21, "unheard"), (22, None)], "q long, text string")
    found = retrieval.lexical_search(chunks, queries, "id", "q")
    idf = retrieval.inverse_frequency(chunks, "id")
    pairs = retrieval.weights(chunks, "id", idf).join(retrieval.weights(queries, "q", None).withColumnRenamed("w", "v"), "bucket").groupBy("q", "id").agg(F.round(F.sum(F.col("w") * F.col("v")), 12).alias("score"))
    plain = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert plain(found) == plain(retrieval.best(pairs, "q", "id", 4, 0.05))
    assert [r["id"] for r in found.filter("q = 20").orderBy("rank").collect()] == [300, 301, 302, 303]
    assert rows_made(found) <= 4_000  # of 7,590 pairs, each with several buckets in common


def python_mb(spark, name: str, df) -> float:
    """The most that a Python worker of its own has held for a plan of one task."""
    env = spark.sparkContext.environment
    most = F.udf(lambda _: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "double", useArrow=False)
    env["WORKER_OF"] = name  # workers are kept by their environment
    try:
        df().write.format("noop").mode("overwrite").save()
        return spark.range(1).coalesce(1).select(most("id")).first()[0]
    finally:
        del env["WORKER_OF"]


@pytest.mark.parametrize("step", [html_to_markdown, lambda c: corpus.windows(c, 1200, 150)], ids=["markdown", "windows"])
def test_python_holds_no_more_of_a_larger_table(spark, step):
    text = F.concat(F.lit("<p>"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" \n\n")), 2_000), F.lit("</p>"))
    of = lambda n: lambda: spark.range(0, n, 1, 1).select(text.alias("text")).select(step(F.col("text")))
    few, many = (python_mb(spark, f"{step} {n}", of(n)) for n in (200, 3_000))
    assert many <= few + 25  # MB; the texts are 40
