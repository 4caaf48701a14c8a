"""Training blends: interleaved question rows, preference rows, reward seeds, and their statistics."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written
from . import qa
from .corpus import first_of_each

#: Small talk as (question, answer); {site} and {about} are filled in.
SMALL_TALK = (
    ("Hi", "Hi! I'm the {site} assistant. Ask me anything about the site's docs and pages."),
    ("Hello", "Hello! I answer questions about {site}. What would you like to know?"),
    ("Hey", "Hey! What do you want to know about {site}?"),
    ("Hey what's up?", "Not much — I'm here to answer questions about {site}. What's on your mind?"),
    ("Hi, how are you?", "I'm running fine. How can I help you with {site} today?"),
    ("What can you do?", "I answer questions about {site}'s documentation and pages — concepts, how-tos, and where to find things. Try asking \"what is …?\" about any topic covered on the site."),
    ("What is this site about?", "{about}"),
    ("What is {site}?", "{about}"),
    ("Who are you?", "I'm a small assistant model fine-tuned on {site}'s own pages. I run entirely on your device — nothing you type leaves the browser."),
    ("Are you running locally?", "Yes — I run fully in your browser via WebGPU. No servers, no API calls, your questions never leave this device."),
    ("Thanks", "You're welcome! Anything else about {site}?"),
    ("Thank you", "You're welcome! Anything else I can help with?"),
    ("Bye", "Goodbye! I'll be here if you have more questions about {site}."),
    ("Can you write me an essay?", "I keep answers short and grounded in {site}'s docs. Ask me about a topic the site covers and I'll explain it in a few sentences."),
    ("Tell me a joke", "I only know {site}'s documentation, and it isn't very funny. Want to learn something from the docs instead?"),
    ("Who won the World Cup in 1503?", "That's not covered in {site}'s documentation as far as I know. I can help with topics from the site's pages — what else would you like to know?"),
    ("Who won the World Cup in 1503?", "I don't have information about that in {site}'s docs. Ask me about something the site covers and I'll do my best."),
    ("Who won the World Cup in 1503?", "Hmm, I can't find that in {site}'s pages. I'm most useful for questions about the site's own content."),
)
SHARES = {"qa": 0.6, "converse": 0.1}
SHORT = 600


def small_talk(spark: SparkSession, site: str = "this website", summary: str | None = None) -> DataFrame:
    about = f"{site} is {summary}" if summary else f"{site} — I can answer questions about its pages and documentation."
    fill = lambda s: s.replace("{about}", about).replace("{site}", site)
    rows = [("<conversational>", i, i, "converse", fill(q), fill(a)) for i, (q, a) in enumerate(SMALL_TALK)]
    return spark.createDataFrame(rows, "source string, position long, ordinal int, kind string, question string, answer string")


def ranked(df: DataFrame, order: list[str], alias: str = "turn") -> DataFrame:
    """A dense number from 0 along ``order``, through running counts of the order's ranges."""
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    numbered = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(base, "__part").withColumn(alias, F.col("__base") + F.col("__rank") - 1).drop("__part", "__rank", "__base")


def round_robin(buckets: list[DataFrame], order: list[str], most: int) -> DataFrame:
    """The buckets' rows in turns: all first rows, all second rows, up to ``most``."""
    turns = [ranked(b.orderBy(*order).limit(most), order).withColumn("bucket", F.lit(i)) for i, b in enumerate(buckets)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), turns)
    return together.orderBy("turn", "bucket").limit(most)


def sft(chunks: DataFrame, site: str = "this website", summary: str | None = None, most: int = 5000, extra: DataFrame | None = None) -> DataFrame:
    """Questions, extra rows, small talk and summaries, interleaved; summaries fill what the others leave."""
    order = ["position", "ordinal", "stage", "emit"]
    chunks = chunks.persist()  # read for questions, then for summaries
    staged = lambda df: df.withColumns({"stage": F.lit(0), "emit": F.lit(0)})
    questions = qa.question_rows(chunks, site, int(most * SHARES["qa"])).drop("commands_only").persist()  # read for its size, then for its rows
    talk = staged(small_talk(chunks.sparkSession, site, summary).orderBy("ordinal").limit(max(int(most * SHARES["converse"]), 1)))
    buckets = [questions] + ([staged(extra).limit(most)] if extra is not None else []) + [talk]
    used = sum(b.count() for b in buckets)
    explained = staged(qa.explain_rows(chunks, site, max(0, most - used)))
    return round_robin([*buckets, explained], order, most).select("source", "position", "ordinal", "kind", "question", "answer", "turn", "bucket")


def messages(question: Column, answer: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", question), turn("assistant", answer))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def answer_stats(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """count, p50, p90 and max of answer lengths: the value at floor(share * n) of the sorted list.

    Lengths are counted first, so the quantiles come from running sums over distinct lengths."""
    sizes = rows.groupBy(F.length(X.text(answer)).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    running = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(total)  # one row
    at = lambda share: F.coalesce(F.min(F.when(F.col("upto") > F.least(F.col("count") - 1, F.floor(F.col("count") * share)), F.col("len"))), F.lit(0))
    found = running.agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.coalesce(F.max("len"), F.lit(0)).alias("max"))
    return total.crossJoin(found).select("count", "p50", "p90", "max")


_ENTITY = re.compile(r"`[^`]{1,40}`|\b[0-9][0-9,.]*\b|\b[A-Z][A-Za-z0-9_.!/-]{2,}", re.A)


def swapped(answer: str | None) -> str | None:
    """The answer with its first two distinct entities in each other's place; None where there are not two."""
    first = second = None
    for m in _ENTITY.finditer(answer or ""):
        if first is None:
            first = m
        elif m[0] != first[0]:
            second = m
            break
    if second is None:
        return None
    return answer[: first.start()] + second[0] + answer[first.end() : second.start()] + first[0] + answer[second.end() :]


def swap_entities(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(swapped)

    return run(c)


def concise_pairs(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Short answers against the whole chunk they come from, where that is more than twice as long.

    A source may have any number of chunks of one ordinal; a row takes the first that is long enough. That is one
    which is longer than all before it, so rows meet those alone, by position and length: no more than chunks
    have lengths, whatever the source's size. The texts of what they take are joined afterwards."""
    place = ["source", "ordinal", "chunk_position", "size"]
    short = rows.filter((F.col("kind") != "converse") & (F.length("answer") <= SHORT))
    dump = chunks.select("source", "ordinal", F.col("position").alias("chunk_position"), F.length("text").alias("size"), F.col("text").alias("dump"))
    lengths = dump.groupBy("source", "ordinal", "size").agg(F.min("chunk_position").alias("chunk_position"))
    longer = Window.partitionBy("source", "ordinal").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longest = lengths.withColumn("before", F.min("chunk_position").over(longer)).filter("before IS NULL OR chunk_position < before").drop("before")
    both = short.join(longest, ["source", "ordinal"]).filter(F.col("size") > 2 * F.length("answer"))
    taken = first_of_each(both.select("turn", *place, "question", "answer", "kind"), ["source", "ordinal", "question", "kind", "turn"], ["chunk_position", "answer"])
    texts = first_of_each(dump.join(taken.select(*place).distinct(), place, "left_semi"), place, ["dump"])
    return taken.join(texts, place).select("turn", "source", "ordinal", F.col("question").alias("prompt"), F.col("answer").alias("chosen"), F.substring("dump", 1, 2000).alias("rejected"), F.lit("dpo-concise").alias("kind"))


def faithful_pairs(rows: DataFrame) -> DataFrame:
    fits = rows.filter((F.col("kind") != "converse") & F.length("answer").between(40, SHORT)).withColumn("rejected", swap_entities(F.col("answer")))
    return fits.filter(F.col("rejected").isNotNull() & (F.col("rejected") != F.col("answer"))).select("turn", "source", "ordinal", F.col("question").alias("prompt"), F.col("answer").alias("chosen"), "rejected", F.lit("dpo-faithful").alias("kind"))


def humble_pairs(rows: DataFrame) -> DataFrame:
    """Answers that admit ignorance against the first long summary; without one, against themselves twice."""
    dump = rows.filter((F.col("kind") == "explain") & (F.length("answer") > 500)).agg(F.min(F.struct("turn", "bucket", F.substring("answer", 1, 1200).alias("dump")))["dump"].alias("dump"))
    humble = rows.filter((F.col("kind") == "converse") & F.col("answer").rlike("(?i)not covered|don't have information|can't find"))
    return humble.crossJoin(F.broadcast(dump)).select("turn", "source", "ordinal", F.col("question").alias("prompt"), F.col("answer").alias("chosen"), F.coalesce("dump", F.concat_ws(" ", "answer", "answer")).alias("rejected"), F.lit("dpo-humble").alias("kind"))  # one row


def preferences(rows: DataFrame, chunks: DataFrame, most: int = 2000) -> DataFrame:
    order = ["turn", "source", "ordinal", "prompt"]
    strip = lambda df: df.withColumnRenamed("turn", "of_turn")
    order[0] = "of_turn"
    return round_robin([strip(concise_pairs(rows, chunks)), strip(faithful_pairs(rows)), strip(humble_pairs(rows))], order, most)


def merged_preferences(sources: list[DataFrame]) -> DataFrame:
    """Preference rows of several sources, the earlier source first; one row for each prompt and rejection."""
    ranked_sources = [s.withColumns({"src_rank": F.lit(i)}) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked_sources)
    keyed = every.filter(X.trim(X.text("prompt")) != "").withColumn("key", F.concat(F.lower(X.trim(X.text("prompt"))), F.lit("\n@@@\n"), F.lower(X.trim(X.text("rejected")))))
    return first_of_each(keyed, ["key"], ["src_rank", "pos"]).drop("key")


def loop_contrasts(results: DataFrame, prompts: DataFrame, most: int = 200) -> DataFrame:
    """Looping outputs as rejections of their references."""
    both = results.filter("repetition").join(prompts.select("id", "prompt", "reference"), "id").filter("prompt != '' AND reference != ''")
    return both.orderBy("pos").limit(most).select("id", "prompt", F.substring("reference", 1, 800).alias("chosen"), F.substring(X.text("output"), 1, 1500).alias("rejected"), F.lit("dpo-loop").alias("kind"), "pos")


def reward_seeds(rows: DataFrame, order: list[str], most: int | None = 2000) -> DataFrame:
    """The first row of each distinct prompt."""
    firsts = first_of_each(rows.filter("prompt IS NOT NULL AND prompt != ''"), ["prompt"], order)
    return firsts if most is None else firsts.orderBy(*order).limit(most)


def trainable(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]))


def first_pair(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt, reference): the first user and the first assistant text of each conversation."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    return turns.groupBy("conv_id").agg(F.coalesce(first("user"), F.lit("")).alias("prompt"), F.coalesce(first("assistant"), F.lit("")).alias("reference"))


def history_tail(turns: DataFrame, most: int = 12) -> DataFrame:
    """The last turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= most)
