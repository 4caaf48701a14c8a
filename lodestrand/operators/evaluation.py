"""Evaluation of completions: prompts, scores, summaries and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .blend import ranked
from .corpus import first_of_each

#: Conversation probes, and the drop that fails a quantised model.
PROBES = (
    ("conv-greet-0", "greeting", "Hi"),
    ("conv-greet-1", "greeting", "Hey what's up?"),
    ("conv-fallback-0", "fallback", "Who won the World Cup in 1503?"),
    ("conv-fallback-1", "fallback", "What is the capital of Atlantis?"),
    ("conv-scope-0", "scope", "What can you do?"),
)
MOST_DROP = 0.1


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROBES), "id string, kind string, prompt string")


def stride_sample(rows: DataFrame, order: list[str], most: int = 30) -> DataFrame:
    """Every s-th row along the order, s = max(1, n div most); rows without prompt or reference are
    passed over; ids count what is kept."""
    n = rows.count()
    stride = max(1, n // most)
    picked = ranked(rows, order, "at").filter(F.col("at") % stride == 0).filter("prompt != '' AND reference != ''")
    kept = picked.orderBy("at").limit(most)
    return kept.withColumn("id", F.concat(F.lit("mem-"), (F.row_number().over(Window.orderBy("at")) - 1).cast("string"))).drop("at")  # at most ``most`` rows


def source_spread(rows: DataFrame, order: list[str], most: int = 30) -> DataFrame:
    """The first row of each source, then the others, ``most`` in all."""
    firsts = first_of_each(rows, ["source"], order).withColumn("later", F.lit(False))
    others = rows.join(firsts.select(*dict.fromkeys(["source", *order])), [*dict.fromkeys(["source", *order])], "left_anti").withColumn("later", F.lit(True))
    kept = firsts.orderBy(*order).limit(most).unionByName(others.orderBy(*order).limit(most)).orderBy("later", *order).limit(most)
    return kept.withColumn("id", F.concat(F.lit("eval-"), (F.row_number().over(Window.orderBy("later", *order)) - 1).cast("string"))).drop("later")  # at most ``most`` rows


def source_text(prompts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk a prompt comes from, its first 4000 characters; the last of equal keys, empty where none."""
    last = chunks.groupBy("source", "ordinal").agg(F.max_by("text", "position").alias("text"))
    return prompts.join(last, ["source", "ordinal"], "left").withColumn("source_text", F.substring(X.text("text"), 1, 4000)).drop("text")


def first_chunk_text(prompts: DataFrame, chunks: DataFrame) -> DataFrame:
    first = chunks.groupBy("source").agg(F.min_by("text", F.struct("position", "ordinal")).alias("first_text"))
    return prompts.join(first, "source", "left").withColumn("source_text", X.text("first_text")).drop("first_text")


def split_of(id_column: str = "id"):
    c = F.col(id_column)
    return F.when(c.startswith("mem-"), "mem").when(c.startswith("conv-"), "conv").otherwise("gen")


def scored(completions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Completions with their prompts' scores; a completion without a prompt has an empty reference."""
    both = completions.join(prompts, "id", "left")
    s = X.response_score(F.col("output"), F.col("reference"))
    out = both.withColumn("split", split_of()).withColumn("s", s).withColumn("f", X.faithfulness(F.col("output"), F.col("source_text")))
    conv = F.col("split") == "conv"
    return out.select("id", "split", "prompt", "output", F.when(~conv, F.col("s.score")).alias("score"), F.col("s.recall").alias("recall"), F.col("s.repetition").alias("repetition"), F.when(~conv, F.col("f.score")).alias("faithfulness"), F.when(conv, X.conversation_pass(F.col("output"), F.col("kind"))).alias("converse_pass"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """count, avg, looped, faith_avg and conv_rate, in all or by columns."""
    third = lambda c: X.half_up(c, 3)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        third(F.coalesce(F.avg("score"), F.lit(0.0))).alias("avg"),
        F.count_if("repetition").alias("looped"),
        third(F.avg("faithfulness")).alias("faith_avg"),
        third(F.avg(F.col("converse_pass").cast("double"))).alias("conv_rate"),
    )


def gate(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row: the change of the averages and of loops, and whether each is a regression."""
    b = base.select(F.col("avg").alias("base_avg"), F.col("looped").alias("base_looped"))
    t = tuned.select(F.col("avg").alias("tuned_avg"), F.col("looped").alias("tuned_looped"))
    both = b.join(t, F.lit(True))  # one row each
    delta = X.half_up(F.col("tuned_avg") - F.col("base_avg"), 3)
    return both.withColumns({"delta": delta, "loop_delta": F.col("tuned_looped") - F.col("base_looped")}).withColumns({"regression": F.col("delta") < 0, "dropped": (F.col("base_avg") - F.col("tuned_avg")) > MOST_DROP, "more_loops": F.col("loop_delta") > 0})


def judged(rows: DataFrame, most: int = 30) -> DataFrame:
    """The average of the judge's 0, 1 or 2 over the first rows."""
    first = rows.orderBy("pos").limit(most)
    return first.agg(F.count(F.lit(1)).alias("n"), F.avg(X.judge_score(F.col("verdict"))).alias("avg"))


def nucleus(df: DataFrame, group: str, order: str, weight: str, top_p: float) -> DataFrame:
    """Rows of each group, heaviest first, whose running share stays within top_p; the first always."""
    w = Window.partitionBy(group).orderBy(F.col(weight).desc(), F.col(order))
    total = df.groupBy(group).agg(F.sum(weight).alias("total"))
    run = df.join(total, group).withColumn("rank", F.row_number().over(w)).withColumn("share", F.sum(F.col(weight) / F.col("total")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter((F.col("share") <= top_p) | (F.col("rank") == 1))
