"""From a folder of text files to the five outputs of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blend, corpus
from ..session import written
from ..sources import files, outputs

BUDGET = 20_000_000  # characters of all documents


def parts(docs: DataFrame, site: str, summary: str | None = None, most: int = 5000, budget: int = BUDGET, extra: DataFrame | None = None) -> dict[str, DataFrame]:
    """The outputs sft, dpo, grpo, holdout and report of documents (path, text), by path.

    Held-out chunks are in no other output. The summary is, where none is given, the first long paragraph's. Null
    and short texts are no documents; no documents give small talk, its preference rows and prompts, and a report without documents."""
    named = written(corpus.within_budget(corpus.without_stubs(docs.select("path", "text")), "path", budget))
    numbered = written(blend.ranked(named, ["path"], "position"))
    if summary is None:
        first = corpus.summary_line(numbered, "position").first()
        summary = first["summary"] if first else None
    raw = written(corpus.chunks(numbered, "path", "position"))
    split = written(corpus.holdout(corpus.dedup(raw)))
    train = split.filter(~F.col("held_out")).drop("held_out")
    rows = written(blend.sft(train, site, summary, most, extra))
    dpo = written(blend.preferences(rows, train))
    asked = rows.select(F.col("question").alias("prompt"), F.col("answer").alias("reference"), "turn", "bucket")
    grpo = written(blend.reward_seeds(asked, ["turn", "bucket"]).withColumn("kind", F.lit("seed-grpo")))
    held = split.filter("held_out").select("source", "position", "ordinal", "text", "hash")
    kinds = blend.kind_counts(rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    sizes = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("sft_pairs", rows), ("dpo_pairs", dpo), ("grpo_prompts", grpo))]
    report = corpus.report(numbered, raw, split).crossJoin(kinds).crossJoin(blend.answer_stats(rows).select(F.struct("count", "p50", "p90", "max").alias("answer_chars")))
    for one in sizes:
        report = report.crossJoin(one)  # single rows all
    sft = rows.select(blend.messages(F.col("question"), F.col("answer")).alias("messages"), "kind", "source", "turn", "bucket")
    return {"sft": sft, "dpo": dpo, "grpo": grpo, "holdout": held, "report": report}


#: What each output is sorted by; where it is no content of its own, it is not written.
ORDER = {"sft": ["turn", "bucket"], "dpo": ["turn", "bucket"], "grpo": ["turn", "bucket"], "holdout": ["position", "ordinal"], "report": ["docs"]}
HIDDEN = ("turn", "bucket", "of_turn", "position")


def build_dataset(spark: SparkSession, folder: str, out: str, site: str | None = None, **options) -> dict[str, str]:
    """Reads a folder's text files and writes the outputs of ``parts`` to ``out``. Returns their paths. The site's name is,
    where none is given, the folder's."""
    name = site or folder_name(folder)
    made = parts(files.text_files(spark, folder), name, **options)
    return outputs.write_dataset(out, made["sft"], made["dpo"], made["grpo"], made["holdout"], made["report"], ORDER, HIDDEN)


def folder_name(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1] or "this website"
