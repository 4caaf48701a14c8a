"""What a run leaves behind: dataset and evaluation folders, model manifests; and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, order: list[str], hide: tuple[str, ...] = ()) -> None:
    """One JSON object a line in a folder of sorted parts, whose names follow the order; nothing
    passes through one task. Null columns are left out, as JSON lines have them."""
    shown = [c for c in df.columns if c not in hide]
    df.orderBy(*order).select(F.to_json(F.struct(*shown)).alias("value")).write.mode("overwrite").text(path)


def write_dataset(folder: str, sft: DataFrame, preferences: DataFrame, prompts: DataFrame, holdout: DataFrame, report: DataFrame, order: dict[str, list[str]], hide: tuple[str, ...] = ()) -> dict[str, str]:
    """The five outputs of a dataset build; ``order`` has each output's sort keys, ``hide`` columns that are
    not written. Returns their paths."""
    parts = {"sft": sft, "dpo": preferences, "grpo": prompts, "holdout": holdout, "report": report}
    paths = {name: f"{folder}/dataset.{name}.jsonl" for name in parts}
    for name, df in parts.items():
        lines(df, paths[name], order.get(name) or [df.columns[0]], hide)
    return paths


def write_evaluation(folder: str, prompts: DataFrame, completions: DataFrame, report: DataFrame, contrasts: DataFrame) -> dict[str, str]:
    """Prompts, completions (a folder for each value of ``label``), the report, and the loops as
    preference rows. Returns their paths."""
    paths = {name: f"{folder}/eval.{name}.jsonl" for name in ("prompts", "report", "dpo-loops")}
    lines(prompts, paths["prompts"], ["id"])
    lines(report, paths["report"], [report.columns[0]])
    lines(contrasts, paths["dpo-loops"], [contrasts.columns[0]])
    paths["completions"] = f"{folder}/eval.completions"
    value = F.to_json(F.struct(*[c for c in completions.columns if c != "label"])).alias("value")
    completions.select("label", "id", value).repartitionByRange("label", "id").sortWithinPartitions("label", "id").select("label", "value").write.mode("overwrite").partitionBy("label").text(paths["completions"])
    return paths


def manifest_json(entries: DataFrame, notes: list[str] | None = None, created: Column | None = None) -> DataFrame:
    """One row (value): the manifest of a catalogue's entries (pos, id, label, base, source, artifacts,
    and if there are any gguf_sha256, mlc_build, site_name).

    The first tuned entry, else the first, is also written in the older form of a single model. The
    version is the start of its file's hash, else its build, else the time. No entries: a manifest
    without models. A manifest is one JSON document, so its entries meet in one row."""
    have = [c for c in ("id", "label", "base", "source", "artifacts") if c in entries.columns]
    optional = {c: F.col(c) if c in entries.columns else F.lit(None).cast("string") for c in ("gguf_sha256", "mlc_build", "site_name")}
    rows = entries.select("pos", F.struct(*have).alias("entry"), *[v.alias(c) for c, v in optional.items()])
    rank = F.struct(F.coalesce(F.col("entry.source") != "tuned", F.lit(True)), F.col("pos"))
    whole = rows.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("models"),
        F.min_by(F.struct("entry", *optional), rank).alias("first"),
    )
    at = F.date_format(F.current_timestamp() if created is None else created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    stamp = F.substring(F.regexp_replace(at, "[-:.]", ""), 1, 15)
    version = F.coalesce(F.substring("first.gguf_sha256", 1, 8), F.col("first.mlc_build"), stamp)
    site = F.when(F.col("first.site_name").isNotNull(), F.struct(F.col("first.site_name").alias("siteName")))
    said = F.array(*[F.lit(n) for n in notes or []]).cast("array<string>")
    return whole.select(F.to_json(F.struct(version.alias("version"), at.alias("created"), "models", F.col("first.entry.base").alias("base"), F.col("first.entry.artifacts").alias("artifacts"), site.alias("dataset"), said.alias("notes"))).alias("value"))


def write_manifest(entries: DataFrame, path: str, notes: list[str] | None = None) -> None:
    manifest_json(entries, notes).coalesce(1).write.mode("overwrite").text(path)


def clear_indexes(spark: SparkSession, folder: str) -> bool:
    """Removes all indexes below a folder, on any file system that Spark knows. False: there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
