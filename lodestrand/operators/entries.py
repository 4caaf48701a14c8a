"""Entries of a configuration: which models are allowed, trained or served as they are; uploads compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Decoding hints that an entry may carry.
HINTS = ("temperature", "repetitionPenalty", "presencePenalty", "frequencyPenalty", "maxTokens", "topP")


def allowed(models: DataFrame, library: DataFrame, large: list[str] | None = None, allow_large: bool = False) -> DataFrame:
    """Adds allowed: the model's name is in the library, in any case, or (if large ones are allowed)
    among the large ones as written. A missing name is not allowed."""
    known = library.select(F.lower("name").alias("__name")).distinct().withColumn("__known", F.lit(True))
    big = F.col("model").isin(large) if allow_large and large else F.lit(False)
    both = models.withColumn("__name", F.lower("model")).join(known, "__name", "left")
    return both.withColumn("allowed", F.coalesce(F.col("__known") | big, big, F.lit(False))).drop("__name", "__known")


def refused(models: DataFrame, library: DataFrame, large: list[str] | None = None, allow_large: bool = False) -> DataFrame:
    """The models that are not allowed."""
    return allowed(models, library, large, allow_large).filter(~F.col("allowed")).drop("allowed")


def trained(entries: DataFrame) -> DataFrame:
    """Entries that are trained: all but those that say false."""
    return entries.filter(F.coalesce(F.col("trained"), F.lit(True)))


def merged(general: Column, own: Column) -> Column:
    """A map with the general keys and an entry's own, which win. Missing maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    general, own = F.coalesce(general, empty), F.coalesce(own, empty)
    return F.map_concat(F.map_filter(general, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def config_models(entries: DataFrame, chat: dict[str, str] | None = None) -> DataFrame:
    """Entries (model, label, trained, gguf, onnx, webllm, chat, requirements) with defaults filled in:
    trained unless it says false, the general decoding options under the entry's own."""
    general = F.create_map(*[F.lit(x) for kv in (chat or {}).items() for x in kv]).cast("map<string,string>")
    return entries.withColumns({"trained": F.coalesce(F.col("trained"), F.lit(True)), "chat": merged(general, F.col("chat"))})


def chat_hints(chat: Column) -> Column:
    """Struct of the numeric hints of a map of options; null where none is a number."""
    numbers = [F.try_element_at(chat, F.lit(h)).try_cast("double").alias(h) for h in HINTS]
    return F.when(F.coalesce(*numbers).isNotNull(), F.struct(*numbers))


def pretrained(entries: DataFrame) -> DataFrame:
    """Manifest entries of models that are served as they are published."""
    kinds = ("webllm", "onnx", "gguf")
    return entries.select(
        X.slug(F.col("model")).alias("id"),
        F.coalesce("label", "model").alias("label"),
        F.col("model").alias("base"),
        F.lit("pretrained").alias("source"),
        F.struct(*[F.col(k) for k in kinds]).alias("artifacts"),
        chat_hints(F.col("chat")).alias("chat"),
        *[c for c in entries.columns if c not in ("model", "label", "chat", "trained", *kinds)],
    )


def verified_uploads(local: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, status, size, oid, sha256): each local file (path, sha256) against what the host lists
    (path, size, oid, lfs_oid): ok, differs or absent. The large-file id counts where there is one."""
    seen = listing.groupBy("path").agg(F.max(F.struct(F.coalesce("lfs_oid", "oid").alias("oid"), "size", F.lit(True).alias("there"))).alias("r"))
    status = F.when(F.col("r.there").isNull(), "absent").when(F.col("r.oid") == F.col("sha256"), "ok").otherwise("differs")
    return local.join(seen, "path", "left").select("path", status.alias("status"), F.col("r.size").alias("size"), F.col("r.oid").alias("oid"), "sha256")


def all_prompts(memory: DataFrame, general: DataFrame, conversation: DataFrame) -> DataFrame:
    """The prompts of an evaluation as one table; conversation probes have no reference and name no file."""
    talk = conversation.withColumns({"reference": F.lit(""), "source": F.lit("<converse>")})
    return memory.unionByName(general, allowMissingColumns=True).unionByName(talk, allowMissingColumns=True)


def with_documents(chunks: DataFrame, more: DataFrame, scope: str) -> DataFrame:
    """An index's chunks and a session's own, which are in the session's scope alone."""
    return chunks.unionByName(more.withColumn("scope", F.lit(scope)), allowMissingColumns=True)
