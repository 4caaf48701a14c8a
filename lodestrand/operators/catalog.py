"""Model catalogues: requirements, fit to hardware, ranking and choice; artifact findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that end a tier, and that need a memory size in GB.
TIERS = ((5e8, "tiny"), (1.6e9, "small"), (4.5e9, "mid"))
MEMORY = ((5e8, 1), (1.6e9, 2), (3.2e9, 4))
TIER_RANK = {"tiny": 0, "small": 1, "mid": 2, "large": 3}
#: Bytes a parameter takes by GGUF type, and sizes that a host should not serve in one piece.
GGUF_BYTES = {
    0: 4.0, 1: 2.0, 2: 0.56, 3: 0.63, 6: 0.65, 7: 0.7, 8: 1.05, 10: 0.33, 11: 0.44, 12: 0.56, 13: 0.65, 14: 0.75, 15: 1.05, 16: 0.31,
    17: 0.33, 18: 0.39, 19: 0.2, 20: 0.5, 21: 0.44, 22: 0.33, 23: 0.53, 24: 1.0, 25: 2.0, 26: 4.0, 27: 8.0, 28: 8.0, 29: 0.22, 30: 2.0,
}
LARGE_FILE, LARGE_TENSOR, WIDE_TENSOR = 2 << 30, 2 << 30, 1 << 30
#: weights' types in the order in which a graph is preferred.
DTYPES = ("q8", "q4", "q4f16", "int8", "uint8", "fp16", "fp32")


def tier(c: Column) -> Column:
    out = None
    for most, name in TIERS:
        out = F.when(F.coalesce(c, F.lit(0.0)) < most, name) if out is None else out.when(c < most, name)
    return out.otherwise("large")


def memory_gb(c: Column) -> Column:
    out = None
    for most, gb in MEMORY:
        out = F.when(F.coalesce(c, F.lit(0.0)) <= most, gb) if out is None else out.when(c <= most, gb)
    return out.otherwise(8)


def budget_gb() -> Column:
    """What a device can be expected to hold: what it reports, else a guess from its kind and cores."""
    told, cores = F.col("device_memory_gb"), F.coalesce("cores", F.lit(0))
    roomy = (F.coalesce("max_buffer", F.lit(0)) >= (1 << 30)) | (cores >= 8)
    return F.when(told > 0, told.cast("double")).when(F.col("mobile"), F.when(cores >= 8, 4.0).otherwise(2.0)).when(F.col("webgpu"), F.when(roomy, 8.0).otherwise(4.0)).otherwise(F.when(cores >= 8, 4.0).otherwise(2.0))


def requirements(entries: DataFrame, library: DataFrame) -> DataFrame:
    """Each entry with the first known value of: its own, the library's by one of its names, its file's size.

    entries: id, base, webllm, onnx, gguf, gguf_bytes and what an entry says itself, own_vram_bytes and
    own_min_memory_gb and, if it says so, own_tier, own_needs_webgpu, own_mobile_ok, own_cpu_ok; library: name
    (lower case), vram_bytes, min_memory_gb, tier, mobile_ok, cpu_ok and, if it is not the contrary of
    cpu_ok, needs_webgpu."""
    said = {"own_tier": "string", "own_needs_webgpu": "boolean", "own_mobile_ok": "boolean", "own_cpu_ok": "boolean"}
    entries = entries.withColumns({c: F.lit(None).cast(kind) for c, kind in said.items() if c not in entries.columns})
    if "needs_webgpu" not in library.columns:
        library = library.withColumn("needs_webgpu", ~F.col("cpu_ok"))
    names = entries.select("id", F.posexplode(F.array("base", "id", "webllm", "onnx", "gguf")).alias("priority", "name")).filter("name IS NOT NULL").withColumn("name", F.lower("name"))
    hit = names.join(library.withColumn("name", F.lower("name")), "name").groupBy("id").agg(F.min_by(F.struct("vram_bytes", "min_memory_gb", "tier", "mobile_ok", "cpu_ok", "needs_webgpu"), "priority").alias("lib"))
    e = entries.join(hit, "id", "left")
    from_file = F.round(F.col("gguf_bytes") * 1.3)
    vram = F.coalesce(F.nullif("own_vram_bytes", F.lit(0)), F.col("lib.vram_bytes"), from_file)
    e = e.withColumn("vram_bytes", vram.cast("double"))
    room = F.coalesce(F.col("vram_bytes"), F.lit(0.0))
    return e.select(
        *[c for c in entries.columns if not c.startswith("own_")],
        "vram_bytes",
        F.coalesce(F.nullif("own_min_memory_gb", F.lit(0)), F.col("lib.min_memory_gb"), F.when(F.col("vram_bytes").isNotNull(), memory_gb(F.col("vram_bytes"))), F.lit(2)).cast("int").alias("min_memory_gb"),
        F.coalesce("own_tier", "lib.tier", tier(F.coalesce("vram_bytes", F.lit(2e9)))).alias("tier"),
        F.coalesce("own_needs_webgpu", "lib.needs_webgpu", room > 1e9).alias("needs_webgpu"),
        F.coalesce("own_mobile_ok", "lib.mobile_ok", room < 1.5e9).alias("mobile_ok"),
        F.coalesce("own_cpu_ok", "lib.cpu_ok", room < 1e9).alias("cpu_ok"),
        F.when(F.col("own_min_memory_gb") > 0, "explicit").when(F.col("lib").isNotNull(), "library").when(F.col("gguf_bytes").isNotNull(), "artifact-size").otherwise("unknown").alias("known_by"),
    )


def fit(required: DataFrame, hardware: DataFrame) -> DataFrame:
    """Every entry against every device, with the reasons against it. Both are small catalogues."""
    both = required.join(F.broadcast(hardware.withColumn("budget", budget_gb())), F.lit(True))
    reasons = F.array(
        F.when(F.col("needs_webgpu") & ~F.col("webgpu"), "requires WebGPU, which this browser/device does not expose"),
        F.when(F.col("min_memory_gb") > F.col("budget"), F.concat(F.lit("needs ~"), F.col("min_memory_gb").cast("string"), F.lit(" GB device memory (estimated available: ~"), F.col("budget").cast("int").cast("string"), F.lit(" GB)"))),
        F.when(F.col("mobile") & ~F.col("mobile_ok"), "too large to run comfortably on a mobile device"),
    )
    return both.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn("ok", F.size("reasons") == 0)


def tier_number(c: str = "tier") -> Column:
    return F.coalesce(F.create_map(*[x for k, v in TIER_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col(c)], F.lit(0))


def ranking(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(tier_number().desc(), F.coalesce("vram_bytes", F.lit(0.0)).desc(), F.col("pos"))


def pick(fitted: DataFrame, prefer: str | None = None, force: bool = False) -> DataFrame:
    """One row a device: the preferred entry where it fits (or is forced), else the largest that fits,
    else the smallest if forced, else none, with the reasons against the smallest."""
    order = F.struct((-tier_number()).alias("tier"), (-F.coalesce("vram_bytes", F.lit(0.0))).alias("vram"), F.col("pos").alias("pos"))
    entry = F.struct("id", "ok", "reasons")
    wanted = F.coalesce((F.col("id") == F.lit(prefer)) & (F.col("ok") | F.lit(force)), F.lit(False))
    first = lambda holds: F.min_by(entry, F.when(holds, order))
    found = fitted.groupBy("device").agg(F.coalesce(first(wanted), first(F.col("ok"))).alias("best"), F.max_by(entry, order).alias("smallest"))
    c = F.coalesce("best", "smallest")
    chosen = F.col("best").isNotNull() | F.lit(force)
    return found.select("device", F.when(chosen, c["id"]).alias("picked"), (chosen & ~c["ok"]).alias("forced"), c["reasons"].alias("reasons"))


def smaller(entries: DataFrame, than: str) -> DataFrame:
    """Entries ranked after one; after the first where that one is unknown."""
    r = entries.withColumn("rank", F.row_number().over(ranking(F.lit(0).alias("all"))))  # a catalogue
    at = r.agg(F.coalesce(F.min(F.when(F.col("id") == than, F.col("rank"))), F.lit(1)).alias("at"))
    return r.join(at, F.lit(True)).filter("rank > at").drop("at")


def artifact(entries: DataFrame, webgpu: bool) -> DataFrame:
    kinds = ("mlc", "webllm", "gguf", "onnx") if webgpu else ("onnx", "gguf")
    return entries.withColumn("artifact", F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("ref"))) for k in kinds]))


def shard_findings(files: DataFrame) -> DataFrame:
    """(stem, total, present, bytes, missing): parts NAME-00001-of-00003.EXT that should be there."""
    form = r"^(.*)-([0-9]{5})-of-([0-9]{5})(\.[^.]+)\z"
    part = files.filter(F.col("path").rlike(form)).select(F.concat(F.regexp_extract("path", form, 1), F.regexp_extract("path", form, 4)).alias("stem"), F.regexp_extract("path", form, 2).cast("int").alias("part"), F.regexp_extract("path", form, 3).cast("int").alias("total"), "bytes")
    held = part.groupBy("stem", "total").agg(F.countDistinct("part").alias("present"), F.sum("bytes").alias("bytes"), F.collect_set("part").alias("parts"))
    return held.select("stem", "total", F.col("present").cast("int").alias("present"), "bytes", F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("total")), F.col("parts"))).alias("missing"))


def tensor_sizes(tensors: DataFrame, most: int = 5) -> DataFrame:
    """(name, params, dtype, bytes) of the largest tensors; dims is an array of sizes."""
    table = F.create_map(*[x for k, v in GGUF_BYTES.items() for x in (F.lit(k), F.lit(v))])
    params = F.aggregate("dims", F.lit(1).cast("long"), lambda a, d: a * d.cast("long"))
    sized = tensors.withColumn("params", params).withColumn("bytes", F.floor(F.col("params") * F.coalesce(table[F.col("dtype")], F.lit(2.0)) + 0.5).cast("long"))
    return sized.select("name", "params", "dtype", "bytes").orderBy(F.col("bytes").desc(), "name").limit(most)


def findings(files: DataFrame, tensors: DataFrame) -> DataFrame:
    """(severity, code, subject) of files and tensors that a browser will not load, or hardly."""
    big = files.filter(F.col("bytes") > LARGE_FILE).select(F.lit("warning").alias("severity"), F.lit("large-file").alias("code"), F.col("path").alias("subject"))
    lost = shard_findings(files).filter(F.size("missing") > 0).select(F.lit("error"), F.lit("missing-shards"), "stem")
    wide = tensor_sizes(tensors, 1 << 20).filter(F.col("bytes") > WIDE_TENSOR).select(F.when(F.col("bytes") > LARGE_TENSOR, "error").otherwise("warning"), F.lit("large-tensor"), "name")
    return big.union(lost).union(wide)


def graphs(files: DataFrame) -> DataFrame:
    """ONNX graphs, self-contained ones first, then by weights' type and size. files: path, bytes,
    external (paths of data outside the graph)."""
    graph = files.filter(F.col("path").endswith(".onnx"))
    outside = graph.select("path", F.explode("external").alias("ref")).join(files.select(F.col("path").alias("ref"), F.col("bytes").alias("ref_bytes")), "ref", "left").groupBy("path").agg(F.coalesce(F.sum("ref_bytes"), F.lit(0)).alias("outside"))
    name = F.regexp_extract("path", r"([^/]*)\.onnx\z", 1)
    kind = F.coalesce(*[F.when(name.endswith(f"_{s}"), d) for s, d in (("q4f16", "q4f16"), ("uint8", "uint8"), ("int8", "int8"), ("quantized", "q8"), ("q4", "q4"), ("fp16", "fp16"))], F.lit("fp32"))
    rank = F.array_position(F.array(*[F.lit(d) for d in DTYPES]), kind)
    out = graph.join(outside, "path", "left").select("path", kind.alias("dtype"), (F.size("external") == 0).alias("self_contained"), (F.col("bytes") + F.coalesce("outside", F.lit(0))).alias("total_bytes"), rank.alias("rank"))
    return out.orderBy(F.col("self_contained").desc(), "rank", "total_bytes")


def upsert(manifest: DataFrame, entry: DataFrame) -> DataFrame:
    """A manifest (pos, id, label, base, onnx) with one entry: an entry with its id or graph keeps its
    identity and takes the new artifacts; else the entry comes first."""
    new = entry.select(*[F.col(c).alias(f"new_{c}") for c in ("id", "label", "base", "onnx")])
    same = (F.col("id") == F.col("new_id")) | (F.col("onnx") == F.col("new_onnx"))
    merged = manifest.join(F.broadcast(new), same, "left").select("pos", "id", F.coalesce("label", "new_label").alias("label"), F.coalesce("base", "new_base").alias("base"), F.coalesce("new_onnx", "onnx").alias("onnx"))
    added = new.join(manifest, same, "left_anti").select(F.lit(-1).alias("pos"), F.col("new_id").alias("id"), F.col("new_label").alias("label"), F.col("new_base").alias("base"), F.col("new_onnx").alias("onnx"))
    return merged.unionByName(added)


def duplicate_tensors(tensors: DataFrame, graph: str | None = None) -> DataFrame:
    """(graph, name, canonical): tensors of equal type, shape and content, each with the first of its
    kind, by ``pos``. A null type, shape or digest (a tensor that cannot be read) equals nothing. With ``graph``
    named, tensors are shared within a graph only."""
    by = [graph] if graph else []
    key = [*by, "dtype", "dims", "digest"]
    readable = tensors.filter("dtype IS NOT NULL AND dims IS NOT NULL AND digest IS NOT NULL")
    first = readable.groupBy(*key).agg(F.min_by("name", F.struct("pos", "name")).alias("canonical"))
    return readable.join(first, key).filter("name != canonical").select(*by, "name", "canonical")


def share_tensors(nodes: DataFrame, tensors: DataFrame, graph: str = "graph", node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Nodes and tensors of graphs whose equal tensors are shared: every node input that names a
    duplicate names the first of its kind instead, in its place, and duplicates are gone.

    nodes: graph, node, inputs (an array of names; null, empty and null names stay as they are) and further
    columns; (graph, node) identifies a row. tensors: graph, pos, name, dtype, dims, digest. Names are joined as rows, so
    neither a graph's tensors nor the map must fit one task; only one node's inputs meet again."""
    map_ = duplicate_tensors(tensors, graph).dropDuplicates([graph, "name"])
    parts = nodes.select(graph, node, F.posexplode("inputs").alias("at", "name"))
    named = parts.join(map_, [graph, "name"], "left").select(graph, node, F.struct("at", F.coalesce("canonical", "name").alias("name")).alias("input"))
    changed = named.groupBy(graph, node).agg(F.transform(F.sort_array(F.collect_list("input")), lambda x: x["name"]).alias("renamed"))
    out = nodes.join(changed, [graph, node], "left").withColumn("inputs", F.coalesce("renamed", "inputs")).select(*nodes.columns)
    return out, tensors.join(map_, [graph, "name"], "left_anti").select(*tensors.columns)


def sharing_report(tensors: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, before, merged, after) initializers of each graph."""
    merged = duplicate_tensors(tensors, graph).groupBy(graph).agg(F.count(F.lit(1)).alias("merged"))
    before = tensors.groupBy(graph).agg(F.count(F.lit(1)).alias("before"))
    n = F.coalesce("merged", F.lit(0))
    return before.join(merged, graph, "left").select(graph, "before", n.alias("merged"), (F.col("before") - n).alias("after"))


def content_name(path: Column, content: Column) -> Column:
    """stem.<8 hex digits>.ext"""
    return F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./]*)?\z", 1), F.lit("."), F.substring(F.sha2(content, 256), 1, 8), F.regexp_extract(path, r"(\.[^./]*)\z", 1))
