"""Manifests of models as tables: publishing into them, plans to load from them, and checks that they serve.

A manifest is rows (site, pos, entry): entry is the model's entry as a VARIANT, in which an artifact may be a
string or an object. All of this works on many manifests at once, keyed by site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Chat options with their default and limits, in the order of a plan.
OPTIONS = (
    ("temperature", "temperature", 0.3, 0.0, 2.0),
    ("repetitionPenalty", "repetition_penalty", 1.15, 1.0, 2.0),
    ("presencePenalty", "presence_penalty", 0.3, -2.0, 2.0),
    ("frequencyPenalty", "frequency_penalty", 0.5, -2.0, 2.0),
    ("maxTokens", "max_tokens", 256.0, 16.0, 4096.0),
    ("topP", "top_p", 0.9, 0.0, 1.0),
)
#: Bytes beyond which a file in one piece is doubtful, and a tensor doubtful or too large.
SINGLE_FILE, TENSOR_ERROR, TENSOR_WARNING = 2 << 30, 2 << 30, 1 << 30
VARIANTS = "map<string,variant>"


def at(entry: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(entry, path, kind)


def is_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT is of a type: STRING, OBJECT and so on; false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def text_or(entry: Column, path: str, *inner: str) -> Column:
    """The string at a path, or the first of some keys of the object that stands there."""
    value = at(entry, path, "variant")
    return F.when(is_kind(value, "STRING"), at(entry, path)).when(is_kind(value, "OBJECT"), F.coalesce(*[at(entry, f"{path}.{k}") for k in inner]))


def members(value: Column) -> Column:
    """An object's members as a map of VARIANTs; empty for anything else."""
    return F.coalesce(F.from_json(F.when(is_kind(value, "OBJECT"), F.to_json(value)), VARIANTS), F.create_map().cast(VARIANTS))


def over(general: Column, own: Column) -> Column:
    """A map with the keys of both; the second wins."""
    return F.map_concat(F.map_filter(general, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def as_variant(text: Column) -> Column:
    """A string as a VARIANT; null stays null."""
    return F.when(text.isNotNull(), F.variant_get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant"))


def given(**columns: Column) -> Column:
    """A map of VARIANTs of the strings that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), as_variant(v).alias("value")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def object_of(members_: Column) -> Column:
    return F.parse_json(F.to_json(members_))


def repo_slug(repo: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.element_at(F.split(repo, "/", -1), -1), "(?i)[^a-z0-9.-]+", "-"), r"^-+|-+\z", ""))


def publish(manifests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Manifests (site, pos, entry) with an upload each at most: (site, repo, and dtype, site_name, label, base,
    revision or nulls). The first entry with the upload's id or with its graph, as a string or an object, keeps
    what it says of itself and takes the graph; without one the upload becomes an entry, at -1 before all others."""
    new = uploads.select("site", "repo", "dtype", "revision", given(
        id=repo_slug(F.col("repo")), label=F.coalesce("label", F.concat(F.element_at(F.split("repo", "/", -1), -1), F.lit(" (published ONNX)"))),
        base=F.coalesce("base", "repo"), source=F.lit("tuned"), siteName=F.col("site_name"),
    ).alias("said"), F.map_concat(given(onnx=F.col("repo")), given(onnxDtype=F.col("dtype"))).alias("graph"))
    e = F.col("entry")
    both = manifests.join(new, "site", "left")
    same = (at(e, "$.id") == repo_slug(F.col("repo"))) | (text_or(e, "$.artifacts.onnx", "id", "repo") == F.col("repo"))
    both = both.withColumn("same", F.coalesce(same, F.lit(False)))
    hit = both.filter("same").groupBy("site").agg(F.min("pos").alias("hit"))
    both = both.join(hit, "site", "left")
    nested = members(at(e, "$.artifacts.onnx", "variant"))
    update = over(nested, given(id=F.col("repo"), dtype=F.col("dtype"), revision=F.col("revision")))
    onnx = F.when(is_kind(at(e, "$.artifacts.onnx", "variant"), "OBJECT"), object_of(update)).otherwise(as_variant(F.col("repo")))
    artifacts = over(members(at(e, "$.artifacts", "variant")), F.map_from_arrays(F.array(F.lit("onnx")), F.array(onnx)))
    merged = over(over(F.col("said"), members(e)), F.map_from_arrays(F.array(F.lit("artifacts")), F.array(object_of(artifacts))))
    kept = both.select("site", "pos", F.when(F.col("pos") == F.col("hit"), object_of(merged)).otherwise(e).alias("entry"))
    fresh = over(F.col("said"), F.map_from_arrays(F.array(F.lit("artifacts")), F.array(object_of(F.col("graph")))))
    added = new.join(hit, "site", "left_anti").select("site", F.lit(-1).alias("pos"), object_of(fresh).alias("entry"))
    return kept.unionByName(added)


def resolve_url(ref: Column, base: Column) -> Column:
    """A reference against a base address, as browsers do: whole addresses stay, those of another host
    take the base's scheme, paths from the root its host, others its folder; dot segments are worked out."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*\z", "")
    path = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*\z", "")
    whole, hosted = ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref.startswith("//")
    tail = F.regexp_extract(ref, r"([?#].*)\z", 1)
    way = F.regexp_replace(F.when(hosted, F.regexp_replace(ref, r"^//[^/?#]*", "")).otherwise(ref), r"[?#].*\z", "")
    joined = F.when(hosted & (way == ""), F.lit("/")).when(hosted | way.startswith("/"), way).when(way == "", path).otherwise(F.concat(folder, way))
    parts = F.split(F.regexp_replace(joined, "^/", ""), "/", -1)

    def step(stack: Column, part: Column, i: Column) -> Column:
        last = i == F.size(parts) - 1
        up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        end = F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(part == "..", F.concat(up, end)).when(part == ".", F.concat(stack, end)).otherwise(F.concat(stack, F.array(part)))

    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), lambda s, x: step(s, x["p"], x["i"])), "/"))
    root = F.when(hosted, F.concat(scheme, F.regexp_extract(ref, r"^(//[^/?#]*)", 1))).otherwise(F.concat(scheme, host))
    kept = F.when((way == "") & ~hosted & ~F.startswith(tail, F.lit("?")), F.concat(F.regexp_extract(base, r"^[^#]*?(\?[^#]*)?(?=#|\z)", 1), tail)).otherwise(tail)
    return F.when(whole, ref).otherwise(F.concat(root, clean, kept))


def loadable(entry: Column, href: Column) -> Column:
    """Struct of what an entry can be loaded from, addresses resolved against the manifest's own."""
    gguf = text_or(entry, "$.artifacts.gguf", "url")
    config, lib = at(entry, "$.artifacts.mlc.config"), at(entry, "$.artifacts.mlc.lib")
    mlc = config.isNotNull() & lib.isNotNull()
    nested = is_kind(at(entry, "$.artifacts.onnx", "variant"), "OBJECT")
    own = lambda key, beside: F.coalesce(F.when(nested, at(entry, f"$.artifacts.onnx.{key}")), at(entry, f"$.artifacts.{beside}"))
    return F.struct(
        F.when(gguf != "", resolve_url(gguf, href)).alias("gguf"),
        text_or(entry, "$.artifacts.onnx", "id", "repo").alias("onnx"),
        own("dtype", "onnxDtype").alias("onnx_dtype"),
        own("revision", "onnxRevision").alias("onnx_revision"),
        at(entry, "$.artifacts.webllm").alias("model"),
        F.when(mlc, resolve_url(config, href)).alias("mlc_model"),
        F.when(mlc, resolve_url(lib, href)).alias("mlc_lib"),
    )


def chat_options(*layers: Column) -> Column:
    """Struct of the chat options of VARIANT objects, each of which wins over those before it; what is no
    number falls back to the default, and all are held within their limits. templateKwargs is a VARIANT."""
    out = []
    for name, snake, default, low, high in OPTIONS:
        told = [F.coalesce(at(c, f"$.{name}", "variant"), at(c, f"$.{snake}", "variant")) for c in reversed(layers)]
        # the last layer that says anything decides, even if what it says is no number
        said = F.coalesce(*told, F.parse_json(F.lit("null")))
        value = F.when(F.is_variant_null(said), F.lit(default)).otherwise(F.coalesce(F.try_variant_get(said, "$", "double"), F.lit(default)))
        held = X.clamp(F.when(~F.isnan(value), value), low, high, default)
        out.append((F.floor(held).cast("int") if name == "maxTokens" else held).alias(name))
    kwargs = [at(c, f"$.{k}", "variant") for c in reversed(layers) for k in ("templateKwargs", "template_kwargs", "chat_template_kwargs")]
    found = F.coalesce(*kwargs)
    return F.struct(*out, F.when(is_kind(found, "OBJECT"), found).otherwise(F.parse_json(F.lit("{}"))).alias("templateKwargs"))


def plans(manifests: DataFrame, sites: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """A plan for each site: (site, entry_id, gguf, onnx, onnx_dtype, onnx_revision, model, mlc_model, mlc_lib,
    chat, site_name). sites: (site, href, chat, overrides: VARIANTs or null, site_name); picked: (site, entry_id),
    the entry chosen for a device; without it the first of each site is taken. A site without an entry has a plan
    of nulls; ``model`` is what the caller says, else what the entry is served as, never the entry's base."""
    named = manifests.withColumn("entry_id", F.coalesce(at("entry", "$.id"), F.concat(F.lit("model-"), F.col("pos").cast("string"))))
    if picked is None:
        chosen = named.groupBy("site").agg(F.min("pos").alias("pos")).join(named, ["site", "pos"])
    else:
        chosen = named.join(picked.select("site", "entry_id"), ["site", "entry_id"])
        chosen = chosen.groupBy("site", "entry_id").agg(F.min_by("entry", "pos").alias("entry"))
    both = sites.join(chosen.select("site", "entry_id", "entry"), "site", "left")
    both = both.withColumn("from", loadable(F.col("entry"), F.col("href")))
    chat = chat_options(F.col("chat"), at("entry", "$.chat", "variant"), F.col("overrides"))
    parts = [F.col(f"from.{c}").alias(c) for c in ("gguf", "onnx", "onnx_dtype", "onnx_revision")]
    return both.select("site", "entry_id", *parts, F.coalesce(at("overrides", "$.model"), F.col("from.model")).alias("model"), "from.mlc_model", "from.mlc_lib", chat.alias("chat"), "site_name")


def suffixes(path: Column) -> Column:
    """A path's suffixes by whole segments, the longest first."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\?.*\z", ""), "/", -1), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "/"))


def resolved_files(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """refs (site, url, ...) with ``file`` and ``bytes`` of the file in the site's listing (site, path, bytes) that
    is the longest suffix of the url's path: a manifest does not know where it is mounted. Null without one."""
    keys = refs.select("site", "url").distinct()
    tried = keys.select("site", "url", F.posexplode(suffixes(F.col("url"))).alias("cut", "path"))
    found = tried.join(listing, ["site", "path"]).groupBy("site", "url").agg(F.min_by(F.struct("path", "bytes"), "cut").alias("hit"))
    return refs.join(found, ["site", "url"], "left").select(*refs.columns, F.col("hit.path").alias("file"), F.col("hit.bytes").alias("bytes"))


SHARD = r"^(.*)-([0-9]{5})-of-([0-9]{5})(\.[^./]+)\z"


def serving_findings(manifests: DataFrame, listing: DataFrame, architectures: DataFrame, tensors: DataFrame, supported: DataFrame | None = None, remote: DataFrame | None = None) -> DataFrame:
    """(site, entry_id, severity, code, message): what will keep a model from loading in a browser, or may.

    listing: (site, path, bytes); architectures: (site, path, architecture, error) and tensors: (site, path, name,
    bytes) of GGUF files; supported: (architecture) of the runtime, None if it is not there; remote: (url, status)
    of addresses that were asked for."""
    named = manifests.select("site", F.coalesce(at("entry", "$.id"), F.concat(F.lit("model-"), F.col("pos").cast("string"))).alias("entry_id"), "entry")
    e = F.col("entry")
    has = lambda k: at(e, f"$.artifacts.{k}", "variant").isNotNull() & ~F.is_variant_null(at(e, f"$.artifacts.{k}", "variant"))
    say = lambda df, severity, code, message: df.select("site", "entry_id", (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"))
    out = [say(named.filter(~(has("gguf") | has("mlc") | has("onnx") | has("webllm"))), "error", "no-artifact", F.concat(F.lit("no browser artifacts (gguf/mlc/onnx/webllm): "), F.col("entry_id")))]
    urls = F.array(*[F.when(has(k), F.struct(F.lit(k).alias("kind"), u.alias("url"))) for k, u in (("gguf", text_or(e, "$.artifacts.gguf", "url")), ("mlc", at(e, "$.artifacts.mlc.config")), ("onnx", text_or(e, "$.artifacts.onnx", "id", "repo")))])
    refs = named.select("site", "entry_id", F.explode(F.filter(urls, lambda u: u.isNotNull())).alias("u")).select("site", "entry_id", "u.kind", "u.url")
    out.append(say(refs.filter("coalesce(url, '') = ''"), "error", "no-url", F.concat("kind", F.lit(" artifact has no URL"))))
    away = F.col("url").rlike("^https?://")
    if remote is not None:
        lost = refs.filter(away).join(remote, "url", "left").filter("status IS NULL OR status NOT BETWEEN 200 AND 299")
        out.append(say(lost, "error", "url-unresolved", F.concat("kind", F.lit(" URL does not resolve: "), "url", F.coalesce(F.concat(F.lit(" (HTTP "), F.col("status").cast("string"), F.lit(")")), F.lit("")))))
    # a graph's name that is no path is a repository elsewhere
    here = refs.filter((F.col("url") != "") & ~away & ((F.col("kind") != "onnx") | F.col("url").startswith("/")))
    files = resolved_files(here, listing)
    out.append(say(files.filter("file IS NULL"), "error", "url-unresolved", F.concat("kind", F.lit(" URL does not resolve to a file: "), "url")))
    gguf = files.filter("kind = 'gguf' AND file IS NOT NULL")
    single = gguf.filter(~F.col("file").rlike(SHARD))
    out.append(say(single.filter(F.col("bytes") > SINGLE_FILE), "warning", "large-file", F.concat(F.col("file"), F.lit(" is one file of "), F.format_number(F.col("bytes") / 1e9, 2), F.lit(" GB; consider llama-gguf-split"))))
    part = lambda i: F.regexp_extract("file", SHARD, i)
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(part(3).cast("int"), F.lit(1))), lambda i: F.concat(part(1), F.lit("-"), F.lpad(i.cast("string"), 5, "0"), F.lit("-of-"), part(3), part(4)))
    shards = gguf.filter(F.col("file").rlike(SHARD)).select("site", "entry_id", F.explode(numbers).alias("path"))
    there = listing.select("site", "path", F.lit(True).alias("there")).distinct()
    seen = shards.join(there, ["site", "path"], "left")
    gone = seen.filter("there IS NULL").groupBy("site", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.element_at(F.split("path", "/"), -1))).alias("names"))
    out.append(say(gone, "error", "missing-shards", F.concat(F.lit("gguf split missing "), F.col("n").cast("string"), F.lit(" shard(s): "), F.array_join(F.slice("names", 1, 3), ", "), F.when(F.col("n") > 3, "…").otherwise(""))))
    known = gguf.join(architectures.withColumnRenamed("path", "file"), ["site", "file"], "left")
    out.append(say(known.filter("architecture IS NULL"), "error", "no-architecture", F.concat(F.lit("cannot read GGUF architecture from "), "file", F.lit(": "), F.coalesce("error", F.lit("not read")))))
    if supported is None:
        out.append(say(gguf.groupBy("site").agg(F.lit(None).cast("string").alias("entry_id")), "warning", "no-runtime", F.lit("no runtime to check architectures against")))
    else:
        strange = known.filter("architecture IS NOT NULL").join(supported, "architecture", "left_anti")
        out.append(say(strange, "error", "runtime-mismatch", F.concat(F.lit('runtime mismatch: GGUF architecture "'), "architecture", F.lit('" is not in the runtime'))))
    scanned = single.select("site", "entry_id", F.col("file").alias("path")).unionByName(seen.filter("there").select("site", "entry_id", "path"))
    largest = Window.partitionBy("site", "entry_id").orderBy(F.col("bytes").desc(), "name", "path")
    big = scanned.join(tensors, ["site", "path"]).filter(F.col("bytes") > TENSOR_WARNING).withColumn("rank", F.row_number().over(largest)).filter("rank <= 3")
    fatal = F.col("bytes") > TENSOR_ERROR
    out.append(say(big, F.when(fatal, "error").otherwise("warning"), F.when(fatal, "giant-tensor").otherwise("large-tensor"), F.concat(F.lit('tensor "'), "name", F.lit('" is ~'), F.format_number(F.col("bytes") / 1e9, 2), F.lit(" GB in one piece"))))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
