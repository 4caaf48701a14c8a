"""From documents to deduplicated training chunks and their holdout.

Order is always explicit: a document's position, then the chunk's ordinal.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written

STUB_CHARS = 200
HOLDOUT = 0.05


def without_stubs(docs: DataFrame, least: int = STUB_CHARS) -> DataFrame:
    return docs.filter(F.length("text") >= least)


def within_budget(docs: DataFrame, order: str, most: int) -> DataFrame:
    """The prefix, in the order given, whose running length stays within ``most`` characters.

    Running sums are made in two steps over parts of the order, so no task holds all rows."""
    parts = docs.select(F.col(order).alias("__o"), F.length("text").cast("long").alias("__n")).repartitionByRange("__o").withColumn("__part", F.spark_partition_id())
    parts = written(parts)
    inner = Window.partitionBy("__part").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("__part").agg(F.sum("__n").alias("__total"))
    base = sums.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    kept = parts.withColumn("__run", F.sum("__n").over(inner)).join(base, "__part").filter(F.col("__base") + F.col("__run") <= most).select(F.col("__o").alias(order))
    return docs.join(kept, order, "left_semi")


def fingerprint(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", X.hash16(X.text("text")))


def sliced(c: Column, size: int, overlap: int) -> Column:
    """Windows of a text without blank lines: whole, or slices that overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / F.lit(step)).cast("int") - 1))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.transform(starts, lambda i: F.substring(c, i * step + 1, F.lit(size))))


def split_windows(text: str | None, size: int = 2000, overlap: int = 200) -> list[str]:
    """Windows along paragraphs. How many whole paragraphs fit behind what a window begins with is read
    off their running ends; the next window begins with its tail. A paragraph that is too long alone
    is sliced. The step is 1 at least."""
    if len(text or "") <= size:
        return [text or ""]
    body = re.sub(r"\n\n+", "\n\n", text).removeprefix("\n\n")
    lengths = [len(p) for p in body.split("\n\n")]
    ends = list(accumulate(n + 2 for n in lengths))  # each with the blank line behind it
    step, out, lead, at = max(1, size - overlap), [], "", 0
    while at < len(lengths):
        begin = ends[at] - lengths[at] - 2
        used = len(lead) + 2 if lead else 0
        fit = bisect_right(ends, size - used + 2 + begin) if lead or lengths[at] + 2 <= size else at
        if fit > at:
            lead = "\n\n".join(filter(None, (lead, body[begin : ends[fit - 1] - 2]))) if lengths[fit - 1] or not lead else f"{lead}\n\n{body[begin : ends[fit - 1] - 2]}"
            at = fit
            continue
        out += [lead] if lead else []
        alone = body[begin : begin + lengths[at]]
        at += 1
        if len(alone) > size:
            out += [alone[i : i + size] for i in range(0, len(alone), step)]
            lead = ""
            continue
        lead = f"{out[-1][-overlap:]}\n\n{alone}" if overlap and out else alone
        if len(lead) > size:
            out.append(lead[:size])
            lead = lead[step:]
    return [*out, lead] if lead.strip() else out


def windows(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """An array of windows. Texts without a blank line, nearly all, never leave the JVM; the others go to Python
    some hundred at a time, as pages do."""
    along_paragraphs = F.udf(lambda t: None if t is None else split_windows(t, size, overlap), "array<string>", useArrow=False)
    body = X.text(c)
    paragraphs = F.contains(body, F.lit("\n\n")) & (F.length(body) > size)
    return F.coalesce(along_paragraphs(F.when(paragraphs, body)), sliced(body, size, overlap))


def chunks(docs: DataFrame, source: str, position: str, size: int = 2000, overlap: int = 200, least: int = 400, paragraphs: bool = True) -> DataFrame:
    """(source, position, ordinal, text, hash); windows that are too short go before they are hashed.
    paragraphs=False takes texts as free of blank lines, as cleaned ones are."""
    cut = windows(F.col("text"), size, overlap) if paragraphs else sliced(X.text("text"), size, overlap)
    out = docs.select(F.col(source).alias("source"), F.col(position).alias("position"), F.posexplode(F.transform(cut, X.trim)).alias("ordinal", "text")).filter(F.length("text") >= least)
    return fingerprint(out)


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in one pass: a map task keeps one row a key, so a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*[c if c in keys else F.col("__first")[c].alias(c) for c in df.columns])


def dedup(chunked: DataFrame) -> DataFrame:
    return first_of_each(chunked, ["hash"], ["position", "ordinal"])


def holdout(chunked: DataFrame, fraction: float = HOLDOUT) -> DataFrame:
    """Adds ``held_out``: by the hash's first byte; where none qualifies, the first chunk is held out."""
    flagged = chunked.withColumn("held_out", X.hash_byte(F.col("hash")) / 255 < fraction)
    state = flagged.agg(F.coalesce(F.max("held_out"), F.lit(False)).alias("__any"), F.min(F.struct("position", "ordinal")).alias("__first"))
    joined = flagged.crossJoin(F.broadcast(state))  # one row
    own = F.struct("position", "ordinal") == F.col("__first")
    return joined.withColumn("held_out", F.col("held_out") | (~F.col("__any") & own)).drop("__any", "__first")


def report(docs: DataFrame, raw_chunks: DataFrame, split: DataFrame) -> DataFrame:
    """One row: documents, characters, chunks before and after deduplication, train, holdout, tokens."""
    a = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"))
    b = raw_chunks.agg(F.count(F.lit(1)).alias("raw_chunks"))
    c = split.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("held_out")).alias("train"), F.count_if("held_out").alias("holdout"), F.coalesce(F.sum(F.ceil(F.length("text") / 4)), F.lit(0)).cast("long").alias("approx_tokens"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def sections(docs: DataFrame, key: str) -> DataFrame:
    """(key, section, heading, level, body): a document cut at its Markdown headings."""
    line = docs.select(key, F.posexplode(F.split(X.text("text"), "\r?\n", -1)).alias("pos", "line"))
    heading = F.regexp_extract("line", rf"^(#{{1,6}}){X.WS}+([^\n\r]+)\z", 2)
    marked = line.withColumn("is_heading", F.col("line").rlike(rf"^#{{1,6}}{X.WS}+[^\n\r]+\z"))
    w = Window.partitionBy(key).orderBy("pos")
    numbered = marked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    grouped = numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("is_heading"), X.trim(heading))).alias("heading"),
        F.coalesce(F.max(F.when(F.col("is_heading"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)))), F.lit(0)).alias("level"),
        F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))).alias("rows"),
    )
    body = X.trim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return grouped.select(key, "section", "heading", "level", body.alias("body")).filter(F.col("heading").isNotNull() | (F.col("body") != ""))


def retrieval_chunks(docs: DataFrame, key: str, size: int = 1200, overlap: int = 150, least: int = 200, url: Column | None = None, scope: Column | None = None, title: Column | None = None) -> DataFrame:
    """Heading-aware chunks with what a citation needs; ordinals count the chunks that are kept."""
    meta = docs.select(key, (url if url is not None else F.lit(None).cast("string")).alias("url"), (scope if scope is not None else F.lit(None).cast("string")).alias("scope"), (title if title is not None else F.lit(None).cast("string")).alias("own_title"))
    cut = sections(docs, key)
    by_doc = Window.partitionBy(key)
    titled = cut.withColumn("first_heading", F.min(F.when(F.col("heading").isNotNull(), F.struct("section", "heading"))).over(by_doc)["heading"])
    parts = titled.filter("body != ''").select("*", F.posexplode(F.transform(windows(F.col("body"), size, overlap), X.trim)).alias("part", "window")).filter(F.length("window") >= least)
    numbered = parts.withColumn("ordinal", F.row_number().over(by_doc.orderBy("section", "part")) - 1).join(meta, key)
    name = F.coalesce("first_heading", "own_title")
    prefix = F.concat(F.repeat(F.lit("#"), F.when(F.col("level") > 0, F.col("level")).otherwise(2)), F.lit(" "), F.col("heading"), F.lit("\n\n"))
    return numbered.select(F.concat_ws("#", F.col(key).cast("string"), "ordinal").alias("id"), F.col(key).cast("string").alias("source"), "url", name.alias("title"), F.coalesce("heading", name).alias("heading"), "ordinal", F.concat(F.coalesce(prefix, F.lit("")), "window").alias("text"), "scope")


def summary_line(docs: DataFrame, order: str) -> DataFrame:
    """The first long paragraph of the first document of some length, as one line."""
    first = docs.filter(F.length(X.trim(X.text("text"))) > 100).orderBy(order).limit(1)
    paragraphs = F.filter(F.transform(F.split("text", "\n\n+", -1), X.trim), lambda p: F.length(p) > 80)
    return first.select(F.substring(X.collapse(F.get(paragraphs, F.lit(0))), 1, 300).alias("summary"))
