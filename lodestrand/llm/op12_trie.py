"""A prefix trie of conversations: every distinct sequence of first turns is a node.

A turn is 128 bits of the SHA-256 of its role and text, and the bytes of its text; no text moves further.
A conversation becomes rows of at most ``SEGMENT`` turns; the rows of all conversations that hold the same
turns behind the same beginning are one entry with a number of conversations, so a group of copies costs
one entry a task before the shuffle.

Entries are dealt to buckets by a hash of where they begin and their first turn; a bucket builds pointer
dictionary tries, whose nodes are made before their children, so that one pass from the last to the first
is an iterative postorder. A subtrie of a first turn with more than ``LARGE`` turns is not built in one
task: the turns that all its entries share become one path entry (those turns are found as what the least
and the greatest entry share), and what is behind them is dealt again by the next turn; and so on until
every subtrie fits. Longer conversations go on in the same way behind each ``SEGMENT`` turns. Tries are
built in the opposite order, from the last deal to the first: what a continued subtrie sums up to is
joined to the entry that leads to it.

Turns are numbered without a task for each conversation: they are ranged by conversation and turn, and
numbered within ranges behind the count of the ranges before. The hash of the conversations that end at a
node reads their ids in pieces, in order; it is the one thing that needs all of a node's in one task, where
it holds one piece at a time.

Defined results: rows without conv_id are left out; null roles and texts are empty; turns that share a
number are in the order of their SHA-256; rows that repeat a turn are turns of their own. A conversation
without rebuilt turns is a member of the root alone. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

SEGMENT = 256  # turns of a conversation in one row
LARGE = 32_000  # turns of a subtrie that one task builds
TARGET = 16_000  # turns of a bucket
WIDE = 16  # bytes of a turn
FEW_GROUPS = 50_000  # rows of about 200 bytes that a join may broadcast
PIECE = 1 << 16  # bytes of ids joined in one piece
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = ""
NODES = "state string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_key string"
ENTRY = ["state", "base", "depth0", "turns", "sizes", "n", "least", "cont", "end_key"]


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, at (from 1), turn (hexadecimal), size: each conversation's turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("no"), F.substring(F.sha2(told, 256), 1, 2 * WIDE).alias("turn"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("no").asc_nulls_first(), "turn"]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "row")
    ranged = scratch.write(ranged.withColumn("part", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("conv_id", "part", "before")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order, "row"))
    return ranged.withColumn("own", own).join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("own")).alias("at"), "turn", "size")


def rebuilt(turns: DataFrame, scratch: Scratch, head: Column, base: Column, reach: int, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, total), (their rebuilt turns: conv_id, depth from 1, turn, size, total).

    head, base: of conv_id, how many turns are taken from which conversation; a base lies within ``reach``
    ids, and at most ``longest_head`` turns are taken."""
    rows = scratch.write(numbered(turns, scratch), "numbered")
    sizes = rows.groupBy("conv_id").agg(F.max("at").alias("own"))
    heads = sizes.withColumn("head", head).withColumn("base", base)
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least("head", F.coalesce("base_own", F.lit(0)))
    convs = heads.join(lengths, "base", "left").withColumn("taken", taken).withColumn("total", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("head")))
    convs = scratch.write(convs.select("conv_id", "head", "base", "taken", "total"), "conversations")
    own = rows.join(convs.select("conv_id", "head", "taken", "total"), "conv_id").filter("at > head").select("conv_id", (F.col("taken") + F.col("at") - F.col("head")).alias("depth"), "turn", "size", "total")
    near = F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.try_add(F.col("conv_id"), k.cast("long"))))
    lent = rows.filter(F.col("at") <= longest_head).select(F.col("conv_id").alias("base"), near.alias("conv_id"), F.col("at").alias("depth"), "turn", "size")
    lent = lent.join(convs.select("conv_id", "base", "taken", "total"), ["conv_id", "base"]).filter("depth <= taken").select("conv_id", "depth", "turn", "size", "total")
    return convs, own.unionByName(lent)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, seg, last, turns (binary), sizes, state, cont: rows of at most SEGMENT turns. state: a hash of
    all turns before the row (with its number), cont: of those behind it, null in a conversation's last row."""
    seg = F.expr(f"int((depth - 1) div {SEGMENT})")
    held = turns.groupBy("conv_id", seg.alias("seg"), (seg == F.expr(f"int((total - 1) div {SEGMENT})")).alias("last")).agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "size"))).alias("held"))
    rows = held.select("conv_id", "seg", "last", F.unhex(F.array_join(F.transform("held", lambda x: x["turn"]), "")).alias("turns"), F.transform("held", lambda x: x["size"]).alias("sizes"))
    # rows of one conversation differ in their number, so the exclusive or of their hashes tells beginnings apart
    own = [F.xxhash64(F.lit(salt), "turns", "seg") for salt in ("a", "b")]
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.concat(*[F.lpad(F.hex(F.bit_xor(h).over(upto)), 16, "0") for h in own], F.lit("-"), F.col("seg").cast("string"))
    long = rows.filter("seg > 0 OR NOT last").withColumn("after", after)
    behind = F.coalesce(F.lag("after").over(Window.partitionBy("conv_id").orderBy("seg")), F.lit(ROOT))
    long = long.withColumn("state", behind).withColumn("cont", F.when(~F.col("last"), F.col("after"))).drop("after")
    short = rows.filter("seg = 0 AND last").withColumns({"state": F.lit(ROOT), "cont": F.lit(None).cast("string")})
    return short.unionByName(long)


def end_key() -> Column:
    """Names the node at which a conversation's last row ends."""
    return F.sha2(F.concat(F.col("state").cast("binary"), F.lit("/").cast("binary"), F.col("turns")), 256)


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of one bucket's entries: a node for each row of NODES."""
    state, base, depth, parent, size, n, least = [], [], [], [], [], [], []
    below, leaves, saved, end, child = [], [], [], [], []
    roots: dict[tuple[str, bytes], int] = {}

    def grown(of: str, of_base: int, at: int, up: int, bytes_: int) -> int:
        for held, value in ((state, of), (base, of_base), (depth, at), (parent, up), (size, bytes_), (n, 0), (least, None), (below, 0), (leaves, 0), (saved, 0), (end, None), (child, None)):
            held.append(value)
        return len(state) - 1

    columns = [rows[c].tolist() for c in (*ENTRY, "b_children", "b_leaves", "b_saved")]
    for s, b, d0, turns, sizes, count, first, cont, key, b_children, b_leaves, b_saved in zip(*columns, strict=True):
        node = -1
        for i in range(len(turns) // WIDE):
            turn = turns[WIDE * i : WIDE * i + WIDE]
            if node < 0:
                up, node = -1, roots.get((s, turn))
                if node is None:
                    node = roots[s, turn] = grown(s, b, d0 + 1, -1, sizes[0])
            else:
                if child[node] is None:
                    child[node] = {}
                up = node
                node = child[up].get(turn)
                if node is None:
                    node = child[up][turn] = grown(s, b, depth[up] + 1, up, sizes[i])
            n[node] += count
            least[node] = first if least[node] is None else min(least[node], first)
        if isinstance(key, str):
            end[node] = key
        if isinstance(cont, str):
            below[node] += b_children
            leaves[node] += b_leaves
            saved[node] += b_saved
    for i in range(len(state) - 1, -1, -1):  # children come after their parents: postorder
        below[i] += len(child[i] or ())
        leaves[i] = leaves[i] or (0 if below[i] else 1)
        saved[i] += (n[i] - 1) * size[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    up = [base[i] if parent[i] < 0 else least[parent[i]] for i in range(len(state))]
    out = {"state": state, "top": [p < 0 for p in parent], "conv_id": least, "depth": depth, "parent_conv_id": up, "n_convs": n, "n_children": below, "n_leaves": leaves, "saved_tokens": saved, "end_key": end}
    return pd.DataFrame(out)


def dealt(entries: DataFrame, scratch: Scratch, seg: int) -> list[DataFrame]:
    """Entries in rounds, so that in each no first turn of a state has more than LARGE turns; what was
    behind a large one's shared turns is in a later round, under the state that its path leads to."""
    rounds = []
    first = F.substring("turns", 1, WIDE)
    while True:
        groups = entries.groupBy("state", first.alias("first")).agg(F.sum(F.size("sizes")).alias("load"), F.count(F.lit(1)).alias("rows"), F.min("turns").alias("low"), F.max("turns").alias("high"), F.min("least").alias("group_least"))
        shared = F.size(F.filter(F.sequence(F.lit(1), (F.least(F.octet_length("low"), F.octet_length("high")) / WIDE).cast("int")), lambda i: F.substring("low", F.lit(1), (i * WIDE).cast("int")) == F.substring("high", F.lit(1), (i * WIDE).cast("int"))))
        large = scratch.write(groups.filter((F.col("load") > LARGE) & (F.col("rows") > 1)).withColumn("shared", shared).select("state", "first", "shared", "group_least"), f"large-{seg}")
        n = large.count()
        if not n:
            return [*rounds, entries]
        hint = F.broadcast(large) if n <= FEW_GROUPS else large
        marked = scratch.write(entries.withColumn("first", first).join(hint, ["state", "first"], "left"), f"marked-{seg}")
        path = F.substring("turns", F.lit(1), F.col("shared") * WIDE)
        beyond = marked.filter(F.octet_length("turns") > F.col("shared") * WIDE).withColumn("path", path).withColumn("to", F.concat(F.substring(F.sha2(F.concat(F.col("state").cast("binary"), F.lit("+").cast("binary"), F.col("path")), 256), 1, 32), F.lit(f"+{seg}")))
        paths = beyond.groupBy("state", "base", "depth0", F.col("path").alias("turns"), F.col("to").alias("cont")).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.any_value(F.slice("sizes", 1, F.col("shared"))).alias("sizes")).withColumn("end_key", F.lit(None).cast("string"))
        stay = marked.filter(F.col("shared").isNull() | (F.octet_length("turns") == F.col("shared") * WIDE))
        rounds.append(scratch.write(stay.select(*ENTRY).unionByName(paths.select(*ENTRY)), f"entries-{seg}"))
        behind = {"state": F.col("to"), "base": F.col("group_least"), "depth0": F.col("depth0") + F.col("shared"), "turns": F.expr(f"substring(turns, {WIDE} * shared + 1)"), "sizes": F.expr("slice(sizes, shared + 1, size(sizes))")}
        entries = scratch.write(beyond.select(*[behind.get(c, F.col(c)).alias(c) for c in ENTRY]), f"tails-{seg}")


def tries(entries: DataFrame, totals: DataFrame | None) -> DataFrame:
    """NODES of a round's entries; totals: what the continued states sum up to."""
    if totals is None:
        entries = entries.withColumns({c: F.lit(0).cast("long") for c in ("b_children", "b_leaves", "b_saved")})
    else:
        entries = entries.join(totals, "cont", "left").fillna(0, ["b_children", "b_leaves", "b_saved"])
    load = entries.agg(F.sum(F.size("sizes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("state", F.substring("turns", 1, WIDE)), F.lit(max(1, -(-load // TARGET)))).cast("int")
    return entries.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(build, NODES)


def endings(members: DataFrame) -> DataFrame:
    """end_key, ends_sha256: of the ids of each key's conversations, ascending and joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["end_key", "first", "ids"])

        key, ids, size, out = None, [], 0, []
        for b in batches:
            for k, c in zip(b.column("end_key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or size > PIECE):
                    out.append((key, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                    if len(out) >= 1024:
                        yield batch(out)
                        out = []
                key = k
                ids.append(c)
                size += 20
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
        if out:
            yield batch(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column("end_key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if state is not None and k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["end_key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["end_key", "ends_sha256"])

    pieces = members.repartitionByRange("end_key", "conv_id").sortWithinPartitions("end_key", "conv_id").mapInArrow(join, "end_key string, first long, ids string")
    return pieces.repartition("end_key").sortWithinPartitions("end_key", "first").mapInArrow(digest, "end_key string, ends_sha256 string")


def trie(spark: SparkSession, turns: DataFrame, head: Column, base: Column, reach: int, longest_head: int) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. head, base, reach, longest_head: as ``rebuilt`` takes them."""
    scratch = Scratch(spark, "trie")
    convs, rows = rebuilt(turns, scratch, head, base, reach, longest_head)
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.coalesce(F.max("total"), F.lit(0)).alias("longest")).first()
    held = scratch.write(segments(rows), "segments")
    rounds, deepest = [], -(-whole["longest"] // SEGMENT)
    for seg in range(deepest):
        own = held.filter(F.col("seg") == seg)
        same = own.groupBy("state", "turns", "cont").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.any_value("sizes").alias("sizes")).withColumn("end_key", F.when(F.col("cont").isNull(), end_key())).withColumn("depth0", F.lit(seg * SEGMENT).cast("long"))
        if seg:
            bases = held.filter(F.col("seg") == seg - 1).groupBy(F.col("cont").alias("state")).agg(F.min("conv_id").alias("base"))
            same = same.join(bases, "state")
        else:
            same = same.withColumn("base", F.lit(whole["least"]).cast("long"))
        rounds += dealt(scratch.write(same.select(*ENTRY), f"entries-{seg}"), scratch, seg)
    totals, nodes = [], []
    for entries in reversed(rounds):
        nodes.append(scratch.write(tries(entries, reduce(DataFrame.unionByName, totals) if totals else None), "nodes"))
        totals.append(nodes[-1].filter("top").groupBy(F.col("state").alias("cont")).agg(F.count(F.lit(1)).alias("b_children"), F.sum("n_leaves").alias("b_leaves"), F.sum("saved_tokens").alias("b_saved")))
    sums = totals[-1].filter(F.col("cont") == ROOT).first() if totals else None
    top = [(None, True, whole["least"], 0, None, whole["n"], sums["b_children"] if sums else 0, sums["b_leaves"] if sums else 1, sums["b_saved"] if sums else 0, ROOT)] if whole["n"] else []
    every = reduce(DataFrame.unionByName, [spark.createDataFrame(top, NODES), *nodes])
    members = convs.filter("total = 0").select(F.lit(ROOT).alias("end_key"), "conv_id").unionByName(held.filter("last").select(end_key().alias("end_key"), "conv_id"))
    ended = every.filter("end_key IS NOT NULL").join(scratch.write(endings(members), "endings"), "end_key", "left")
    passed = every.filter("end_key IS NULL").withColumn("ends_sha256", F.lit(EMPTY))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return ended.select(*columns).unionByName(passed.select(*columns))


def digest(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Each conversation begins with the first turns of the one whose id is the multiple of five at or before
    its own, as many as the checksum of its id says."""
    conv = F.col("conv_id")
    return trie(spark, turns, (F.crc32(conv.cast("string")) % 9).cast("long"), conv - conv % 5, reach=4, longest_head=8)
