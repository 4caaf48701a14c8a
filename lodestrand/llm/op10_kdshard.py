"""Sharding by k-d tree partitioning, in DataFrame operations only.

The table of metadata (id, size, and the dimensions as whole numbers) is split again and again at
the weighted median of the dimension in which a node is widest, relative to the whole table, until
every leaf is one shard; weights are sizes in bytes. The median is exact: rows are ordered by the
dimension, then the id, then a row number that is written once, and a histogram search narrows
that order down to one row, for all nodes of a level in the same job. So a source or a text that
holds a third of all rows is split like any other; sizes differ by about one document a level.

Only histograms reach the driver, at most about ``CELLS`` numbers a job (at least 16 a node).

Under this law equal texts are rows like any others: a group of copies is split where the tree
splits it, as a third of all bytes does not fit in one shard of sixteen.

Defined results: a null text has size 1 and checksum 0; null ids and dimensions sort first; rows
that repeat an id are told apart by their row number; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

CELLS = 32768
FEW_RULES = 200_000  # rows of about 60 bytes that a join may broadcast
SLOT_ROWS = 50_000
LOWEST = -(2**63)


def as_number(df: DataFrame, column: str) -> Column:
    """A column as a whole number, in an order of its own: numbers as they are, others by checksum."""
    kind = dict(df.dtypes)[column]
    value = F.col(f"`{column}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(value.cast("long"), F.lit(-(2**62)))
    return F.coalesce(F.crc32(value.cast("string").cast("binary")), F.lit(-1)).cast("long")


class Node:
    """One node's search for its median: columns settled so far, and the range left."""

    def __init__(self, first: int, shards: int, dim: int, total: int):
        self.first, self.shards, self.dim = first, shards, dim
        self.left = shards // 2
        self.target = total * self.left / shards
        self.fixed: list[int] = []
        self.below = 0
        self.low = self.high = 0
        self.done = False

    @property
    def stage(self) -> int:
        return len(self.fixed)

    def settle(self, bins: list[tuple[int, int, int]], width: int, ranges: list[tuple[int, int]]) -> None:
        """bins: (bin, bytes, rows), ascending. Narrow the range to the bin with the median."""
        for i, (at, size, rows) in enumerate(bins):
            if self.below + size >= self.target or i == len(bins) - 1:
                low = self.low + at * width
                self.low, self.high = low, min(low + width - 1, self.high)
                if rows == 1 or (width == 1 and self.stage == 2):
                    # with or without the last row, whichever is nearer to the target
                    self.cut = self.high if self.below + size - self.target <= self.target - self.below else self.low - 1
                    self.done = True
                elif width == 1:
                    self.fixed.append(low)
                    self.low, self.high = ranges[self.stage]
                return
            self.below += size


def split_level(spark: SparkSession, meta: DataFrame, nodes: list[Node], ranges: dict, names: list[str]) -> DataFrame:
    """Split every node that has several shards; returns the table with the new nodes."""
    dims = F.array(*[F.col(n) for n in names])

    def rules(rows: list[Node], bins: int) -> DataFrame:
        made = []
        for n in rows:
            width = 1 if n.done else max(1, -(-(n.high - n.low + 1) // bins))
            fixed = [*n.fixed, 0, 0][:2]
            made.append((n.first, n.dim, n.stage, fixed[0], fixed[1], n.cut if n.done else n.low, n.high, width, n.left))
        made = spark.createDataFrame(made, "node int, dim int, stage int, e0 long, e1 long, low long, high long, width long, move int")
        # a row a node: sent to the table, so that no node, however large, meets in one task
        return F.broadcast(made) if len(rows) <= FEW_RULES else made

    main = F.element_at(dims, F.col("dim") + 1)
    value = F.when(F.col("stage") == 0, main).when(F.col("stage") == 1, F.col("id_key")).otherwise(F.col("row"))
    inside = ((F.col("stage") < 1) | (main == F.col("e0"))) & ((F.col("stage") < 2) | (F.col("id_key") == F.col("e1")))
    while active := [n for n in nodes if not n.done]:
        bins = max(16, CELLS // len(active))
        rule = rules(active, bins)
        widths = {n.first: max(1, -(-(n.high - n.low + 1) // bins)) for n in active}
        held = meta.join(rule, "node").filter(inside & value.between(F.col("low"), F.col("high"))).withColumn("bin", (value - F.col("low")))
        counted = held.groupBy("node", F.expr("bin div width").alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        found: dict[int, list] = {}
        for r in counted.collect():
            found.setdefault(r["node"], []).append((r["bin"], r["size"], r["n"]))
        for n in active:
            n.settle(sorted(found[n.first]), widths[n.first], [(0, 0), ranges["id_key"], ranges["row"]])
    ruled = meta.join(rules(nodes, 1), "node", "left")
    right = F.when(F.col("stage") == 0, main > F.col("low")).when(F.col("stage") == 1, (main > F.col("e0")) | ((main == F.col("e0")) & (F.col("id_key") > F.col("low")))).otherwise((main > F.col("e0")) | ((main == F.col("e0")) & ((F.col("id_key") > F.col("e1")) | ((F.col("id_key") == F.col("e1")) & (F.col("row") > F.col("low"))))))
    return ruled.select(*[c for c in meta.columns if c != "node"], (F.col("node") + F.when(right, F.col("move")).otherwise(0)).alias("node"))


def assign(spark: SparkSession, docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row; give the number of shards or their bytes."""
    scratch = Scratch(spark, "kdshard")
    if dimensions is None:
        dimensions = [c for c in ("source", "lang", "n_chars") if c in docs.columns]
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"dim_{i}" for i in range(len(dimensions) + 1)]
    columns = [as_number(docs, doc_id).alias(names[0]), *(as_number(docs, c).alias(n) for c, n in zip(dimensions, names[1:], strict=True))]
    meta = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *columns)
    meta = scratch.write(meta.withColumns({"id_key": F.col(names[0]), "row": F.monotonically_increasing_id(), "node": F.lit(0)}), "meta")
    order = [*names, "id_key", "row"]
    spread = lambda by: by.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in order for k, f in (("low", F.min), ("high", F.max))])
    whole = spread(meta).first()
    rows = whole["n"]
    if shards is None:
        shards = max(1, math.ceil((whole["total"] or 0) / (target_bytes or 256 << 20)))
    ranges = {c: (whole[f"low_{c}"], whole[f"high_{c}"]) for c in order} if rows else {}
    held = {0: shards}
    while rows and any(s > 1 for s in held.values()):
        nodes = []
        for r in spread(meta.groupBy("node")).collect():
            if held[r["node"]] > 1:
                wide = [(r[f"high_{c}"] - r[f"low_{c}"]) / max(1, ranges[c][1] - ranges[c][0]) for c in names]
                # widest first; of equally wide ones the later, as the id is also what breaks ties
                dim = max(range(len(names)), key=lambda i: (wide[i], i))
                node = Node(r["node"], held[r["node"]], dim, r["total"])
                node.low, node.high = r[f"low_{names[dim]}"], r[f"high_{names[dim]}"]
                nodes.append(node)
        meta = scratch.write(split_level(spark, meta, nodes, ranges, names), "meta")
        for s, n in list(held.items()):
            if n > 1:
                held[s], held[s + n // 2] = n // 2, n - n // 2
        if not nodes:  # fewer rows than shards: the rest stay empty
            break
    # slots: numbers within parts of a shard, and each part's beginning
    parts = max(4, math.ceil(rows / (shards * SLOT_ROWS)))
    dealt = meta.withColumn("part", F.pmod(F.xxhash64("id_key", "row"), parts))
    sizes = dealt.groupBy("node", "part").agg(F.count(F.lit(1)).alias("held"))
    begins = sizes.withColumn("begin", F.sum("held").over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("node", "part", F.coalesce("begin", F.lit(0)).alias("begin"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("node", "part").orderBy("id_key", "row")) - 1)
    return numbered.join(begins, ["node", "part"]).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), (F.col("begin") + F.col("at")).cast("long").alias("slot"))


def digest(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """The assignment under the law ``bytes``: shard sizes are nearly equal."""
    return assign(spark, docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
