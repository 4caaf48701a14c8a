"""Vector code compression: product codes of four parts, with a ball tree over each part's codebook.

Every component x becomes the integer floor(1024 * x). A vector of n components is cut into four parts,
part j from component j * n // 4 on (equal parts where 4 divides n). Each part's codebook begins as that
part of the 256 smallest ids; each round assigns every part to its nearest entry and moves entries to
the componentwise floor of their parts' mean. All decisions are made on whole numbers.

The nearest entry is found in a ball tree over the codebook: a ball holds the entries of its node, its
centre is whole and its radius is rounded up, and the bound on what a ball can hold is rounded down. A
ball is left out only where that bound is above the best distance so far (not where it equals it), as an
equally near entry of a lower index may lie in it. Whole batches go down the tree together: at each node
the parts that are nearer to one child visit that child first.

What moves: a task sums its rows by (part, entry, component) and sends those sums once; Spark adds them.
The driver reads the codebooks, 256 * n numbers, whatever the number of rows; no group meets in one task.
Sums by label are made before the labels meet the rows.

Defined results: vectors that are null or hold null or non-finite components are dropped. Null ids are
never among the smallest ids (unless fewer than 256 rows have one), but are coded; rows that repeat an id
are rows of their own, the one with the smaller vector first. Vectors of different lengths have codebooks
of their own each; an empty vector has four empty parts and error 0. With fewer than 256 kept rows a
codebook has an entry for each. Distances that doubles do not hold exactly are computed with Python's
whole numbers, over all entries; errors end at a long's limit. Without a label column all labels count as
null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF, BATCH = 16, 8192
LIMB = 40  # sums travel in limbs of 40 bits, so that a long holds the sums of a million tasks
EXACT = 2**53
LONGEST = 2**63 - 1
FEW_LABELS = 200_000  # rows of about 30 bytes that a join may broadcast
SUMS = "dim int, part int, entry int, at int, limb int, value long"


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as whole doubles where those are exact, else as Python's numbers."""
    if not len(values) or np.abs(values).max() < 2**29:  # sums of a batch stay below 2**53
        return np.floor(values * SCALE)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in values.tolist()], object)


def bounds(dim: int) -> list[tuple[int, int]]:
    return [(j * dim // PARTS, (j + 1) * dim // PARTS) for j in range(PARTS)]


def vectors(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, the rows of that length, their components as whole numbers), a bounded piece at a time."""
    lists = batch.column(column)
    size = np.asarray(lists.value_lengths().fill_null(0))
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        for begin in range(0, len(rows), BATCH):
            at = rows[begin : begin + BATCH]
            values = np.asarray(lists.take(pa.array(at)).flatten().cast(pa.float64()))
            yield int(dim), at, whole(values).reshape(len(at), dim)


def exact(*tables: np.ndarray) -> bool:
    """Whether doubles hold every squared distance between rows of the tables."""
    if any(t.dtype == object for t in tables):
        return False
    most = max((float(np.abs(t).max(initial=0)) for t in tables), default=0.0)
    return 4 * most * most * max(1, tables[0].shape[1]) < EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, whole numbers in doubles."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


class Ball:
    """A node: its whole centre, a radius that no entry exceeds, and its entries or two children."""

    def __init__(self, entries: np.ndarray, at: np.ndarray):
        own = entries[at]
        self.centre = np.rint(own.mean(axis=0, keepdims=True))
        far = squared(own, self.centre)[:, 0]
        self.radius = np.nextafter(np.sqrt(far.max()) * (1 + 1e-15), np.inf)
        self.at, self.entries, self.children = at, own, None
        if len(at) > LEAF:
            # two far entries; the half that lies nearer to the first goes left
            first = own[[far.argmax()]]
            second = own[[squared(own, first)[:, 0].argmax()]]
            lean = squared(own, first)[:, 0] - squared(own, second)[:, 0]
            if lean.min() < lean.max():
                order = np.argsort(lean, kind="stable")
                half = len(order) // 2
                self.children = [Ball(entries, np.sort(at[side])) for side in (order[:half], order[half:])]


def search(root: Ball, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (of equally near ones the first) and its squared distance."""
    best, entry = np.full(len(parts), np.inf), np.full(len(parts), ENTRIES)

    def visit(node: Ball, rows: np.ndarray, far: np.ndarray) -> None:
        """far: squared distances of the rows to the node's centre."""
        low = np.maximum(np.sqrt(far) * (1 - 1e-15) - node.radius, 0)
        rows = rows[low * low * (1 - 1e-14) <= best[rows]]
        if not len(rows):
            return
        if node.children is None:
            found = squared(parts[rows], node.entries)
            near = found.argmin(axis=1)
            value, index = found[np.arange(len(rows)), near], node.at[near]
            better = (value < best[rows]) | ((value == best[rows]) & (index < entry[rows]))
            best[rows[better]], entry[rows[better]] = value[better], index[better]
            return
        left, right = node.children
        to = squared(parts[rows], np.concatenate([left.centre, right.centre]))
        nearer = to[:, 0] <= to[:, 1]
        for mine, order in ((nearer, (0, 1)), (~nearer, (1, 0))):
            for side in order:
                if mine.any():
                    visit(node.children[side], rows[mine], to[mine, side])

    if len(parts):
        visit(root, np.arange(len(parts)), squared(parts, root.centre)[:, 0])
    return entry, best


class Codebook:
    """The entries of one part position, with the tree over them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.tree = Ball(entries, np.arange(len(entries))) if exact(entries) else None

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        if self.tree is not None and exact(self.entries, parts):
            entry, error = search(self.tree, parts)
            return entry, error.astype(np.int64).tolist()
        entry, error = np.zeros(len(parts), np.int64), []
        entries = [[int(x) for x in e] for e in self.entries]
        for i, p in enumerate(parts):
            own = [int(x) for x in p]
            least, entry[i] = min((sum((x - y) ** 2 for x, y in zip(own, e, strict=True)), k) for k, e in enumerate(entries))
            error.append(least)
        return entry, error


Books = dict[int, list[np.ndarray]]  # by length of the vectors: the entries of each part


def limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, i = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield i, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        i += 1


def summed(rows: DataFrame, books: Books) -> DataFrame:
    """What one round's assignment adds up to: SUMS, ``at`` -1 counts the parts of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = {dim: [Codebook(e) for e in parts] for dim, parts in books.items()}
        total = {(dim, j): [[0] * len(e), np.zeros(e.shape, object)] for dim, parts in books.items() for j, e in enumerate(parts)}
        for batch in batches:
            for dim, _, values in vectors(batch):
                for j, (lo, hi) in enumerate(bounds(dim)):
                    own = values[:, lo:hi]
                    entry, _ = codebooks[dim][j].nearest(own)
                    count, sums = total[dim, j]
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    added = np.add.reduceat(own[order], first, axis=0) if hi > lo else np.zeros((len(used), 0))
                    for k, n, row in zip(used.tolist(), np.diff([*first, len(entry)]).tolist(), added, strict=True):
                        count[k] += n
                        sums[k] += np.array([int(x) for x in row], object)
        out = [(dim, j, k, at, limb, v) for (dim, j), (count, sums) in total.items() for k, n in enumerate(count) if n for at, x in ((-1, n), *enumerate(sums[k])) for limb, v in limbs(int(x))]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:5]), pa.array(columns[5], pa.int64())], names=["dim", "part", "entry", "at", "limb", "value"])

    return rows.mapInArrow(run, SUMS).groupBy("dim", "part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def moved(books: Books, sums: DataFrame) -> Books:
    """The codebooks after one round: entries with parts at the floor of their mean, others as they were."""
    found: dict[tuple[int, int, int], dict[int, int]] = {}
    for t in sums.toArrow().to_batches(max_chunksize=65536):
        for dim, part, entry, at, limb, value in zip(*(c.to_pylist() for c in t.columns), strict=True):
            own = found.setdefault((dim, part, entry), {})
            own[at] = own.get(at, 0) + (int(value) << (LIMB * limb))
    out = {dim: [e.copy() for e in parts] for dim, parts in books.items()}
    for (dim, part, entry), own in found.items():
        mean = [own.get(i, 0) // own[-1] for i in range(out[dim][part].shape[1])]
        if out[dim][part].dtype != object and max(map(abs, mean), default=0) >= EXACT:
            out[dim][part] = np.array([[int(x) for x in e] for e in out[dim][part]], object).reshape(out[dim][part].shape)
        out[dim][part][entry] = mean
    return out


def first_books(kept: DataFrame) -> Books:
    """For each length, the parts of the vectors with the smallest ids."""
    books = {}
    for row in kept.select(F.size("v").alias("dim")).distinct().collect():
        dim = row["dim"]
        least = kept.filter(F.size("v") == dim).orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
        values = whole(np.array([x for r in least for x in r["v"]], float)).reshape(len(least), dim)
        books[dim] = [values[:, lo:hi] for lo, hi in bounds(dim)]
    return books


def digest_of(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for e in parts for row in e for x in row).encode()).hexdigest()


def encode(spark: SparkSession, rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """vec_id, label, code, error, codebooks_sha256 of each usable row, and the final codebooks by length."""
    scratch = Scratch(spark, "codes")
    v = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own_label = F.col(label) if label in rows.columns else F.lit(None).cast("int")
    kept = scratch.write(rows.filter(v.isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), own_label.alias("label"), v.alias("v")), "kept")
    books = first_books(kept)
    for _ in range(rounds if books else 0):
        books = moved(books, summed(kept.select("v"), books))
    digests = {dim: digest_of(parts) for dim, parts in books.items()}
    kind = kept.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = {dim: [Codebook(e) for e in parts] for dim, parts in books.items()}
        for batch in batches:
            for dim, at, values in vectors(batch):
                entries, errors = zip(*(codebooks[dim][j].nearest(values[:, lo:hi]) for j, (lo, hi) in enumerate(bounds(dim))), strict=True)
                codes = np.stack(entries, axis=1).astype(np.uint8).tobytes().hex()
                width = 2 * PARTS
                of = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([of.column("id"), of.column("label"), pa.array([codes[i * width : (i + 1) * width] for i in range(len(at))]), pa.array([min(sum(e), LONGEST) for e in zip(*errors, strict=True)], pa.int64()), pa.array([digests[dim]] * len(at))], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    coded = kept.mapInArrow(code, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")
    return scratch.write(coded, "coded"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of the errors of all rows with an equal label."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums.withColumnRenamed("label", "_of")), F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
    # many labels: a hot one is dealt over 16 parts, and each label's sum goes to all of them
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(16)).cast("int")
    spread = sums.withColumnRenamed("label", "_of").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = coded.withColumn("_salt", salt)
    return dealt.join(spread, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_part"))).drop("_of", "_salt", "_part")


def digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    coded, _ = encode(spark, rows)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def decoded(coded: DataFrame, books: Books, dim: int) -> DataFrame:
    """vec_id and the vector that each code of length ``dim`` stands for: (entry + 0.5) / 1024 by component."""
    parts = [[[(float(x) + 0.5) / SCALE for x in row] for row in e] for e in books[dim]]
    spark, out = coded.sparkSession, coded
    for j, part in enumerate(parts):
        table = spark.createDataFrame([(f"{k:02x}", row) for k, row in enumerate(part)], f"_code{j} string, _part{j} array<double>")
        out = out.join(F.broadcast(table), F.substring("code", 2 * j + 1, 2) == F.col(f"_code{j}"))
    return out.select("vec_id", F.concat(*[F.col(f"_part{j}") for j in range(PARTS)]).alias("vector"))
