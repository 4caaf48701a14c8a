"""Near-duplicate groups by a chosen-path set similarity join.

A document's set holds its distinct k-word shingles; documents with intersection >= threshold *
union are linked. Equal sets are one vertex, so copies cost one row. Over the distinct sets:

* A *tree* starts at its root. At a node a document branches by its minwise hash at a coordinate
  that the node chooses, and by a second one with probability 1/t - 1. That is 1/t branches on
  average, so a pair of agreement t is expected to meet in one branch at any depth. All trees draw
  on one set of coordinates, so t is the agreement that a pair at the threshold has by
  ``TREE_DEVIATIONS`` standard deviations of bad luck; trees are repeated to the target recall.
* *Nodes* of two or more documents give candidates, in rounds, so that no node emits all its
  pairs: first each document with the least that it shares a node with, then, for a few rounds, with
  the one partner of another component, over all its nodes, whose sketch agrees most; confirmed
  links are closed to components after each round, so a round adds at most one link a document. Only nodes that still hold several components are then compared exhaustively, across
  components. Nodes that are too large for that branch further; those that still hold more than
  ``WHOLE`` documents at the last level are compared in blocks.
* A *sketch* of all minwise hashes drops pairs that are more than ``DEVIATIONS`` standard deviations below
  the threshold. Beside it lie the *parities* of the set's hashes in ``PARITIES`` bins: bins whose parities
  differ each hold an element of one set alone, so they bound the sets' difference from below and
  drop pairs that cannot be links, without loss. Nodes carry one byte of each minwise hash and the
  parities (``SHORT`` bytes): bytes agree wherever hashes do, so no pair is lost by it. Every link is
  then confirmed on the full sets.

Links, labels and fingerprints stay in Spark tables throughout.

Defined results: a text without words (or null) has an empty set and is alone; with fewer words
than k, the whole sequence is its one shingle; rows with a null doc_id take part, and such a row
is kept only where its group has no other id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import to_batch
from .storage import Scratch
from .text import U, grams, mix, pair, pieces, tidied, word_hashes, words

COORDINATES = 256
PARITIES = 1024
SHORT = COORDINATES + PARITIES // 8  # bytes of a sketch that pairs are judged by: the hashes' low bytes, then the parities
DEVIATIONS = 5.0
TREE_DEVIATIONS = 2.0
NO_ID = 2**63 - 1
LEVELS = 3  # levels of a tree between two looks at the nodes' sizes
MOST_LEVELS = 12
CLOSING = 2  # rounds, at most, of nearest partners; more of them found next to nothing
SMALL = 200  # documents of a node that are compared exhaustively while it can still branch
WHOLE = 1000  # and when it cannot; larger nodes then meet in blocks of half as many


def shingle_sets(texts: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    w = words(texts, lower=True)
    h = word_hashes(w)
    starts = np.flatnonzero(w.room()[: max(0, len(h) - k + 1)] >= k)
    shingle, doc = grams(h, k)[starts], w.doc[starts] if len(h) else starts
    first = np.searchsorted(doc, np.arange(len(w.first)))
    for i in range(len(w.first) - 1):
        n = int(w.first[i + 1] - w.first[i])
        if n >= k:
            yield np.unique(shingle[first[i] : first[i + 1]])
        elif n:
            # a sequence shorter than k: hashed with its length, apart from all shingles
            yield np.array([pair(grams(h[w.first[i] : w.first[i + 1]], n), np.array([n], U))[0]])
        else:
            yield np.zeros(0, U)


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minwise(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of the set at each coordinate, in blocks for long texts."""
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    s = (s >> U(32)).astype(np.uint32)
    for at in range(0, len(s), 512):
        low = np.minimum(low, (s[at : at + 512] * a[:, None] + b[:, None]).min(axis=1))
    return low


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each bin holds an odd number of the set's hashes, as bits."""
    odd = np.bincount((s % U(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8))


def sketch_of(low: np.ndarray, odd: np.ndarray) -> bytes:
    """Low bytes of the minwise hashes, parities, then the hashes' three other bytes."""
    return low.astype(np.uint8).tobytes() + odd.tobytes() + low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def hashes(column) -> np.ndarray:
    """The minwise hashes of whole sketches."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SHORT + 3 * COORDINATES)
    whole = np.empty((len(raw), COORDINATES, 4), np.uint8)
    whole[:, :, 0] = raw[:, :COORDINATES]
    whole[:, :, 1:] = raw[:, SHORT:].reshape(-1, COORDINATES, 3)
    return whole.view("<u4")[:, :, 0]


def shorts(column) -> np.ndarray:
    """The part of sketches that pairs are judged by, as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SHORT)


def short(sketch: str) -> Column:
    return F.substring(sketch, 1, SHORT)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Agreeing bytes of pairs that short sketches, the sets' sizes and their parities do not rule out as links; else -1."""
    percent, y = round(threshold * 100), np.broadcast_to(y, x.shape)
    agree = (x[:, :COORDINATES] == y[:, :COORDINATES]).sum(axis=1)
    ok = (agree >= least_agreement(threshold)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    at = np.flatnonzero(ok)
    apart = np.bitwise_count(x[at, COORDINATES:] ^ y[at, COORDINATES:]).sum(axis=1, dtype=np.int64)
    ok[at] = apart * (100 + percent) <= (n + m)[at] * (100 - percent)
    return np.where(ok, agree, -1)


def coordinates() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(COORDINATES, dtype=U)
    return (mix(at + U(7)) | U(1)).astype(np.uint32), mix(at + U(1007)).astype(np.uint32)


SIGNED = "id long, n long, key binary, sketch binary"


def signatures(docs: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    def sign(batches):
        a, b = coordinates()
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for i, s in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), k), strict=True):
                    rows.append((i, len(s), key_of(s), sketch_of(minwise(s, a, b), parities(s))) if len(s) else (i, 0, None, None))
                yield to_batch(rows, SIGNED)

    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text")).mapInArrow(tidied(sign), SIGNED)


def met(threshold: float) -> float:
    """The agreement of sketches that trees are made for."""
    return threshold - TREE_DEVIATIONS * math.sqrt(threshold * (1 - threshold) / COORDINATES)


def descend(path: np.ndarray, member: np.ndarray, sketch: np.ndarray, threshold: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Branch each (path, member) by chosen minwise tokens, ``levels`` times."""
    extra = U(int((1 / met(threshold) - 1) * 2**32))
    for _ in range(levels):
        first = (mix(path + U(1)) % U(COORDINATES)).astype(np.int64)
        more = np.flatnonzero((mix(path + U(2)) >> U(32)) < extra)
        second = (mix(path[more] + U(3)) % U(COORDINATES)).astype(np.int64)
        more = more[second != first[more]]
        second = (mix(path[more] + U(3)) % U(COORDINATES)).astype(np.int64)
        chosen = np.concatenate([first, second])
        at = np.concatenate([np.arange(len(path)), more])
        path, member = pair(path[at], pair(chosen.astype(U), sketch[member[at], chosen].astype(U))), member[at]
    return path, member


def branch(rows: DataFrame, threshold: float, trees: int = 0, levels: int = LEVELS) -> DataFrame:
    """Nodes of (key, sketch) rows from the roots of ``trees``, or of (node, key, sketch) rows further down."""

    def expand(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = hashes(batch.column("sketch"))
            n = len(sketch)
            if trees:
                path, member = np.repeat(mix(np.arange(trees, dtype=U) + U(77)), n), np.tile(np.arange(n), trees)
            else:
                path, member = np.asarray(batch.column("node")).view(U), np.arange(n)
            path, member = descend(path, member, sketch, threshold, levels)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("key").take(pa.array(member))], names=["node", "key"])

    return rows.mapInArrow(expand, "node long, key binary")


def least_agreement(threshold: float) -> float:
    """Coordinates at which the sketches of a link agree, but for a chance of less than one in a million."""
    return COORDINATES * threshold - DEVIATIONS * math.sqrt(COORDINATES * threshold * (1 - threshold))


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, n_a, n_b, s_a, s_b) that may be links."""

    def keep(batches):
        for batch in batches:
            x, y = (shorts(batch.column(c)) for c in ("s_a", "s_b"))
            n, m = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(possible(x, y, n, m, threshold) >= 0))

    return pairs.mapInArrow(keep, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, threshold: float, text: str, doc_id: str, scratch: Scratch) -> DataFrame:
    """The pairs of keys whose full sets reach the threshold, written. Sets are made again, of candidates only."""
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct().join(sets.select("key", "id"), "key")
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text")).join(needed.select("id").distinct(), "id", "left_semi")

    def make(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield to_batch([(key_of(s), s.tobytes()) for s in shingle_sets(part.column("text"), k) if len(s)], "key binary, members binary")

    full = scratch.write(source.mapInArrow(tidied(make), "key binary, members binary").join(needed.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")
    both = pairs.join(full.select(F.col("key").alias("a"), F.col("members").alias("m_a")), "a").join(full.select(F.col("key").alias("b"), F.col("members").alias("m_b")), "b")
    percent = round(threshold * 100)

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("m_a"), batch.column("m_b"), strict=True):
                s, t = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = scratch.write(both.mapInArrow(tidied(check), "a binary, b binary"), "links")
    scratch.drop(full)
    return links


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, label): the least key that is reachable. Labels spread along links and jump to their labels' labels."""
    edges = scratch.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("key").alias("a"), "label"), "a").groupBy(F.col("b").alias("key")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "key", "left").select("key", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = scratch.write(spread.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        scratch.drop(labels)
        labels = new.select("key", "label")
        if new.filter("label != old").isEmpty():
            scratch.drop(edges)
            return labels


def sized(nodes: DataFrame) -> DataFrame:
    """Rows of nodes that hold two documents or more, with that number."""
    return nodes.join(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node")


def across(rows: DataFrame, groups: list[str], threshold: float, nearest: bool = False) -> DataFrame:
    """Likely pairs across components within each group of at most a few hundred rows: all of them,
    or (with the agreement) for each row a only the one whose sketch agrees most."""

    def compare(t: pa.Table) -> pa.Table:
        sketch = shorts(t.column("short"))
        _, label = np.unique(np.array(t.column("label").to_pylist(), object), return_inverse=True)
        n, key = np.asarray(t.column("n")), t.column("key").to_pylist()
        out = []
        for i in range(len(key)):
            rest = slice(0 if nearest else i + 1, None)
            other = np.flatnonzero(label[rest] != label[i]) + rest.start
            agree = possible(sketch[other], sketch[i : i + 1], n[other], n[i : i + 1], threshold)
            if nearest:
                if len(other) and agree.max() >= 0:
                    out.append((key[i], key[other[agree.argmax()]], int(agree.max())))
            else:
                out += [(min(key[i], key[j]), max(key[i], key[j])) for j in other[agree >= 0].tolist()]
        return pa.Table.from_batches([to_batch(out, schema)])

    schema = "a binary, b binary, agree int" if nearest else "a binary, b binary"
    return rows.select(*groups, "key", "n", "short", "label").groupBy(*groups).applyInArrow(compare, schema)


def likeliest(found: DataFrame) -> DataFrame:
    """Of all nodes' nearest pairs the one that agrees most for each document a, each pair once."""
    best = found.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", F.col("best")["b"].alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tree_count(threshold: float, recall: float) -> int:
    """Trees for the recall at the threshold; a tree's is the survival of its branching process."""
    alive = 1.0
    threshold = met(threshold)
    extra = 1 / threshold - 1
    for _ in range(MOST_LEVELS):
        meet = threshold * alive
        alive = (1 - extra) * meet + extra * (1 - (1 - meet) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def groups(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "neardup")
    signed = scratch.write(signatures(docs, k, text, doc_id), "signed")
    sets = scratch.write(signed.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "distinct")
    slim = scratch.write(signed.select("id", "n", "key"), "documents")
    scratch.drop(signed)  # sketches of copies are not needed again
    scratch.release()

    nodes = scratch.write(sized(branch(sets.select("key", "sketch"), threshold, tree_count(threshold, recall)).distinct()), "nodes")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), short("sketch").alias(f"s_{c}"))
    # one star edge a document: to the least of all documents that it shares a node with
    stars = nodes.join(nodes.groupBy("node").agg(F.min("key").alias("a")), "node").groupBy(F.col("key").alias("b")).agg(F.min("a").alias("a")).filter("a != b")
    pairs = scratch.write(likely(stars.join(side("a"), "a").join(side("b"), "b"), threshold), "stars")
    links = confirmed(pairs, sets, docs, k, threshold, text, doc_id, scratch)
    scratch.drop(pairs)
    labels = components(links, scratch)
    scratch.release()

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of nodes that still hold documents of several components."""
        named = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        several = named.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("node")
        return scratch.write(named.join(several, "node").join(sets.select("key", "n", short("sketch").alias("short")), "key"), "mixed")

    # each document with its likeliest partner of another component, as in Boruvka's trees: components
    # of near copies close in a few rounds, before all pairs of what is left are looked at
    for at in range(CLOSING):
        held = mixed(nodes)
        parts = held.withColumn("part", F.pmod(F.xxhash64("key", "node", F.lit(at)), F.ceil(F.col("size") / SMALL)))
        near = scratch.write(likeliest(across(parts, ["node", "part"], threshold, nearest=True)), "nearest")
        scratch.drop(held)  # the sketches of a round are its largest table
        scratch.release()
        if near.isEmpty():
            break
        new = confirmed(near, sets, docs, k, threshold, text, doc_id, scratch)
        scratch.drop(near)
        if new.isEmpty():
            break
        links = links.union(new)
        labels = components(links, scratch)
    scratch.release()

    # then all likely pairs across components; too large nodes branch further
    level, found, read = LEVELS, [], []
    rows = nodes
    while True:
        held = mixed(rows)
        read += [rows, held]
        last = level >= MOST_LEVELS
        most = WHOLE if last else SMALL
        found.append(across(held.filter(F.col("size") <= most), ["node"], threshold))
        large = held.filter(F.col("size") > most)
        if large.isEmpty():
            break
        if last:
            half = WHOLE // 2
            block = F.pmod(F.xxhash64("key"), F.col("many"))
            dealt = large.withColumn("many", F.ceil(F.col("size") / half)).withColumn("block", block)
            # every block meets every other: a row joins the pairs of blocks that its own is part of
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
            found.append(across(dealt, ["node", "lo", "hi"], threshold))
            break
        rows = scratch.write(sized(branch(large.select("node", "key").join(sets.select("key", "sketch"), "key"), threshold).distinct()), "nodes")
        level += LEVELS
    more = found[0]
    for x in found[1:]:
        more = more.union(x)
    more = scratch.write(more.distinct(), "across")
    for table in read:
        scratch.drop(table)
    scratch.release()
    if not more.isEmpty():
        links = links.union(confirmed(more, sets, docs, k, threshold, text, doc_id, scratch))
        labels = components(links, scratch)

    # the least id of each component, for all its keys
    member = labels.join(sets.select("key", "id"), "key")
    least = member.groupBy("label").agg(F.min("id").alias("component"))
    alone = sets.select("key", F.col("id").alias("own"))
    final = alone.join(member.join(least, "label").select("key", "component"), "key", "left").select("key", F.coalesce("component", "own").alias("component"))
    out = slim.join(final, "key", "left")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    component = F.coalesce("component", "id")
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != NO_ID, component).alias("component_id"), (F.col("id") == component).alias("kept"))


def representatives(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, k: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their groups, with all their columns, as they are.

    Of rows that repeat an id and its text one stays; rows without an id stay where their group has
    no other. An id that two different texts share stays or goes with either of them."""
    found = groups(spark, docs, threshold, k, text=text, doc_id=doc_id).filter("kept").select(F.col("doc_id").alias("kept_id"))
    found = Scratch(spark, "neardup").write(found, "kept")
    repeated = not found.groupBy("kept_id").count().filter("count > 1").isEmpty()
    kept = docs.join(found.distinct(), F.col(doc_id).cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    if repeated:
        kept = kept.withColumn("__same", F.xxhash64(F.col(text))).dropDuplicates([doc_id, "__same"]).drop("__same")
    return kept
