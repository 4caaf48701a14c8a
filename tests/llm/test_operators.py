"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties,
repeated rows, extra columns with clashing names, and on empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import exchange, op1_huffman, op2_substring, op3_neardup, op4_langid, op5_packing, op6_decontaminate, op7_kdtree, op8_quality, op9_lm, op10_kdshard
from lodestrand.llm.queries import QUERIES, vocabulary
from lodestrand.llm.text import grams, word_hashes, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "node string, key string, size string, label string, id string, part string"


def split(t, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER) if lower else t or "")


def corpus():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choices(vocab, k=n))
    shared = make(40)
    base = make(200)
    rows = [(i, make(rnd.randint(1, 60))) for i in range(30)]
    rows += [(30 + i, f"{make(20)} {shared}\n{make(10)}") for i in range(8)]
    rows += [(40 + i, base) for i in range(5)]
    for i in range(12):
        w = base.split()
        for _ in range(i):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((50 + i, " ".join(w)))
    rows += [(70, None), (71, ""), (72, " \n\t"), (73, make(20000)), (74, "Word " * 50), (75, "x\x0by\x0cz \x1c   　 end"), (76, "A" * 300), (None, base), (77, make(30)), (77, make(30))]
    rows += [(78, base), (78, base)]
    rows += [(79, "hello <|endoftext|> world<|startoftext|>."), (80, "<|endoftext|>"), (81, "it's a <|ENDOFTEXT|> e\u0301!! don't, ok?3.5 (x)$$$")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if k % 2 else "de", "s", None if t is None else len(t)) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c.strip().split()[0]: F.lit("x") for c in CLASH.split(",")}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_and_hashes():
    texts = [t for _, t in ROWS]
    w = words(pa.array(texts, pa.string()))
    assert [x.decode() for t in [w.data.tobytes()] for x in (t[a:b] for a, b in zip(w.start, w.end, strict=True))] == [x for t in texts for x in split(t)]
    h = word_hashes(w)
    known = [x for t in texts for x in split(t)]
    assert len(set(h.tolist())) == len(set(known))
    for k in (1, 2, 5, 13):
        assert len(set(grams(h, k).tolist())) == len({tuple(known[i : i + k]) for i in range(len(known) - k + 1)})
    x = np.random.default_rng(0).integers(0, 2**40, 100)
    assert (exchange.expand(exchange.squeeze(x), np.int64) == x).all()


def test_op1_round_trip(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op1_huffman, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(op1_huffman, "SHARD_TOKENS", 4000)
    path = vocabulary("word_bpe_49k.json")
    got = op1_huffman.digest(spark, docs, path).collect()
    ids = Tokenizer.from_file(path).encode_batch([t or "" for _, t in ROWS], add_special_tokens=False)
    expected = sorted(((i, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for (i, _), e in zip(ROWS, ids, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert op1_huffman.digest(spark, empty, path).collect() == []


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, tight = op1_huffman.code_lengths(counts, 20), op1_huffman.code_lengths(counts, 4)
    assert free.max() == 9 and tight.max() <= 4
    assert sum(2.0**-b for b in tight) == 1 and (counts * free).sum() <= (counts * tight).sum()
    code = op1_huffman.Code(np.arange(10), tight)
    ids = np.random.default_rng(1).integers(0, 10, 1000)
    bits, marks = code.encode(ids)
    assert (code.decode(bits, marks, 1000) == ids).all()


def test_op2_equals_brute_force(spark, docs, empty):
    first = {}
    for i, t in ROWS:
        w = split(t)
        for p in range(len(w) - 12):
            if i is not None:
                first[tuple(w[p : p + 13])] = min(first.get(tuple(w[p : p + 13]), i), i)
    expected = []
    for i, t in ROWS:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in op2_substring.digest(spark, docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert op2_substring.digest(spark, empty).collect() == []
    out = op2_substring.remove_repeats(spark, docs, 20)
    assert out.columns == docs.columns and out.count() == len(ROWS)


def test_op2_paths_are_equal_in_128_bits():
    """Keys that collide: paths count as one only where their checks agree too."""
    keys, check = np.array([7, 7, 3, 7, 3], np.uint64), np.array([1, 2, 9, 1, 9], np.int64)
    found, group = exchange.grouped(keys, check)
    assert found.tolist() == [3, 7, 7] and group.tolist() == [1, 2, 0, 1, 0]
    assert op2_substring.merge(op2_substring.PATH, found, group, [check, np.array([50, 10, 30, 40, 20])]).tolist() == [20, 40, 10]
    assert [x.tolist() for x in exchange.grouped(np.zeros(0, np.uint64), np.zeros(0, np.int64))] == [[], []]
    texts = pa.array(["a b c d e f g", "u v w x y z t", "a b c d e f g"])
    w = op2_substring.Walks(texts, pa.array([5, 2, 9]), 3)
    w.mark(np.ones(len(np.unique(w.chosen)), np.int64))
    w.cut(np.zeros(10**4, np.int64)[: len(np.unique(np.concatenate([w.nodes(), w.tails(np.concatenate([w.begins[1:], [True]]))])))])
    w.key = np.zeros_like(w.key)  # every path under one key
    keys, check, least, where = w.path_requests()
    assert len(keys) == 2 and least[where].tolist() == [5, 2, 5]


def shingles(t, k=5):
    w = split(t, True)
    return frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [85, 80])
def test_op3_equals_brute_force(spark, docs, empty, percent):
    sets = [shingles(t) for _, t in ROWS]
    parent = list(range(len(ROWS)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ROWS)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[find(b)] = find(a)
    expected = []
    for k, (i, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if find(j) == find(k) and ROWS[j][0] is not None] if sets[k] else [i]
        least = min(ids, default=None)
        expected.append((i, len(sets[k]), least, i == least))
    got = [tuple(r) for r in op3_neardup.groups(spark, docs, percent / 100).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    if percent == 80:
        assert op3_neardup.groups(spark, empty, 0.8).collect() == []
        kept = op3_neardup.representatives(spark, docs, 0.8)
        assert kept.columns == docs.columns and kept.filter("doc_id = 78").count() == 0


@pytest.mark.parametrize("whole", [4, 1000])
def test_op3_large_nodes_lose_no_link(spark, monkeypatch, whole):
    """A chain of near copies that only the exhaustive step may close, whole and in blocks."""
    for name, value in {"CLOSING": 0, "SMALL": 2, "WHOLE": whole, "MOST_LEVELS": 3}.items():
        monkeypatch.setattr(op3_neardup, name, value)
    chain = [(i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in range(40)]
    apart = [(100 + i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(5)]
    got = op3_neardup.groups(spark, spark.createDataFrame(chain + apart, "doc_id long, text string"), 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 for i, _ in chain} | {i: i for i, _ in apart}


@pytest.mark.parametrize("size", [1, 7, 60, 400, 3000])
def test_op3_parities_rule_out_no_link(size):
    rng = np.random.default_rng(size)
    a, b = op3_neardup.coordinates()
    signed = lambda s: np.concatenate([op3_neardup.minwise(s, a, b), op3_neardup.parities(s)])
    apart = 0
    for threshold in (0.8, 0.85):
        for _ in range(60):
            x = rng.integers(0, 2**64, size, dtype=np.uint64)
            lost = int(rng.integers(0, size // 4 + 1))
            y = np.concatenate([x[lost:], rng.integers(0, 2**64, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64)])
            common, union = size - lost, len(y) + lost
            p, q = signed(x), signed(y)
            got = op3_neardup.possible(p[None], q[None], np.array([len(x)]), np.array([len(y)]), threshold)[0] >= 0
            # only the sketch may err, and only beyond its deviations
            if 100 * common >= round(100 * threshold) * union and (p[: op3_neardup.COORDINATES] == q[: op3_neardup.COORDINATES]).sum() >= op3_neardup.least_agreement(threshold):
                assert got
            if 400 >= size >= 60 and common < (threshold - 0.06) * union:
                apart += not got
                assert not got
    assert apart or not 400 >= size >= 60


@pytest.mark.parametrize("threshold", [0.8, 0.85])
@pytest.mark.parametrize("levels", [op3_neardup.LEVELS, op3_neardup.MOST_LEVELS])
def test_op3_trees_reach_their_recall(threshold, levels):
    """2,000 pairs of sets exactly at the threshold: those that meet in some node."""
    rnd = np.random.default_rng(12)
    a, b = op3_neardup.coordinates()
    common, own = round(threshold * 200), round((1 - threshold) * 200)
    pairs, met = 2000, 0
    sketches = []
    for _ in range(pairs):
        x = rnd.integers(0, 2**64, common + own, dtype=np.uint64)
        half = own // 2
        sketches += [op3_neardup.minwise(x[: common + half], a, b), op3_neardup.minwise(np.concatenate([x[:common], x[common + half :]]), a, b)]
    trees = op3_neardup.tree_count(threshold, 0.999)
    for at in range(0, pairs, 100):
        sketch = np.array(sketches[2 * at : 2 * at + 200])
        path = np.repeat(op3_neardup.mix(np.arange(trees, dtype=np.uint64) + np.uint64(77)), len(sketch))
        path, member = op3_neardup.descend(path, np.tile(np.arange(len(sketch)), trees), sketch, threshold, levels)
        found = {}
        for p, m in set(zip(path.tolist(), member.tolist(), strict=True)):
            found.setdefault((p, m // 2), set()).add(m)
        met += len({d for (_, d), who in found.items() if len(who) == 2})
    assert met >= 0.99 * pairs


def language(rnd, letters, n):
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(n))


def test_op4_learns_and_rejects(spark):
    rnd = random.Random(5)
    rows = [(i, language(rnd, "abcdefg" if i % 2 else "nopqrst", rnd.randint(3, 40)), "a" if i % 2 else "n") for i in range(200)]
    rows += [(1000, None, "a"), (1001, "123 !", "n"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("best", F.lit(1))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = {r["doc_id"]: r for r in op4_langid.identify(spark, df, learn=~held).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200]) and not any(got[i]["rejected"] for i in range(200))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1000, 1001, 1002))
    assert op4_langid.accepted(spark, df).count() == 200
    assert op4_langid.identify(spark, df.limit(0)).collect() == [] == op4_langid.accepted(spark, df.limit(0)).collect()


def test_op4_rejects_what_it_did_not_learn(spark):
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {k: ["".join(rnd.choices(rnd.sample(letters, 12), k=rnd.randint(3, 8))) for _ in range(80)] for k in ("one", "two", "three", "four", "unlearned")}
    text = lambda k: " ".join(rnd.choices(vocab[k], k=rnd.randint(10, 60)))
    learned = [k for k in vocab if k != "unlearned"]
    rows = [(i, text(k := learned[i % 4]), k) for i in range(400)]
    rows += [(1000 + i, text("unlearned"), None) for i in range(100)]
    rows += [(2000 + i, language(rnd, letters, rnd.randint(10, 60)), None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op4_langid.identify(spark, df, learn=F.crc32(F.col("doc_id").cast("string")) % 4 != 2).collect()
    share = lambda lo, hi: sum(r["rejected"] for r in got if lo <= r["doc_id"] < hi) / sum(lo <= r["doc_id"] < hi for r in got)
    assert share(0, 400) <= 0.03 and share(1000, 1100) >= 0.9 and share(2000, 2100) >= 0.9
    kept = [r["doc_id"] for r in op4_langid.accepted(spark, df).collect()]
    assert sum(i < 400 for i in kept) >= 388 and sum(i >= 1000 for i in kept) <= 20


def test_op5_pieces(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode_batch([t or "" for _, t in ROWS], add_special_tokens=False)
    expected = sorted(([i, [*e.ids, 0]] for (i, _), e in zip(ROWS, ids, strict=True)), key=repr)
    got = op5_packing.pack(spark, docs, path, window=64).collect()
    sequences, texts = {}, {}
    for r in got:
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(part) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], part))
    for pieces in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 64
    total = sum(len(x) for _, x in expected)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) == math.ceil(total / 64)
    for i, whole in expected:
        parts = sorted(texts[i, len(whole)])
        if len([1 for j, x in expected if j == i and len(x) == len(whole)]) == 1:
            assert [x for _, p in parts for x in p] == whole
    assert op5_packing.pack(spark, empty, path).collect() == []


@pytest.mark.parametrize("counts", [{2: 100_000}, {700: 5000}, {1: 1}, {i: i % 5 for i in range(1, 1024)}])
def test_op5_plan_fills_windows(counts):
    histogram = np.zeros(1024, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    rows, sequences = op5_packing.plan(histogram)
    tokens = int((histogram * np.arange(1024)).sum())
    assert (rows[:, 2] * rows[:, 4]).sum() == tokens and sequences == math.ceil(tokens / 1024)


def test_op6_finds_edited_passages(spark):
    rnd = random.Random(9)
    vocab = [language(rnd, "abcdefghij", 1) for _ in range(500)]
    items = [(i, " ".join(rnd.choices(vocab, k=n))) for i, n in enumerate((15, 40, 90, 15))] + [(8, None), (9, ""), (10, "too short")]
    edited = items[1][1].split()
    for p in (3, 17, 30):
        edited[p] = "other"
    del edited[22]
    long_part = items[2][1].split()[:64]
    rows = [(1, f"{items[0][1].upper()} tail"), (2, " ".join([*rnd.choices(vocab, k=30), *edited, "x"])), (3, " ".join(long_part)), (4, " ".join(rnd.choices(vocab, k=300))), (5, None), (6, ""), (7, "too short"), (1, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in op6_decontaminate.leaks(spark, docs, bench).collect())
    assert got == [(1, 0, 0), (1, 0, 0), (2, 1, 4), (3, 2, 0)]
    assert sorted(r["doc_id"] for r in op6_decontaminate.without_leaks(spark, docs, bench).collect()) == [4, 5, 6, 7]
    assert op6_decontaminate.leaks(spark, docs.limit(0), bench).collect() == [] == op6_decontaminate.leaks(spark, docs, bench.limit(0)).collect()


@pytest.mark.parametrize("size", [65, 72, 80, 100, 300])
def test_op6_long_items_are_compared_whole(spark, size):
    rnd = random.Random(size)
    vocab = [language(rnd, "abcdefghij", 1) for _ in range(500)]
    item, t = rnd.choices(vocab, k=size), size // 5
    fresh = iter(f"new{i}" for i in range(10_000))
    make = lambda n: [next(fresh) for _ in range(n)]
    rows, distance = [], {}
    for k, edits in enumerate((t, t, t, t + 1) * 2):
        middle = (size - edits) // 2
        if k % 4 == 0:  # rewritten where the passages overlap
            w = item[:middle] + make(edits) + item[middle + edits :]
        elif k % 4 == 1:  # cut out there
            w = item[:middle] + item[middle + edits :]
        elif k % 4 == 2:  # words put between, all over the item
            w = list(item)
            for p in sorted(rnd.sample(range(1, size), edits), reverse=True):
                w[p:p] = make(1)
        else:  # one edit too many, all over the item
            w = list(item)
            for p in rnd.sample(range(1, size - 1), edits):
                w[p] = next(fresh)
        rows.append((k, " ".join([*make(50 if k < 4 else 0), *w, *make(k)])))
        if edits == t:
            distance[k] = t
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = op6_decontaminate.leaks(spark, docs, bench).collect()
    whole = [r for r in found if r["item_words"] == size]
    assert {r["doc_id"]: r["distance"] for r in whole} == distance and len(whole) == len(distance)
    texts = dict(rows)
    assert all(levenshtein(item, split(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]) == t for r in whole)
    kept = {r["doc_id"] for r in op6_decontaminate.without_leaks(spark, docs, bench).collect()}
    assert kept == set(range(len(rows))) - {r["doc_id"] for r in found}


def levenshtein(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_op6_alignment_is_exact():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        item, text = rnd.integers(0, 4, (1, 8)), rnd.integers(0, 4, (1, 14))
        assert op6_decontaminate.alignment(item, text)[0][0] == levenshtein(item[0].tolist(), text[0].tolist())


def test_op7_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op7_kdtree, "SHARD", 100)
    monkeypatch.setattr(op7_kdtree, "LEAF", 8)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.3, 6).astype(np.float32)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [1e30] * 6), (2200, []), (2250, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))
    got = sorted(tuple(r) for r in op7_kdtree.top_k(spark, df, F.col("vec_id") % 50 == 0).filter("query_id < 2150").collect())
    usable = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in usable if i % 50 == 0 and i < 2150):
        scores = sorted(((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q))[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores) if abs(s) < 2**62]
    short = {e[0] for e in expected if len([1 for x in expected if x[0] == e[0]]) < 5}
    assert [g for g in got if g[0] not in short] == sorted(e for e in expected if e[0] not in short)
    assert op7_kdtree.top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_op8_learns(spark):
    rnd = random.Random(6)
    rows = [(i, language(rnd, "abcdefg", 30) if i % 4 else "BUY!! NOW!! " * 10) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    marks = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op8_quality.quality(spark, df, marks, F.crc32(F.col("doc_id").cast("string")) % 5 != 0).collect()}
    assert all(got[i]["predicted"] == int(bool(i % 4)) for i in range(200)) and 0 <= got[500]["score"] <= 1 and got[500]["score"] == got[501]["score"]
    assert [r["score"] for r in op8_quality.quality(spark, df.limit(1), marks.limit(0)).collect()] == [0.5]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_op9_base_and_model(spark, docs, empty, order):
    from collections import Counter

    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in ROWS:
        if not held(i):
            counts.update([*split(t, True), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in ROWS:
        tokens = [*split(t, True), None]
        expected.append((i, held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), 6)))
    got = op9_lm.score(spark, docs, order).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r["score"] <= 1e-9 and (order > 1 or abs(r["score"] - r["base_score"]) < 1e-6) for r in got)
    assert order != 2 or op9_lm.score(spark, empty).collect() == []


def test_op9_weights_come_from_held_out_counts():
    at = lambda ratio: 0 if ratio == 0 else int((math.log2(ratio) - op9_lm.LOW) / op9_lm.STEP) + 1
    sure = op9_lm.learn_weights([(1, at(64.0), 90.0), (1, at(0), 10.0)], 2)[1]
    unsure = op9_lm.learn_weights([(1, at(64.0), 10.0), (1, at(0), 90.0)], 2)[1]
    assert sure[0] > 0.8 > 0.2 > unsure[0] and abs(sure.sum() - 1) < 1e-9


def test_op9_query_uses_two_words_of_context(spark, tmp_path):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    learn, (good, bad) = [i for i in range(1000) if not held(i)][:200], [i for i in range(1000) if held(i)][:2]
    # alike in unigrams and bigrams: only the word before the last one tells what follows
    rows = [(i, "left middle one" if k % 2 else "right middle two") for k, i in enumerate(learn)] + [(good, "left middle one"), (bad, "left middle two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[good] - got[bad] > 0.5


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_op10_sizes_are_even(spark, docs, empty, shards):
    got = op10_kdshard.digest(spark, docs, shards).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
    largest = max(r["size"] for r in got)
    assert len(got) == len(ROWS) and sum(sizes) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    assert max(sizes) - min(sizes) <= 2 * largest
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sorted((r["doc_id"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((i, zlib.crc32((t or "").encode())) for i, t in ROWS if i is not None)
    assert op10_kdshard.digest(spark, empty, shards).collect() == []


def test_op10_hot_groups_are_split(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") < 700, "hot").otherwise("cold").alias("source"))
    sizes = [r["count"] for r in op10_kdshard.digest(spark, df, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 3
