"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens. DataFrame functions only.

Base spans are the leftmost, non-overlapping matches of three patterns (``BASE``) that are long enough. The
method adds spans of kind ``random``: tokens of 16 or more characters of ``[A-Za-z0-9+/_-]`` (and up to two
``=`` behind) that overlap no base span, in which the battery finds a random key. A token's encoding is
inferred from the characters it has (``ENCODINGS``, the first that fits); letters alone and digits alone name
none, and such tokens are not tested. Three tests ask whether the token's symbols could be drawn at random:

* chi-squared against a uniform alphabet (Wilson and Hilferty's cube root),
* the number of runs above and below the alphabet's middle,
* the correlation of each symbol with the next.

Fisher's sum of their three tails must not fall below ``ACCEPT``: a token is then as random as a key is.
That alone says little of a short token, so each token also gets the probability that writing of its length
repeats symbols as rarely: under the frequencies of the alphabet's characters in all texts, the number of
equal pairs among n symbols has the mean n(n-1)/2 * s and a variance from s and t, the sums of squares and
cubes of the frequencies. The longer the token, the smaller this tail for a random one. Discoveries are
controlled by Benjamini and Hochberg's rule at ``FALSE``, on a grid of tails (``STEPS`` a power of ten, a tail
counts as the upper end of its step), within each encoding and octave of lengths, so that long tokens do not
lend short ones their threshold. Every occurrence of a token is a test.

Texts are read twice, once for tokens and once to count characters; only tokens move. Positions come from the
lengths of matches and of what lies between them, added up in a window of one text's matches.

Defined results: a null text has no span; positions are code points, ends exclusive; rows that repeat an id
are scanned each for itself; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: The kinds in order, each with its pattern and the group whose length counts.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of these characters is one match, so shorter runs need not be listed
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = (*(b[0] for b in BASE), "random")
LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (name, alphabet in order, what a token of it looks like, whether case is folded to lower)
ENCODINGS = (
    ("hex", DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", True),
    ("base32", UP + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", False),
    ("base36", DIGITS + LOW, r"^(?=.*[0-9])(?=.*[A-Za-z])([0-9a-z]+|[0-9A-Z]+)$", True),
    ("base62", UP + LOW + DIGITS, r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+$", False),
    ("base64", UP + LOW + DIGITS + "+/", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z+/]+$", False),
    ("base64url", UP + LOW + DIGITS + "-_", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]+$", False),
)
ACCEPT, FALSE, STEPS, DEEPEST = 0.001, 0.01, 20, 40


def found(text: Column, pattern: str, group: int) -> Column:
    """(hits, gaps, lengths): a text's matches, the characters before each, and the counted group's lengths."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits, F.char_length)
    return F.when(text.rlike(pattern), F.struct(hits.alias("hits"), gaps.alias("gaps"), lengths.alias("lengths")))


def matches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, and the matches of each kind that a text has."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [found(t, pattern, group).alias(kind) for kind, pattern, group, _ in BASE]
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *kinds, found(t, TOKEN, 0).alias("random"))


def located(scanned: DataFrame) -> DataFrame:
    """row, kind (its number), start, end, token: matches that are long enough."""
    least = [*(b[3] for b in BASE), LEAST]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("m")) for i, k in enumerate(KINDS)]))
    rows = scanned.select("row", each.alias("x")).filter("x.m IS NOT NULL").select("row", "x.kind", F.posexplode(F.arrays_zip("x.m.hits", "x.m.gaps", "x.m.lengths")).alias("no", "z")).filter("z.hits IS NOT NULL")
    size = F.char_length("z.hits")
    end = F.sum(F.col("z.gaps") + size).over(Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    long = F.col("z.lengths") >= F.element_at(F.array(*map(F.lit, least)), F.col("kind") + 1)
    return rows.select("row", "kind", (end - size).alias("start"), end.alias("end"), F.col("z.hits").alias("token"), long.alias("long")).filter("long").drop("long")


def clear_of_base(spans: DataFrame) -> DataFrame:
    """The tokens (last kind) that overlap no base span."""
    base = F.col("kind") < len(BASE)
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.col("start").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("upto", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(base, F.col("start"))).over(behind))
    return marked.filter(~base & F.coalesce(F.col("upto") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))).drop("upto", "next")


def character_counts(docs: DataFrame, text: str) -> dict[str, int]:
    """How often each character of the alphabets stands in all texts."""
    # pieces, so that a long text is never a list of all its characters
    pieces = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?s).{1,4096}"), F.lit(0))).alias("piece"))
    counts = pieces.select(F.explode(F.split("piece", "")).alias("c")).filter(F.col("c").isin(*UP, *LOW, *DIGITS, *"+/-_")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return {r["c"]: r["n"] for r in counts.collect()}


def frequencies(counts: dict[str, int]) -> list[tuple[float, float]]:
    """For each encoding, the sums of squares and of cubes of its characters' frequencies; alphabets
    without any character count as uniform."""
    out = []
    for _, alphabet, _, folded in ENCODINGS:
        own = [counts.get(c, 0) + (counts.get(c.upper(), 0) if folded and c.isalpha() else 0) for c in alphabet]
        total = sum(own)
        share = [x / total for x in own] if total else [1 / len(own)] * len(own)
        out.append((sum(x**2 for x in share), sum(x**3 for x in share)))
    return out


def tail(z: Column) -> Column:
    """The upper tail of the normal distribution, for z of either sign: Abramowitz and Stegun 26.2.17,
    whose absolute error is below 7.5e-8, to 5 deviations; beyond, the first term of its expansion."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-F.least(a * a, F.lit(1400.0)) / 2) / math.sqrt(2 * math.pi)
    upper = F.when(a <= 5, density * series).otherwise(density / F.greatest(a, F.lit(1.0)))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoded(tokens: DataFrame) -> DataFrame:
    """Adds encoding (its number), its alphabet, bare (the token as that writes it), n and k, the lengths of
    both. Tokens of no encoding go."""
    bare = F.regexp_replace("token", "=+$", "")
    of = F.coalesce(*[F.when(bare.rlike(look), F.lit(i)) for i, (_, _, look, _) in enumerate(ENCODINGS)])
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("encoding") + 1)
    rows = tokens.withColumn("encoding", of).filter("encoding IS NOT NULL").withColumn("alphabet", pick([e[1] for e in ENCODINGS]))
    rows = rows.withColumn("bare", F.when(pick([e[3] for e in ENCODINGS]), F.lower(bare)).otherwise(bare))
    return rows.withColumns({"n": F.char_length("bare").cast("double"), "k": F.char_length("alphabet").cast("double")})


def tested(tokens: DataFrame, known: list[tuple[float, float]]) -> DataFrame:
    """Adds random (Fisher's combined tail of the three tests) and written (the tail under writing).

    tokens: what ``encoded`` gave, written, as what a lambda refers to is computed for each symbol."""
    n, k = F.col("n"), F.col("k")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in known]), F.col("encoding") + 1)
    v = F.transform(F.split("bare", ""), lambda c: F.instr(F.col("alphabet"), c) - 1)
    # equal pairs: in sorted order each symbol makes a pair with every equal one before it
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("pairs"))

    def count(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1.0).otherwise(F.lit(0.0))
        return F.struct(x.alias("last"), run.alias("run"), (acc["pairs"] + run).alias("pairs"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(-1).alias("first"), k.alias("k"), *[F.lit(0.0).alias(c) for c in ("high", "runs", "sum", "squares", "next")])

    def walk(acc: Column, x: Column) -> Column:
        begins = acc["last"] < 0
        up = x * 2 >= acc["k"]
        new = begins | (up != (acc["last"] * 2 >= acc["k"]))
        first = F.when(begins, x).otherwise(acc["first"])
        follows = F.when(begins, F.lit(0)).otherwise(acc["last"] * x)
        return F.struct(x.alias("last"), first.alias("first"), acc["k"].alias("k"), (acc["high"] + up.cast("double")).alias("high"), (acc["runs"] + new.cast("double")).alias("runs"), (acc["sum"] + x).alias("sum"), (acc["squares"] + x * x).alias("squares"), (acc["next"] + follows).alias("next"))

    rows = tokens.withColumns({"pairs": F.aggregate(F.array_sort(v), zero, count, lambda a: a["pairs"]), "w": F.aggregate(v, start, walk)})
    # sums of whole numbers, so what is left of them after the mean is exact for tokens of some thousand symbols
    mean = F.col("w.sum") / n
    square = F.col("w.squares") - mean * F.col("w.sum")
    follows = F.col("w.next") - mean * (2 * F.col("w.sum") - F.col("w.first") - F.col("w.last")) + (n - 1) * mean * mean
    rows = rows.withColumns({"square": F.when(F.col("pairs") < n * (n - 1) / 2, square).otherwise(F.lit(0.0)), "follows": follows})
    # each step is columns of its own, as a column that is used often is not written out again
    df, high = k - 1, F.col("w.high")
    both = 2 * high * (n - high)
    rows = rows.withColumns({"chi": k / n * (2 * F.col("pairs") + n) - n, "both": both, "spread": both * (both - n) / (n * n * (n - 1))})
    none = F.lit(40.0)  # symbols that do not vary
    z_chi = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z_runs = F.when(F.col("spread") > 0, (F.col("w.runs") - F.col("both") / n - 1) / F.sqrt(F.col("spread"))).otherwise(none)
    z_next = F.when(F.col("square") > 0, (F.col("follows") / F.col("square") + 1 / n) * F.sqrt(n)).otherwise(none)
    s, t = pick(0), pick(1)
    expected, variance = n * (n - 1) / 2 * s, n * (n - 1) / 2 * s * (1 - s) + n * (n - 1) * (n - 2) * F.greatest(t - s * s, F.lit(0.0))
    z_written = (expected - F.col("pairs")) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
    rows = rows.withColumns({"z_chi": z_chi, "z_runs": F.abs(z_runs), "z_next": F.abs(z_next), "z_written": z_written})
    rows = rows.withColumns({"p_chi": tail(F.col("z_chi")), "p_runs": tail(F.col("z_runs")), "p_next": tail(F.col("z_next")), "written": tail(F.col("z_written"))})
    least = F.lit(1e-300)
    logs = F.log(F.greatest("p_chi", least)) + F.log(F.greatest(F.least(F.lit(1.0), 2 * F.col("p_runs")), least)) + F.log(F.greatest(F.least(F.lit(1.0), 2 * F.col("p_next")), least))
    rows = rows.withColumn("logs", logs).withColumn("random", F.exp("logs") * (1 - F.col("logs") + F.col("logs") * F.col("logs") / 2))
    return rows.drop("w", "pairs", "square", "follows", "chi", "both", "spread", "z_chi", "z_runs", "z_next", "z_written", "p_chi", "p_runs", "p_next", "logs", "alphabet", "bare")


def discovered(tests: DataFrame) -> DataFrame:
    """The tokens that the false-discovery rule lets through, of those that are as random as a key is."""
    # step i holds the tails in (10^-((i+1)/STEPS), 10^-(i/STEPS)]
    step = F.least(F.lit(DEEPEST * STEPS), F.floor(-F.log10(F.greatest("written", F.lit(1e-300))) * STEPS)).cast("int")
    rows = tests.withColumn("octave", F.floor(F.log2("n")).cast("int")).withColumn("step", step)
    # at most encodings * octaves * steps rows, whatever the number of tokens
    cells = rows.groupBy("encoding", "octave", "step").agg(F.count(F.lit(1)).alias("held"))
    stratum = Window.partitionBy("encoding", "octave")
    falling = stratum.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passing = cells.withColumn("upto", F.sum("held").over(falling)).withColumn("all", F.sum("held").over(stratum)).filter(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE * F.col("upto") / F.col("all"))
    limit = passing.groupBy("encoding", "octave").agg(F.min("step").alias("limit"))
    return rows.join(F.broadcast(limit), ["encoding", "octave"]).filter((F.col("step") >= F.col("limit")) & (F.col("random") >= ACCEPT))


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id), (spans: row, kind as in KINDS, start, end, token, and for random ones their encoding and tails)."""
    scratch = Scratch(spark, "secrets")
    scanned = scratch.write(matches(docs, doc_id, text), "matches")
    spans = scratch.write(located(scanned), "spans")
    base = spans.filter(F.col("kind") < len(BASE))
    tokens = scratch.write(encoded(clear_of_base(spans)), "tokens")
    tests = scratch.write(tested(tokens, frequencies(character_counts(docs, text))), "tests")
    named = F.element_at(F.array(*[F.lit(e[0]) for e in ENCODINGS]), F.col("encoding") + 1)
    added = discovered(tests).select("row", "kind", "start", "end", "token", named.alias("encoding"), "random", "written")
    return scanned.select("row", "doc_id"), base.unionByName(added, allowMissingColumns=True)


def joined(spans: str) -> Column:
    """kind:start:end of sorted (start, kind, end), joined by commas."""
    kind = lambda i: F.element_at(F.array(*map(F.lit, KINDS)), i + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows, spans = scan(spark, docs)
    # a text's spans, which its length bounds
    held = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    both = rows.join(held, "row", "left").withColumn("all", F.coalesce("all", F.expr("array()"))).withColumn("base", F.filter("all", lambda x: x["kind"] < len(BASE)))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return both.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
