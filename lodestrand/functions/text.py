"""Text expressions, all of them built-in Spark functions.

White space is spelled out as a class, since Java's ``\\s`` is ASCII only; word boundaries are ASCII
look-arounds, since Java's ``\\b`` is not. Lengths count code points. Nulls count as empty text
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it.
WS = r"[\t\n\x0B\f\r    -     　﻿]"
NOT_WS = "[^" + WS[1:]
#: The same, one after the other: what trims take.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Lines that look like commands, and prompts of debuggers and shells.
COMMAND_LINE = r"^(" + WS + r"*(kd>|gdb>|\(gdb\)|\$|#|>|!|0:|" + WS + r"{0,3}[0-9]+[.)]" + WS + r"+`?)|.*`[^`]+`.*\z)"
PROMPT_LINE = r"^(kd>|gdb>|\(gdb\)|\$|#|>)"
PROBE_LINE = r"^(!|kd>|gdb>|\(gdb\)|\$|#|>)"

#: What separates sentences, and how definitions read.
SENTENCE_GAP = r" (?<=[.!?] )(?=[A-Z0-9`\"'(#])"  # of collapsed text; the blank first, as looking behind at each place is slow
DEFINITION = r"^([^\n\r]{3,60}?)" + WS + r"+(is|are|refers? to|means?)" + WS + r"+([^\n\r]+)\z"
DEFINES = (" is ", " are ", " refer to ", " refers to ", " mean ", " means ")  # one of these is in a collapsed definition
TERM_LIKE = r"^(`[^`]+`|\"[^\"]+\"|[A-Z][A-Za-z0-9_.!:+/-]*(" + WS + r"+[A-Z][A-Za-z0-9_.!:+/-]*)*|[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z0-9_]+)+)"

#: Words that are no keywords, in the scorer and in the reward.
STOP_WORDS = (
    "the,a,an,and,or,for,with,from,that,this,these,those,into,using,used,when,which,what,does,have,has,"
    "are,was,were,will,would,should,could,there,their,they,them,then,than,such,also,only,just,like,over,"
    "under,between,through,during,each,other,more,most,some,onto,upon,within,without,about,after,before,"
    "following,site,website,page,pages,explain,key,points"
).split(",")
REWARD_STOP_WORDS = [*[w for w in STOP_WORDS if w != "following"], "answer"]

#: Phrases that admit ignorance.
ADMITS = r"(?i)(don't (have|know)|do not (have|know)|not (covered|in)|couldn't find|can't find|no information|don't cover)"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with the value made once, also where ``use`` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fitting(value: Column, fits) -> Column:
    """One row with the value where ``fits(value)``, else none. A filter behind a selection is pushed below it,
    so that the value would be made twice; it is not pushed below a generator."""
    return F.explode(F.filter(F.array(value), fits))


def trim(c: Column) -> Column:
    """Both ends, all white space; Spark's own trim takes blanks alone, where it is told nothing else."""
    return F.btrim(c, F.lit(BLANKS))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank. Visible ASCII is told by one range, and lone blanks, as nearly all are, stay."""
    return F.regexp_replace(c, rf"[^!-~](?:(?<= ){WS}+|(?<=[{WS[1:-1].replace(' ', '', 1)}]){WS}*)", " ")


def half_up(c: Column, digits: int) -> Column:
    """floor(x * 10**d + 0.5) / 10**d; Spark's round works on the decimal expansion instead."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def hash_byte(c: Column) -> Column:
    """The number that the first two hex digits of a hash spell."""
    return F.conv(F.substring(c, 1, 2), 16, 10).cast("int")


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the code points of a string, as an unsigned 32-bit number in a long."""
    points = F.transform(F.split(c, "", -1), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(c) > 0, F.aggregate(F.filter(points, lambda x: x.isNotNull()), F.lit(2166136261).cast("long"), step)).otherwise(F.lit(2166136261).cast("long"))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def full_lines(c: Column) -> Column:
    return F.filter(F.transform(lines(c), trim), lambda x: x != "")


def clean_text(c: Column) -> Column:
    """Text of files that are not HTML: fences on lines of their own, blanks collapsed, blank and
    import/export lines dropped, entities decoded (ampersands first)."""
    t = F.regexp_replace(F.regexp_replace(text(c), "```", "\n```\n"), "[ \t]+", " ")
    kept = F.filter(F.transform(lines(t), trim_end), lambda x: (trim(x) != "") & ~trim(x).rlike(rf"^(import|export){WS}+[^\n\r]*from{WS}+[\"']"))
    t = trim(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))
    return F.replace(F.replace(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(collapse(text(c)), SENTENCE_GAP, -1), lambda s: F.trim(s)), lambda s: s != "")


def compress(c: Column, max_chars: int = 600, max_sentences: int = 4) -> Column:
    """Leading sentences of ten characters or more, while they fit; the first always does."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        stop = acc["full"] | (acc["n"] >= max_sentences)
        skip = F.length(s) < 10
        over = (acc["used"] + F.length(s) + 1 > max_chars) & (acc["n"] > 0)
        joined = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["out"], F.lit(" "), s))
        keep = ~stop & ~skip & ~over
        return F.struct(
            F.when(keep, joined).otherwise(acc["out"]).alias("out"),
            F.when(keep, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(keep, acc["used"] + F.length(s) + 1).otherwise(acc["used"]).alias("used"),
            (stop | (~skip & over)).alias("full"),
        )

    return F.aggregate(sentences(c), start, add, lambda acc: acc["out"])


def command_density(c: Column) -> Column:
    """Lines that look like commands, of all full lines; headings count as lines only."""
    hits = lambda full: F.filter(full, lambda x: ~x.rlike(rf"^#{{1,4}}{WS}") & x.rlike(COMMAND_LINE))
    return let(full_lines(text(c)), lambda full: F.when(F.size(full) > 0, F.size(hits(full)) / F.size(full)).otherwise(F.lit(0.0)))


def first_by_lower(terms: Column) -> Column:
    """Distinct strings, case aside, each as it first appears; those of one character are dropped."""
    long_enough = F.filter(terms, lambda t: F.length(t) >= 2)
    add = lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t))
    return F.aggregate(long_enough, F.array().cast("array<string>"), add)


def keywords(c: Column, most: int = 8, reward: bool = False) -> Column:
    """Code spans, numbers and capitalised words in order, then long words that are no stop words.
    The reward's variant keeps them in lower case and has a stop list of its own."""
    t = text(c)
    named = F.regexp_extract_all(t, F.lit(r"(`[^`]{1,40}`|(?<![A-Za-z0-9_])[0-9][0-9,._-]*(?![A-Za-z0-9_])(?<=[0-9_])|(?<![A-Za-z0-9_])[0-9][0-9,._-]*(?<=[,.\-])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_.!/+:-]{2,})"), F.lit(1))
    named = F.transform(named, lambda x: F.replace(x, F.lit("`"), F.lit("")))
    if reward:
        named = F.transform(named, F.lower)
    stops = F.array(*[F.lit(w) for w in (REWARD_STOP_WORDS if reward else STOP_WORDS)])
    plain = F.filter(F.split(F.lower(t), "[^a-z0-9_]+", -1), lambda w: (F.length(w) > 5) & ~F.array_contains(stops, w))
    head = F.slice(first_by_lower(named), 1, most)
    return F.slice(first_by_lower(F.concat(head, F.when(F.size(head) < most, plain).otherwise(F.array().cast("array<string>")))), 1, most)


def has_loop(c: Column, n: int = 8, repeats: int = 3) -> Column:
    """Whether some run of n words, case aside, occurs ``repeats`` times; occurrences may overlap."""
    words = F.filter(F.split(F.lower(text(c)), rf"{WS}+", -1), lambda w: w != "")
    grams = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    # in sorted order equal runs stand together: compare each with the one repeats - 1 places on
    same = let(F.array_sort(grams), lambda o: F.exists(F.sequence(F.lit(1), F.size(o) - repeats + 1), lambda i: F.element_at(o, i) == F.element_at(o, i + repeats - 1)))
    return F.when(F.size(words) < n * repeats, F.lit(False)).otherwise(same)


def contains_lower(haystack: Column, needle: Column) -> Column:
    return F.contains(haystack, F.lower(needle))


def response_score(output: Column, reference: Column) -> Column:
    """Struct of score, recall, hits, missing, keywords, repetition, length_factor."""
    out, ref = text(output), text(reference)
    terms, low = keywords(ref), F.lower(text(output))
    hits = F.filter(terms, lambda k: contains_lower(low, k))
    recall = F.when(F.size(terms) > 0, F.size(hits) / F.size(terms)).otherwise(F.when(trim(out) != "", 1.0).otherwise(0.0))
    factor = F.when((F.length(ref) > 0) & (F.length(out) > F.length(ref) * 3), 0.5).otherwise(1.0)
    loop = has_loop(out)
    return F.struct(
        half_up(F.when(loop, 0.0).otherwise(recall * factor), 2).alias("score"),
        half_up(recall, 2).alias("recall"),
        hits.alias("hits"),
        F.filter(terms, lambda k: ~contains_lower(low, k)).alias("missing"),
        terms.alias("keywords"),
        loop.alias("repetition"),
        factor.alias("length_factor"),
        F.length(out).alias("output_chars"),
        F.length(ref).alias("reference_chars"),
    )


def faithfulness(output: Column, source: Column, most: int = 12) -> Column:
    """Struct of score, traced, untraced: the output's keywords that its source holds."""
    terms, low = keywords(output, most), F.lower(text(source))
    traced = F.filter(terms, lambda k: contains_lower(low, k))
    return F.struct(half_up(F.when(F.size(terms) > 0, F.size(traced) / F.size(terms)).otherwise(1.0), 2).alias("score"), traced.alias("traced"), F.filter(terms, lambda k: ~contains_lower(low, k)).alias("untraced"))


def conversation_pass(output: Column, kind: Column) -> Column:
    out = text(output)
    full = full_lines(out)
    density = F.when(F.size(full) > 0, F.size(F.filter(full, lambda x: x.rlike(PROBE_LINE))) / F.size(full)).otherwise(0.0)
    return F.when(kind == "greeting", (F.length(out) <= 400) & (density < 0.3)).when(kind == "fallback", out.rlike(ADMITS)).when(kind == "scope", (F.length(out) <= 600) & (density < 0.3)).otherwise(False)


def reward(completion: Column, reference: Column) -> Column:
    """Keyword recall times a length factor; without a reference, how short the completion is."""
    out, ref = text(completion), text(reference)
    terms, low = keywords(ref, reward=True), F.lower(text(completion))
    recall = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda k: contains_lower(low, k))) / F.size(terms)).otherwise(1.0)
    factor = F.when(F.length(out) > F.length(ref) * 3, 0.5).otherwise(1.0)
    return F.when(trim(out) == "", 0.0).when(ref == "", F.least(F.lit(1.0), F.lit(200.0) / F.length(out))).otherwise(half_up(recall * factor, 4))


def judge_score(c: Column) -> Column:
    found = F.regexp_extract(text(c), "([012])", 1)
    return F.when(found != "", found.cast("int"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.lower(text(c)), "/", -1), -1), "[^a-z0-9.]+", "-"), r"^-+|-+\z", "")


def source_url(c: Column) -> Column:
    """The site's path for a source file: its root folder and extension go, an index is its folder."""
    s = F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit("/")), r"^(public|src|docs|content|pages)/", "")
    s = F.regexp_replace(s, r"(?i)\.(md|mdx|txt|html?)\z", "")
    index = s.rlike(r"(?i)(^|/)(index|readme)\z")
    return F.when(index, F.concat(F.lit("/"), F.regexp_replace(s, r"(?i)/(index|readme)\z", ""))).otherwise(F.regexp_replace(F.concat(F.lit("/"), s), "/+", "/"))


def strip_thinking(c: Column) -> Column:
    """Struct (text, stripped) without thinking blocks, closed or cut off."""
    t = text(c)
    out = t
    for tag in ("think", "thought", "thinking"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?is)<(think|thought|thinking)[^>]*>.*\z", "")
    closed = F.regexp_replace(out, r"(?is)\A(.*?)\[\s*start\s+thinking\s*\].*?\[\s*end\s+thinking\s*\]", "$1")
    out = F.when(out.rlike(r"(?is)\[\s*start\s+thinking\s*\].*?\[\s*end\s+thinking\s*\]"), closed).otherwise(F.regexp_replace(out, r"(?is)\[\s*start\s+thinking\s*\].*\z", ""))
    return F.struct(trim(F.regexp_replace(out, "\n{3,}", "\n\n")).alias("text"), (out != t).alias("stripped"))


def clean_title(c: Column) -> Column:
    return F.substring(trim(F.regexp_replace(F.regexp_replace(c, rf"^#{{1,4}}{WS}+", ""), "[*_`#>]", "")), 1, 80)


def is_junk_title(c: Column) -> Column:
    t = text(c)
    filler = rf"(?i)^(the|a|an){WS}+(lab|page|section|overview|introduction|next|rest|goal|result|details|notes|example|part)(?![A-Za-z0-9_])"
    return (F.length(t) < 3) | t.rlike(rf"^(0x[0-9a-fA-F]+|!?[A-Za-z0-9_]+{WS}+0x[0-9a-fA-F]+|```)") | t.rlike(r"^\.\.\.") | t.rlike(filler) | ~t.rlike(r"^([A-Z0-9`\"'(#]|!)")


def clamp(c: Column, low: float, high: float, fallback: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(fallback))))


def render_messages(messages: Column) -> Column:
    """Role tags and contents of an array of (role, content), one after the other."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
