"""Registered queries over the test tables, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.markdown import html_to_markdown
from ..operators import blend, catalog, corpus, evaluation, qa, retrieval, serving, tools
from ..session import attach, checkpoints
from ..sources import files, store
from ..streaming import guard

FLAGSHIP = "dataset_report"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SITE = "the site"


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(attach(spark), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def stubless(t) -> DataFrame:
    return corpus.without_stubs(t("documents"))


def chunked(t) -> DataFrame:
    return corpus.chunks(stubless(t), "source", "doc_id")


#: SQL that several queries share: trimmed text, windows, and the chunks kept of equal ones.
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WINDOWS = r"""d AS (SELECT * FROM documents WHERE length(text) >= 200),
w AS (SELECT source, doc_id AS position, CAST(i AS INTEGER) AS ordinal, regexp_replace(CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1 + 1800 * i, 2000) END, '^\s+|\s+$', '', 'g') AS text
  FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil(length(text) / 1800.0) AS INTEGER) END)) AS i FROM d)),
c AS (SELECT *, substr(sha256(text), 1, 16) AS hash FROM w WHERE length(text) >= 400),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY hash ORDER BY position, ordinal) = 1)"""
SPLIT = WINDOWS + """,
h AS (SELECT *, CAST('0x' || substr(hash, 1, 2) AS INTEGER) / 255.0 < 0.05 AS own, bool_or(CAST('0x' || substr(hash, 1, 2) AS INTEGER) / 255.0 < 0.05) OVER () AS any_own, row_number() OVER (ORDER BY position, ordinal) AS rn FROM u),
s AS (SELECT source, position, ordinal, text, hash, own OR (NOT any_own AND rn = 1) AS held_out FROM h)"""


@query("SELECT doc_id, source, CAST(length(text) AS BIGINT) AS chars FROM (SELECT *, sum(length(text)) OVER (ORDER BY doc_id) AS upto FROM documents WHERE length(text) >= 200) WHERE upto <= 20000000")
def doc_budget(spark, t):
    return corpus.within_budget(stubless(t), "doc_id", 20_000_000).select("doc_id", "source", F.length("text").cast("long").alias("chars"))


@query(f"WITH {WINDOWS} SELECT source, position, ordinal, text, hash FROM c")
def chunk_windows(spark, t):
    return chunked(t)


@query(f"WITH {WINDOWS} SELECT source, position, ordinal, hash FROM u")
def chunk_dedup(spark, t):
    return corpus.dedup(chunked(t)).select("source", "position", "ordinal", "hash")


@query(f"WITH {SPLIT} SELECT source, held_out, count(*) AS n FROM s GROUP BY ALL")
def holdout_split(spark, t):
    return corpus.holdout(corpus.dedup(chunked(t))).groupBy("source", "held_out").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPLIT} SELECT (SELECT count(*) FROM d) AS docs, (SELECT CAST(sum(length(text)) AS BIGINT) FROM d) AS total_chars, (SELECT count(*) FROM c) AS raw_chunks,
count(*) AS chunks, count(*) FILTER (NOT held_out) AS train, count(*) FILTER (held_out) AS holdout, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS approx_tokens FROM s""")
def dataset_report(spark, t):
    raw = chunked(t)
    return corpus.report(stubless(t), raw, corpus.holdout(corpus.dedup(raw)))


CLEAN = r"""replace(replace(replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, '```', chr(10) || '```' || chr(10)), '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')),
lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(x, '^\s+', ''), '^(import|export)\s+.*from\s+["'']')), chr(10)), '^\s+|\s+$', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"""


@query(f"SELECT doc_id, {CLEAN} AS text FROM documents")
def clean_text(spark, t):
    return t("documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


COMMAND = r"^(\s*(kd>|gdb>|\(gdb\)|\$|#|>|!|0:|\s{0,3}\d+[.)]\s+`?)|.*`[^`]+`.*$)"
LINES = f"list_filter(list_transform(string_split({{0}}, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '')"


def density_sql(c: str) -> str:
    lines = LINES.format(c)
    return rf"CASE WHEN len({lines}) = 0 THEN 0.0 ELSE len(list_filter({lines}, lambda x: NOT regexp_matches(x, '^#{{1,4}}\s') AND regexp_matches(x, '{COMMAND}'))) / CAST(len({lines}) AS DOUBLE) END"


@query(f"SELECT doc_id, CAST({density_sql('text')} AS DOUBLE) AS density FROM documents")
def command_density(spark, t):
    return t("documents").select("doc_id", X.command_density(F.col("text")).alias("density"))


SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '([.!?]) ([A-Z0-9`"''(#])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


def compress_sql(sentences: str, chars: int, most: int) -> str:
    """Sentences of ten characters or more: the prefix that fits, by running lengths."""
    kept = f"list_slice(list_filter({sentences}, lambda s: length(s) >= 10), 1, {most})"
    return f"array_to_string(list_filter({kept}, lambda s, i: i = 1 OR list_sum(list_transform(list_slice({kept}, 1, i), lambda y: length(y) + 1)) <= {chars}), ' ')"


@query(f"""WITH {WINDOWS}, e AS (SELECT source, position, ordinal, text, {compress_sql(SENTENCES.format('text'), 800, 4)} AS answer FROM u WHERE {density_sql('text')} < 0.5)
SELECT source, position, ordinal, 'explain' AS kind, 'Summarize the key points of this {SITE} excerpt in 2-4 sentences:' || chr(10) || chr(10) || substr(text, 1, 800) AS question, answer FROM e WHERE length(answer) >= 60""")
def explain_pairs(spark, t):
    return qa.explain_rows(corpus.dedup(chunked(t)), SITE)


TERM = r"""^(`[^`]+`|"[^"]+"|[A-Z][A-Za-z0-9_.!:+/-]*(\s+[A-Z][A-Za-z0-9_.!:+/-]*)*|[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z0-9_]+)+)"""
DEFINED = r"^(.{3,60}?)\s+(is|are|refers? to|means?)\s+(.+)$"


@query(f"""WITH {WINDOWS}, x AS (SELECT source, position, ordinal, unnest({SENTENCES.format('text')}) AS s, generate_subscripts({SENTENCES.format('text')}, 1) AS emit FROM u WHERE {density_sql('text')} < 0.5),
m AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(s, '{DEFINED}', 1), '[*_`"]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS term FROM x WHERE length(s) <= 300 AND regexp_matches(s, '{DEFINED}')),
q AS (SELECT *, 'What is ' || regexp_replace(term, '\\s+', ' ', 'g') || '?' AS question FROM m WHERE regexp_matches(term, '{TERM}') AND length(term) <= 60 AND length(s) >= 20)
SELECT source, position, ordinal, 'definition' AS kind, question, s AS answer FROM q QUALIFY row_number() OVER (PARTITION BY lower(question) ORDER BY position, ordinal, emit) = 1""")
def definition_qa(spark, t):
    known = qa.with_density(corpus.dedup(chunked(t)))
    return qa.first_questions(qa.definition_rows(known)).select("source", "position", "ordinal", "kind", "question", "answer")


@query()
def html_markdown(spark, t):
    return t("pages").select("page_id", html_to_markdown(F.col("html")).alias("text"))


def page_chunks(t) -> DataFrame:
    pages = t("pages").select("page_id", "url", html_to_markdown(F.col("html")).alias("text"))
    return corpus.retrieval_chunks(pages, "page_id", url=F.col("url"))


@query()
def rag_chunks(spark, t):
    return page_chunks(t)


@query()
def page_questions(spark, t):
    pages = t("pages").select(F.col("url").alias("source"), F.col("page_id").alias("position"), F.lit(0).alias("ordinal"), html_to_markdown(F.col("html")).alias("text"))
    return qa.question_rows(pages, SITE)


FIRST = "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS prompt, coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS reference FROM conversations GROUP BY conv_id"


@query(FIRST)
def conv_first_pair(spark, t):
    return blend.first_pair(t("conversations"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12")
def conv_history_12(spark, t):
    return blend.history_tail(t("conversations")).drop("back")


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def render_turns(spark, t):
    turns = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", X.render_messages(F.col("m")).alias("rendered"))


@query(f"WITH p AS ({FIRST}) SELECT conv_id, prompt, reference, 'seed-grpo' AS kind FROM p WHERE prompt <> '' QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY conv_id) = 1")
def grpo_seed(spark, t):
    return blend.reward_seeds(blend.first_pair(t("conversations")), ["conv_id"], most=None).withColumn("kind", F.lit("seed-grpo"))


@query(f"WITH p AS ({FIRST}), l AS (SELECT list_sort(list(length(reference))) AS v, count(*) AS n FROM p) SELECT n AS count, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS p90, v[n] AS max FROM l")
def answer_char_stats(spark, t):
    return blend.answer_stats(blend.first_pair(t("conversations")), "reference")


@query("SELECT coalesce(lang, 'unknown') AS kind, count(*) AS n FROM documents GROUP BY 1")
def kind_counts(spark, t):
    return blend.kind_counts(t("documents").withColumn("kind", F.col("lang")))


PROBE = r"CASE WHEN len({0}) = 0 THEN 0 ELSE len(list_filter({0}, lambda x: regexp_matches(x, '^(!|kd>|gdb>|\(gdb\)|\$|#|>)'))) / CAST(len({0}) AS DOUBLE) END".format(LINES.format("text"))
ADMITS = X.ADMITS.replace("(?i)", "").replace("'", "''")


@query(f"SELECT conv_id, turn, length(text) <= 400 AND {PROBE} < 0.3 AS greeting, regexp_matches(text, '{ADMITS}', 'i') AS fallback, length(text) <= 600 AND {PROBE} < 0.3 AS scope FROM conversations WHERE role = 'assistant'")
def probe_scores(spark, t):
    said = t("conversations").filter("role = 'assistant'")
    return said.select("conv_id", "turn", *[X.conversation_pass(F.col("text"), F.lit(k)).alias(k) for k in ("greeting", "fallback", "scope")])


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM w WHERE len(w) >= 24),
l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM g GROUP BY doc_id, gram HAVING count(*) >= 3))
SELECT doc_id, doc_id IN (SELECT doc_id FROM l) AS looped FROM documents""")
def loop_detect(spark, t):
    return t("documents").select("doc_id", X.has_loop(F.col("text")).alias("looped"))


def staged_keywords(table: str, key: str, c: str, most: int, name: str, stop_words: list[str] = X.STOP_WORDS) -> str:
    """First appearances, case aside, of named things; then of long plain words that are no stop words."""
    stops = ", ".join(f"'{w}'" for w in stop_words)
    return rf"""{name}_n AS (SELECT {key}, {c} AS t, list_filter(list_transform(regexp_extract_all({c}, '(`[^`]{{1,40}}`|\b\d[\d,._-]*\b|\b[A-Z][A-Za-z0-9_.!/+:-]{{2,}})', 1), lambda x: replace(x, '`', '')), lambda x: length(x) >= 2) AS xs FROM {table}),
{name}_u AS (SELECT {key}, any_value(x ORDER BY i) AS x, min(i) AS i FROM (SELECT {key}, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM {name}_n) GROUP BY {key}, lower(x)),
{name}_h AS (SELECT {key}, list_slice(list(x ORDER BY i), 1, {most}) AS head FROM {name}_u GROUP BY {key}),
{name}_p AS (SELECT {key}, list_filter(string_split_regex(lower(t), '[^a-z0-9_]+'), lambda x: length(x) > 5 AND x NOT IN ({stops})) AS ys FROM {name}_n),
{name}_a AS (SELECT p.{key}, coalesce(head, []) AS head, CASE WHEN len(coalesce(head, [])) < {most} THEN ys ELSE [] END AS ys FROM {name}_p p LEFT JOIN {name}_h h ON h.{key} = p.{key}),
{name}_b AS (SELECT {key}, list_concat(head, ys) AS zs FROM {name}_a),
{name}_c AS (SELECT {key}, any_value(z ORDER BY i) AS z, min(i) AS i FROM (SELECT {key}, unnest(zs) AS z, generate_subscripts(zs, 1) AS i FROM {name}_b) GROUP BY {key}, lower(z)),
{name} AS (SELECT b.{key}, coalesce(k, []) AS k FROM {name}_b b LEFT JOIN (SELECT {key}, list_slice(list(z ORDER BY i), 1, {most}) AS k FROM {name}_c GROUP BY {key}) USING ({key}))"""


@query(f"WITH {staged_keywords('documents', 'doc_id', 'text', 8, 'kw')} SELECT doc_id, array_to_string(k, '|') AS keywords FROM kw")
def keywords(spark, t):
    return t("documents").select("doc_id", F.array_join(X.keywords(F.col("text")), "|").alias("keywords"))


LOOPED = r"""w AS (SELECT conv_id, list_filter(string_split_regex(lower(reference), '\s+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT conv_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM w WHERE len(w) >= 24),
l AS (SELECT DISTINCT conv_id FROM (SELECT conv_id FROM g GROUP BY conv_id, gram HAVING count(*) >= 3))"""


@query(f"""WITH p AS ({FIRST}), {staged_keywords('p', 'conv_id', 'prompt', 8, 'kw')}, {LOOPED},
r AS (SELECT p.conv_id, CASE WHEN len(k) = 0 THEN (CASE WHEN regexp_replace(reference, '\\s+', '', 'g') <> '' THEN 1.0 ELSE 0.0 END) ELSE len(list_filter(k, lambda x: contains(lower(reference), lower(x)))) / CAST(len(k) AS DOUBLE) END AS recall,
 CASE WHEN length(prompt) > 0 AND length(reference) > 3 * length(prompt) THEN 0.5 ELSE 1.0 END AS factor, p.conv_id IN (SELECT conv_id FROM l) AS repetition FROM p JOIN kw ON kw.conv_id = p.conv_id)
SELECT conv_id, CAST(floor((CASE WHEN repetition THEN 0.0 ELSE CAST(recall AS DOUBLE) * factor END) * 100 + 0.5) / 100 AS DOUBLE) AS score, CAST(floor(recall * 100 + 0.5) / 100 AS DOUBLE) AS recall, repetition FROM r""")
def keyword_recall(spark, t):
    s = X.response_score(F.col("reference"), F.col("prompt"))
    return blend.first_pair(t("conversations")).select("conv_id", s.alias("s")).select("conv_id", "s.score", "s.recall", "s.repetition")


@query(f"""WITH p AS ({FIRST}), {staged_keywords('p', 'conv_id', 'reference', 12, 'kw')}
SELECT p.conv_id, CAST(CASE WHEN len(k) = 0 THEN 1.0 ELSE floor(len(list_filter(k, lambda x: contains(lower(prompt), lower(x)))) / CAST(len(k) AS DOUBLE) * 100 + 0.5) / 100 END AS DOUBLE) AS score, CAST(len(list_filter(k, lambda x: NOT contains(lower(prompt), lower(x)))) AS INTEGER) AS untraced FROM p JOIN kw ON kw.conv_id = p.conv_id""")
def faithfulness(spark, t):
    f = X.faithfulness(F.col("reference"), F.col("prompt"))
    return blend.first_pair(t("conversations")).select("conv_id", f.alias("f")).select("conv_id", "f.score", F.size("f.untraced").alias("untraced"))


@query(f"""WITH p AS ({FIRST}), {staged_keywords('p', 'conv_id', 'prompt', 8, 'kw', X.REWARD_STOP_WORDS)},
r AS (SELECT p.conv_id, prompt, reference, CASE WHEN len(k) = 0 THEN 1.0 ELSE len(list_filter(k, lambda x: contains(lower(reference), lower(x)))) / CAST(len(k) AS DOUBLE) END * CASE WHEN length(reference) > 3 * length(prompt) THEN 0.5 ELSE 1.0 END AS score FROM p JOIN kw ON kw.conv_id = p.conv_id)
SELECT conv_id, CAST(CASE WHEN regexp_replace(reference, '\\s+', '', 'g') = '' THEN 0.0 WHEN prompt = '' THEN least(1.0, 200.0 / length(reference)) ELSE floor(score * 10000 + 0.5) / 10000 END AS DOUBLE) AS reward FROM r""")
def reward(spark, t):
    return blend.first_pair(t("conversations")).select("conv_id", X.reward(F.col("reference"), F.col("prompt")).alias("reward"))


@query("""WITH x AS (SELECT CAST(quality AS DOUBLE) AS q, CAST(1 - toxic AS DOUBLE) AS s, toxic = 1 AS r FROM labels),
b AS (SELECT floor(avg(q) * 1000 + 0.5) / 1000 AS a, count(*) FILTER (q = 0) AS l FROM x), u AS (SELECT floor(avg(s) * 1000 + 0.5) / 1000 AS a, count(*) FILTER (r) AS l FROM x)
SELECT CAST(b.a AS DOUBLE) AS base_avg, b.l AS base_looped, CAST(u.a AS DOUBLE) AS tuned_avg, u.l AS tuned_looped, CAST(floor((u.a - b.a) * 1000 + 0.5) / 1000 AS DOUBLE) AS delta, u.l - b.l AS loop_delta,
floor((u.a - b.a) * 1000 + 0.5) / 1000 < 0 AS regression, b.a - u.a > 0.1 AS dropped, u.l - b.l > 0 AS more_loops FROM b, u""")
def eval_gate(spark, t):
    marks = t("labels")
    shape = lambda score, loop: evaluation.summary(marks.select(score.cast("double").alias("score"), loop.alias("repetition"), F.lit(None).cast("double").alias("faithfulness"), F.lit(None).cast("boolean").alias("converse_pass")))
    return evaluation.gate(shape(F.col("quality"), F.col("quality") == 0), shape(1 - F.col("toxic"), F.col("toxic") == 1))


@query(f"""WITH p AS ({FIRST}), r AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS spot, count(*) OVER () AS n FROM p),
k AS (SELECT * FROM r WHERE spot % greatest(1, n // 30) = 0 AND prompt <> '' AND reference <> '' ORDER BY spot LIMIT 30) SELECT conv_id, prompt, reference, 'mem-' || (row_number() OVER (ORDER BY spot) - 1) AS id FROM k""")
def mem_sample(spark, t):
    return evaluation.stride_sample(blend.first_pair(t("conversations")), ["conv_id"])


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 AS later FROM documents), k AS (SELECT * FROM r ORDER BY later, doc_id LIMIT 30)
SELECT doc_id, source, 'eval-' || (row_number() OVER (ORDER BY later, doc_id) - 1) AS id FROM k""")
def source_spread(spark, t):
    return evaluation.source_spread(t("documents").select("doc_id", "source"), ["doc_id"])


@query("""WITH r AS (SELECT doc_id, lang, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS INTEGER) AS bucket FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS turn FROM r) SELECT doc_id, lang, bucket, turn FROM n ORDER BY turn, bucket LIMIT 5000""")
def blend_round_robin(spark, t):
    docs = t("documents").select("doc_id", "lang")
    lang = F.coalesce("lang", F.lit(""))
    return blend.round_robin([docs.filter(lang == "en"), docs.filter(lang == "de"), docs.filter(~lang.isin("en", "de"))], ["doc_id"], 5000)


@query("""WITH s AS (SELECT CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS INTEGER) AS src_rank, doc_id AS pos, source AS prompt, text AS rejected FROM documents)
SELECT src_rank, pos, prompt FROM s WHERE regexp_replace(prompt, '\\s+', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(prompt, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(coalesce(rejected, ''), '^\\s+|\\s+$', '', 'g')) ORDER BY src_rank, pos) = 1""".replace("\\\\", "\\"))
def pref_merge(spark, t):
    rows = t("documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("prompt"), F.col("text").alias("rejected"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("en"))
    return blend.merged_preferences([rows.filter("en"), rows.filter("NOT en")]).select(F.col("src_rank"), "pos", "prompt")


@query(f"""WITH {WINDOWS}, e AS (SELECT source, position, ordinal, text, {compress_sql(SENTENCES.format('text'), 600, 4)} AS gold FROM u)
SELECT source, position, ordinal, gold AS chosen, substr(text, 1, 2000) AS rejected FROM e WHERE gold <> '' AND length(gold) <= 600 AND length(text) > 2 * length(gold)""")
def pref_concise(spark, t):
    kept = corpus.dedup(chunked(t)).withColumn("source", F.concat_ws("#", "source", "position"))
    rows = kept.select(F.col("position").alias("turn"), "source", "ordinal", F.concat_ws("::", "source", "ordinal").alias("question"), X.fitting(X.compress(F.col("text")), lambda a: a != "").alias("answer"), F.lit("fact-qa").alias("kind"))
    return blend.concise_pairs(rows, kept).select(F.element_at(F.split("source", "#"), 1).alias("source"), F.col("turn").alias("position"), "ordinal", "chosen", "rejected")


@query()
def entity_swap(spark, t):
    return t("documents").select("doc_id", blend.swap_entities(F.col("text")).alias("swapped"))


@query()
def sft_blend(spark, t):
    return blend.sft(corpus.dedup(chunked(t)), SITE).drop("turn", "bucket")


@query()
def preference_rows(spark, t):
    kept = corpus.dedup(chunked(t))
    return blend.preferences(blend.sft(kept, SITE).persist(), kept)


TOKENS = "list_filter(string_split_regex(strip_accents(lower({0})), '[^a-z0-9_]+'), lambda x: length(x) BETWEEN 3 AND 23)"


@query(f"""WITH n AS (SELECT greatest(count(*), 1) AS n FROM documents), k AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS token FROM documents) GROUP BY token)
SELECT token, df, CAST(floor(ln(1 + n / (1 + df)::DOUBLE) * 1000000 + 0.5) / 1000000 AS DOUBLE) AS idf FROM k, n""")
def token_idf(spark, t):
    return retrieval.inverse_frequency(t("documents"), "doc_id").withColumn("idf", X.half_up(F.col("idf"), 6))


FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(token, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"""WITH n AS (SELECT greatest(count(*), 1) AS n FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL),
qf AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL),
idf AS (SELECT token, ln(1 + n / (1 + count(*))::DOUBLE) AS idf FROM tf, n GROUP BY token, n),
hs AS (SELECT token, CAST({FNV} % 512 AS INTEGER) AS bucket FROM (SELECT token FROM tf UNION SELECT token FROM qf)),
dv AS (SELECT doc_id, bucket, sum((1 + ln(tf)) * idf) AS w FROM tf JOIN idf USING (token) JOIN hs USING (token) GROUP BY ALL),
qv AS (SELECT item_id, bucket, sum(1 + ln(tf)) AS w FROM qf JOIN hs USING (token) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dv GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(dv.w / dn.norm * qv.w / qn.norm) AS score FROM dv JOIN dn USING (doc_id) JOIN qv USING (bucket) JOIN qn USING (item_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score >= 0.05)
SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(floor(score * 10000 + 0.5) / 10000 AS DOUBLE) AS score FROM r WHERE rank <= 4""")
def lexical_topk(spark, t):
    found = retrieval.lexical_search(t("documents").withColumn("scope", F.lit(None).cast("string")), t("benchmark"), "doc_id", "item_id")
    return found.select("item_id", "rank", X.half_up(F.col("score"), 4).alias("score"))


def scoped(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("label:"), F.col("label").cast("string")).alias("scope"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), s AS (SELECT q.vec_id AS query, c.vec_id AS item, list_dot_product(c.v, q.v) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.label IN (1, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, item) AS rank FROM s WHERE score >= 0.05) SELECT query, CAST(rank AS INTEGER) AS rank, item, CAST(floor(score * 1000000 + 0.5) / 1000000 AS DOUBLE) AS score FROM r WHERE rank <= 4""")
def dense_topk_scoped(spark, t):
    rows = scoped(t)
    found = retrieval.dense_search(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "vec_id", ["label:1", "label:3"])
    return found.select("query", "rank", "item", X.half_up(F.col("score"), 6).alias("score"))


@query("SELECT count(*) FILTER (label = 2) AS removed, count(*) FILTER (label IS DISTINCT FROM 2) AS remaining FROM embeddings")
def scope_purge(spark, t):
    return retrieval.purge_counts(scoped(t), "label:2")


@query("SELECT DISTINCT coalesce('label:' || label, 'public') AS scope FROM embeddings")
def scope_list(spark, t):
    return retrieval.scope_list(scoped(t))


def fitted(t) -> DataFrame:
    """Parts as models, which name a brand of the library, have a file or are unknown; nations as devices."""
    part, nation = t("part"), t("nation")
    size = F.substring("p_brand", 7, 2).cast("int")
    brands = part.select("p_brand").distinct()
    memory, kind = F.when(size % 2 == 0, size % 9), F.when(size % 3 == 0, "tiny").when(size % 3 == 1, "mid")
    library = brands.select(F.lower("p_brand").alias("name"), (size * 1e8).alias("vram_bytes"), memory.alias("min_memory_gb"), kind.alias("tier"), (size < 20).alias("mobile_ok"), (size < 30).alias("cpu_ok"))
    known, none = F.col("p_size") % 3, F.lit(None).cast("string")
    entries = part.select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.when(known == 0, F.col("p_brand")).alias("base"), *[none.alias(c) for c in ("webllm", "onnx", "gguf")],
        F.when(known == 1, F.col("p_retailprice").cast("double") * 1e6).alias("gguf_bytes"), F.lit(None).cast("double").alias("own_vram_bytes"), F.when(F.col("p_size") % 5 == 0, F.col("p_size") % 7).cast("int").alias("own_min_memory_gb"),
    )
    n = F.col("n_nationkey")
    hardware = nation.select(F.col("n_name").alias("device"), (n % 2 == 0).alias("webgpu"), (n % 3 == 0).alias("mobile"), (n % 12).cast("int").alias("cores"), F.when(n % 4 == 0, n / 2).alias("device_memory_gb"), F.when(n % 5 == 0, F.lit(1 << 31)).alias("max_buffer"))
    return catalog.fit(catalog.requirements(entries, library), hardware)


FITTED = """b AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7, 2) AS INTEGER) AS z FROM part),
l AS (SELECT p_brand, z * 1e8 AS vram, CASE WHEN z % 2 = 0 THEN z % 9 END AS mem, CASE z % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS tier, z < 20 AS mob, z < 30 AS cpu FROM b),
v AS (SELECT p_partkey AS pos, 'm' || p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN nullif(p_size % 7, 0) END AS own, l.*, coalesce(l.vram, CASE WHEN p_size % 3 = 1 THEN round(CAST(p_retailprice AS DOUBLE) * 1e6 * 1.3) END) AS bytes FROM part LEFT JOIN l ON l.p_brand = part.p_brand AND p_size % 3 = 0),
e AS (SELECT pos, id, coalesce(bytes, 0) AS bytes, coalesce(own, mem, CASE WHEN bytes <= 5e8 THEN 1 WHEN bytes <= 1.6e9 THEN 2 WHEN bytes <= 3.2e9 THEN 4 WHEN bytes IS NOT NULL THEN 8 END, 2) AS mem,
 coalesce(tier, CASE WHEN coalesce(bytes, 2e9) < 5e8 THEN 0 WHEN coalesce(bytes, 2e9) < 1.6e9 THEN 1 WHEN coalesce(bytes, 2e9) < 4.5e9 THEN 2 ELSE 3 END) AS tier, coalesce(NOT cpu, coalesce(bytes, 0) > 1e9) AS gpu, coalesce(mob, coalesce(bytes, 0) < 1.5e9) AS mob FROM v),
d AS (SELECT n_name AS device, n_nationkey % 2 = 0 AS webgpu, n_nationkey % 3 = 0 AS mobile, n_nationkey % 12 AS cores, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey / 2.0 END AS told, n_nationkey % 5 = 0 AS roomy FROM nation),
h AS (SELECT *, CASE WHEN told > 0 THEN told WHEN mobile THEN CASE WHEN cores >= 8 THEN 4 ELSE 2 END WHEN webgpu THEN CASE WHEN roomy OR cores >= 8 THEN 8 ELSE 4 END WHEN cores >= 8 THEN 4 ELSE 2 END AS budget FROM d),
o AS (SELECT *, (gpu AND NOT webgpu)::INT + (mem > budget)::INT + (mobile AND NOT mob)::INT AS against FROM e, h)"""


@query(f"WITH {FITTED} SELECT device, id, against = 0 AS ok, against AS reasons FROM o")
def tier_fit_reasons(spark, t):
    return fitted(t).select("device", "id", "ok", F.size("reasons").alias("reasons"))


@query(f"WITH {FITTED} SELECT device, arg_min(id, (-tier, -bytes, pos)) FILTER (against = 0) AS picked, false AS forced FROM o GROUP BY device")
def tier_pick(spark, t):
    return catalog.pick(fitted(t)).select("device", "picked", "forced")


@query("""WITH s AS (SELECT event_type, event_id, value, sum(value) OVER (PARTITION BY event_type) AS total, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events WHERE value > 0),
r AS (SELECT *, sum(value / total) OVER (PARTITION BY event_type ORDER BY rank) AS share FROM s) SELECT event_type, count(*) AS n, min(value) AS least FROM r WHERE share <= 0.9 OR rank = 1 GROUP BY event_type""")
def nucleus(spark, t):
    return evaluation.nucleus(t("events").filter("value > 0"), "event_type", "event_id", "value", 0.9).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))


@query()
def finalized_turns(spark, t):
    return guard.finalized(t("conversations"))


@query("SELECT conv_id, turn, '/' || CASE WHEN role = 'user' THEN 'u' ELSE 'a' END AS url FROM conversations")
def source_urls(spark, t):
    return t("conversations").select("conv_id", "turn", X.source_url(F.concat(F.lit("docs/"), F.when(F.col("role") == "user", "u").otherwise("a"), F.lit(".md"))).alias("url"))



@query(rf"""WITH {WINDOWS}, s AS (SELECT 'lexical-512' || string_agg(source || '#' || position || '#' || ordinal || ':' || length(text) || ':', '' ORDER BY position, ordinal) AS s, count(*) AS n FROM c),
h AS (SELECT n, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h FROM s)
SELECT 'rag:' || ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // CAST(pow(36, i) AS BIGINT) % 36 AS INTEGER) + 1, 1)), ''), '0') || ':' || n AS key FROM h""")
def index_cache_key(spark, t):
    chunks = chunked(t).withColumn("id", F.concat_ws("#", "source", F.col("position").cast("string"), F.col("ordinal").cast("string")))
    return chunks.sparkSession.createDataFrame([(files.index_key(chunks, "lexical-512", ["position", "ordinal"]),)], "key string")


#: Answers of conversations with calls of five kinds put in, by their turn.
ANSWERS = """CASE turn % 5 WHEN 0 THEN text || '<tool> Order</tool> {"turn":' || turn || '}' WHEN 1 THEN text || chr(10) || '<TOOL>' || role || '</TOOL>' WHEN 2 THEN '<tool>order</tool>[1] ' || text
WHEN 3 THEN '<tool>order</tool>{"turn":}' || text ELSE '<tool>a</tool>' || text || '<tool>b</tool>{}' END"""
CALLED = r"(?i)<tool>\s*([a-z0-9_.-]+)\s*</tool>\s*(\{[^}]*\}|\[[^\]]*\])?"


@query(rf"""WITH a AS (SELECT conv_id, turn, {ANSWERS} AS answer FROM conversations),
m AS (SELECT *, regexp_extract_all(answer, '{CALLED}', 1) AS names, regexp_extract_all(answer, '{CALLED}', 2) AS bodies FROM a),
e AS (SELECT *, lower(names[1]) AS name, coalesce(bodies[1], '') AS body, CASE WHEN len(names) > 1 THEN 'more than one tool call in one reply (' || len(names) || ')' WHEN lower(names[1]) NOT IN ('order', 'user') THEN 'tool "' || lower(names[1]) || '" is not available'
 WHEN bodies[1] <> '' AND NOT json_valid(bodies[1]) THEN 'tool arguments were not valid JSON' WHEN bodies[1] LIKE '[%' THEN 'tool arguments must be an object' END AS error FROM m)
SELECT conv_id, turn, CASE WHEN error IS NULL THEN name END AS tool, CASE WHEN error IS NULL THEN CASE body WHEN '' THEN '{{}}' ELSE body END END AS args, error,
 length(regexp_replace(regexp_replace(regexp_replace(answer, '{CALLED}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS shown_chars FROM e""")
def tool_calls(spark, t):
    answers = t("conversations").select("conv_id", "turn", F.expr(ANSWERS).alias("answer"))
    call = tools.tool_call(F.col("answer"), ["order", "user"])
    return answers.withColumn("c", call).select("conv_id", "turn", "c.tool", "c.args", "c.error", F.length(tools.without_tools(F.col("answer"))).cast("long").alias("shown_chars"))


#: What the registry's tools take, for the calls above.
REGISTRY = tools.ToolRegistry({"order": tools.Tool({"turn": "integer"}, ("turn",)), "user": tools.Tool({"name": "string"}, ("name",))})


@query(rf"""WITH a AS (SELECT conv_id, turn, {ANSWERS} AS answer FROM conversations),
m AS (SELECT *, regexp_extract_all(answer, '{CALLED}', 1) AS names, regexp_extract_all(answer, '{CALLED}', 2) AS bodies FROM a),
e AS (SELECT turn, lower(names[1]) AS name, coalesce(bodies[1], '') AS body, CASE WHEN len(names) > 1 THEN 'more than one tool call in one reply (' || len(names) || ')'
 WHEN bodies[1] <> '' AND NOT json_valid(bodies[1]) THEN 'tool arguments were not valid JSON' WHEN bodies[1] LIKE '[%' THEN 'tool arguments must be an object' END AS first FROM m),
f AS (SELECT *, coalesce(first, CASE WHEN name = 'user' AND json_extract(CASE body WHEN '' THEN '{{}}' ELSE body END, '$.name') IS NULL THEN 'arguments rejected: "name" is missing' WHEN name = 'order' AND json_extract(body, '$.turn') IS NULL THEN 'arguments rejected: "turn" is missing'
 WHEN name NOT IN ('user', 'order') THEN 'no tool named "' || name || '" is registered on this page' END) AS error FROM e)
SELECT CASE WHEN first IS NULL THEN name END AS tool, error, count(*) AS n, CAST(sum(CASE WHEN error IS NULL THEN CAST(json_extract(body, '$.turn') AS BIGINT) END) AS BIGINT) AS turns FROM f GROUP BY ALL""")
def tool_checks(spark, t):
    checked = REGISTRY.checked(t("conversations").select("turn", F.expr(ANSWERS).alias("answer")))
    return checked.groupBy("tool", "error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("args", "$.turn", "bigint")).alias("turns"))


#: Parts as model entries, whose graph is a string, an object or not there; one upload a brand.
ENTRY = """'{"id":"p' || p_partkey || '","label":"' || p_name || '","artifacts":{"onnx":' || CASE p_size % 3 WHEN 0 THEN '"org/' || p_size || '"' WHEN 1 THEN '{"id":"org/' || p_size || '","dtype":"fp32"}' ELSE 'null' END || '}}'"""


@query("""WITH m AS (SELECT p_brand AS site, CAST(p_partkey AS INTEGER) AS pos, 'p' || p_partkey AS id, p_name AS label, CASE WHEN p_size % 3 < 2 THEN 'org/' || p_size END AS repo, p_size % 3 = 1 AS nested FROM part),
u AS (SELECT p_brand AS site, CAST(min(p_size) AS VARCHAR) AS name FROM part GROUP BY 1), h AS (SELECT m.site, min(pos) AS hit FROM m JOIN u ON u.site = m.site AND m.repo = 'org/' || u.name GROUP BY 1)
SELECT m.site, pos, id, label, m.repo AS onnx, CASE WHEN nested THEN CASE WHEN pos = hit THEN 'q8' ELSE 'fp32' END END AS dtype, CASE WHEN pos = hit THEN 'tuned' END AS source FROM m LEFT JOIN h ON h.site = m.site
UNION ALL SELECT u.site, -1, u.name, u.name || ' (published ONNX)', 'org/' || u.name, NULL, 'tuned' FROM u LEFT JOIN h ON h.site = u.site WHERE hit IS NULL""")
def manifest_publish(spark, t):
    parts = t("part")
    entries = parts.select(F.col("p_brand").alias("site"), F.col("p_partkey").cast("int").alias("pos"), F.parse_json(F.expr(ENTRY)).alias("entry"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("site_name", "label", "base", "revision")]
    uploads = parts.groupBy(F.col("p_brand").alias("site")).agg(F.min("p_size").alias("size")).select("site", F.concat(F.lit("org/"), F.col("size").cast("string")).alias("repo"), F.lit("q8").alias("dtype"), *nothing)
    e = F.col("entry")
    graph = serving.text_or(e, "$.artifacts.onnx", "id", "repo")
    return serving.publish(entries, uploads).select("site", "pos", serving.at(e, "$.id").alias("id"), serving.at(e, "$.label").alias("label"), graph.alias("onnx"), serving.at(e, "$.artifacts.onnx.dtype").alias("dtype"), serving.at(e, "$.source").alias("source"))


@query(f"""WITH d AS (SELECT * FROM documents WHERE lang IS DISTINCT FROM 'de'), n AS (SELECT greatest(count(*), 1) AS n FROM d),
k AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS token FROM d) GROUP BY token)
SELECT token, df, CAST(floor(ln(1 + n / (1 + df)::DOUBLE) * 1000000 + 0.5) / 1000000 AS DOUBLE) AS idf FROM k, n""")
def index_in_place(spark, t):
    """A stored index made of two batches, one of them added twice, without the scope that is purged."""
    rows = t("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("scope"))
    index = store.StoredIndex.create(spark, f"{checkpoints(spark)}/index-{uuid.uuid4().hex}", "id long, text string, scope string")
    for batch, even in (("even", True), ("odd", False), ("even", True)):
        index.append(rows.filter((F.pmod("id", F.lit(2)) == 0) == even), batch)
    index.purge("de")
    return index.inverse_frequency().withColumn("idf", X.half_up(F.col("idf"), 6))


@query("""WITH c AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type, p_size, p_brand) AS first FROM part)
SELECT l_orderkey AS node, string_agg('p' || first, ',' ORDER BY l_linenumber, l_partkey) AS inputs FROM lineitem JOIN c ON p_partkey = l_partkey GROUP BY l_orderkey""")
def shared_tensors(spark, t):
    """Orders as nodes, their lines' parts as inputs, and parts of one type, size and brand as equal tensors."""
    tensors = t("part").select(F.lit("g").alias("graph"), F.col("p_partkey").alias("pos"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("dtype"), F.array(F.col("p_size").cast("long")).alias("dims"), F.col("p_brand").alias("digest"))
    line = F.struct("l_linenumber", "l_partkey")
    nodes = t("lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"))).alias("inputs"))
    renamed, _ = catalog.share_tensors(nodes.withColumn("graph", F.lit("g")), tensors)
    return renamed.select("node", F.array_join("inputs", ",").alias("inputs"))


@query("""WITH s AS (SELECT c_mktsegment AS query, c_name AS item, floor(c_acctbal / 1000) AS score FROM customer)
SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, lower(item), item) AS INTEGER) AS rank FROM s WHERE score >= 0 QUALIFY rank <= 10""")
def ties_by_collation(spark, t):
    """The ten richest customers of each segment by whole thousands; ties by name."""
    scored = t("customer").select(F.col("c_mktsegment").alias("query"), F.col("c_name").alias("item"), F.floor(F.col("c_acctbal") / 1000).alias("score"))
    return retrieval.best(scored, "query", "item", 10, 0).select("query", "item", "rank")
