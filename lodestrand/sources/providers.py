"""Language models as row sources, behind a provider that callers pass in, and parsers of their answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import first_of_each


#: Lines that begin a question and an answer.
ASKED = re.compile(r"^\s*(?:Q\d*|question)\s*[:.-]\s*(.+)$", re.I | re.A)
TOLD = re.compile(r"^\s*(?:A\d*|answer)\s*[:.-]\s*(.+)$", re.I | re.A)


def parse_pairs(answer: str | None) -> list[tuple[str, str]]:
    """Questions and answers of a JSON array of {"q", "a"} somewhere in the text, where both are strings; or of
    lines. A line that asks begins a pair, all others that say something belong to its answer, with or
    without a mark; lines before the first question are passed over, as is a question without an answer."""
    text = (answer or "").strip()
    found = re.search(r"\[.*\]", text, re.S)
    if found:
        try:
            rows = json.loads(found[0])
        except ValueError:
            rows = None
        if isinstance(rows, list):
            strings = [(r["q"].strip(), r["a"].strip()) for r in rows if isinstance(r, dict) and isinstance(r.get("q"), str) and isinstance(r.get("a"), str)]
            return [p for p in strings if all(p)]
    pairs: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        if asked := ASKED.match(line):
            pairs.append((asked[1].strip(), []))
        elif pairs and line.strip():
            told = TOLD.match(line)
            pairs[-1][1].append((told[1] if told else line).strip())
    return [(q, " ".join(a)) for q, a in pairs if q and a]


def synthesize(chunks: DataFrame, provider: Callable[[str], str], most: int = 200, least_chars: int = 400) -> DataFrame:
    """Question rows that a model writes about the first long chunks; a call that fails skips its chunk."""
    asked = chunks.filter(F.length("text") >= least_chars).orderBy("position", "ordinal").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c in pdf.itertuples():
                try:
                    pairs = parse_pairs(provider(c.text[:4000]))
                except Exception:  # noqa: BLE001 - the provider's own failures
                    continue
                rows += [(c.source, c.position, c.ordinal, i, q, a[:800]) for i, (q, a) in enumerate(pairs)]
            yield pd.DataFrame(rows, columns=["source", "position", "ordinal", "emit", "question", "answer"])

    rows = asked.select("source", "position", "ordinal", "text").mapInPandas(run, "source string, position long, ordinal int, emit int, question string, answer string")
    keyed = rows.withColumns({"kind": F.lit("synth"), "key": F.lower("question")})
    return first_of_each(keyed, ["key"], ["position", "ordinal", "emit"]).drop("key")


def rewards(rows: DataFrame, reward: Callable[[list, list, list], list]) -> DataFrame:
    """Adds the reward that a module's batch function gives: reward(prompts, completions, references)."""

    @F.pandas_udf("double")
    def run(p: pd.Series, c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(reward(p.tolist(), c.tolist(), r.tolist()), dtype=float)

    return rows.withColumn("reward", run("prompt", "completion", "reference"))
