"""Guards of token streams: loops are cut as they appear, thinking is hidden.

State is kept for each stream, as ``stateful`` says; pieces of one micro-batch are put in order by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .stateful import stepped

#: Fixed value: what is said where a loop was cut.
FALLBACK = "I started repeating myself — let me stop there. Could you rephrase the question?"
EVENTS = "stream_id string, seq long, event string, text string"
STATE = "buffer string, checked long, tripped boolean"
EVERY, TAIL, LEAST = 64, 1200, 200


def loop_onset(text: str, n: int = 8, repeats: int = 3) -> int:
    """Where the second occurrence begins of the first run of n words that occurs ``repeats`` times; -1 if none."""
    words = [(m.group().lower(), m.start()) for m in re.finditer(r"\S+", text)]
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - n + 1):
        at = places.setdefault(tuple(w for w, _ in words[i : i + n]), [])
        at.append(i)
        if len(at) == repeats:
            return words[at[1]][1]
    return -1


def truncate_at_loop(text: str) -> str:
    at = loop_onset(text)
    return text if at < 0 else text[:at].rstrip()


def feed(buffer: str, checked: int, piece: str) -> tuple[str, int, bool]:
    """The buffer with one more piece, how much of it was checked, and whether it loops."""
    buffer += piece or ""
    if len(buffer) - checked < EVERY or len(buffer) < LEAST:
        return buffer, checked, False
    tail = buffer[-TAIL:]
    if len(tail.split()) < 24:
        return buffer, len(buffer), False
    onset = loop_onset(tail)
    if onset < 0:
        return buffer, len(buffer), False
    return buffer[: len(buffer) - len(tail) + onset].rstrip(), len(buffer), True


def _guard(stream: str, state: tuple | None, rows: Iterator) -> tuple[tuple, list[tuple]]:
    (buffer, checked, tripped), out = state or ("", 0, False), []
    for row in rows:
        if tripped:
            break
        buffer, checked, tripped = feed(buffer, checked, row.piece)
        out.append((stream, row.seq, "retract", f"{buffer}\n\n{FALLBACK}") if tripped else (stream, row.seq, "token", row.piece))
    return (buffer, checked, tripped), out


def guarded(pieces: DataFrame) -> DataFrame:
    """Events of a stream of (stream_id, seq, piece): tokens, or once a retraction that replaces what was shown."""
    return stepped(pieces.select("stream_id", "seq", "piece"), _guard, STATE, EVENTS)


def finalized(texts: DataFrame) -> DataFrame:
    """Finished texts cut at their loop, without thinking; thought_aloud tells whether there was any."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else truncate_at_loop(t))

    s = X.strip_thinking(cut(X.text("text")))
    return texts.withColumn("__s", s).select(*[c for c in texts.columns if c != "text"], F.col("__s.text").alias("text"), F.col("__s.stripped").alias("thought_aloud"))
