"""What a reader of a token stream sees: differences, what is shown so far, and events up to the end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import markers
from .guard import FALLBACK, feed, truncate_at_loop
from .stateful import stepped


def _delta(stream: str, state: tuple | None, rows: Iterator) -> tuple[tuple, list[tuple]]:
    (posted,), out = state or (0,), []
    for row in rows:
        text = row.text or ""
        if len(text) > posted:
            out.append((stream, row.seq, text[posted:]))
            posted = len(text)
    return (posted,), out


def delta_stream(texts: DataFrame) -> DataFrame:
    """(stream_id, seq, piece): what each cumulative text (stream_id, seq, text) adds to the longest
    before it; one that adds nothing (or is null) gives no row."""
    return stepped(texts.select("stream_id", "seq", "text"), _delta, "posted long", "stream_id string, seq long, piece string")


SHOWN = "inside string, tail string, call string, begun boolean, gap string, bracketed boolean, volatile long"


def _shown(stream: str, state: tuple | None, rows: Iterator) -> tuple[tuple, list[tuple]]:
    held, out = markers.State(*state) if state else markers.State(), []
    for row in rows:
        back, text, held = markers.shown(held, row.piece)
        if back or text:
            out.append((stream, row.seq, back, text))
    return held, out


def displayed(pieces: DataFrame) -> DataFrame:
    """(stream_id, seq, back, text): what each piece changes of what is shown, which is all that was said but
    thinking and tool calls: take ``back`` characters away, add ``text``. Pieces that change nothing give no row."""
    return stepped(pieces.select("stream_id", "seq", "piece"), _shown, SHOWN, "stream_id string, seq long, back long, text string")


def replayed(changes: DataFrame) -> DataFrame:
    """(stream_id, seq, shown): the text after each change, of changes that are all there (no stream)."""
    upto = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.collect_list(F.struct("back", "text")).over(upto)
    cut = lambda shown, x: F.concat(F.left(shown, F.length(shown) - x["back"].cast("int")), x["text"])
    return changes.select("stream_id", "seq", F.aggregate(seen, F.lit(""), cut).alias("shown"))


EVENTS = "stream_id string, seq long, event string, text string, looped boolean"


def _session(stream: str, state: tuple | None, rows: Iterator) -> tuple[tuple | None, list[tuple]]:
    (buffer, checked, tripped), out, ended = state or ("", 0, False), [], False
    for row in rows:
        if row.piece and not tripped:
            buffer, checked, tripped = feed(buffer, checked, row.piece)
            if tripped:
                out.append((stream, row.seq, "retract", f"{buffer}\n\n{FALLBACK}", True))
                out.append((stream, row.seq, "done", buffer, True))
            else:
                out.append((stream, row.seq, "token", row.piece, False))
        if row.done is True or row.done == 1:
            if not tripped:
                out.append((stream, row.seq, "done", truncate_at_loop(buffer), False))
            ended = True
            buffer, checked, tripped = "", 0, False
    return None if ended and not buffer else (buffer, checked, tripped), out


def session(pieces: DataFrame) -> DataFrame:
    """Events of (stream_id, seq, piece, done) and the ``history`` that each adds, if any.

    A piece is a token. A loop gives one retraction, which replaces what was shown and is the
    history, and at once the end, marked looped; what follows is dropped. Else the piece marked done
    gives the end with the finished text, which is the history. The next piece begins anew."""
    asked = pieces.select("stream_id", "seq", "piece", F.coalesce(F.col("done"), F.lit(False)).alias("done"))
    events = stepped(asked, _session, "buffer string, checked long, tripped boolean", EVENTS)
    finished = (F.col("event") == "done") & ~F.col("looped")
    text = F.when(finished, X.strip_thinking(F.col("text"))["text"]).otherwise(F.col("text"))
    said = events.withColumn("text", text)
    return said.withColumn("history", F.when(finished | (F.col("event") == "retract"), F.col("text")))
