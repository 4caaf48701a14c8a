"""What is shown of a text that arrives in pieces: no thinking, no tool calls, found as they close.

A transducer: its state is what a piece can still change. That is the end of the text since the first
marker that is begun but not closed (of a thinking block that is open, only what may begin its end), the
white space held back, and how many characters of what is shown belong to the unclosed marker. So a piece
costs its own length and that of the marker it stands in, however long the text is.

Shown text is given as changes: take ``back`` characters away, then add ``text``. After every piece it is
what ``strip_thinking`` and ``without_tools`` make of the whole, where blocks are closed by their own tags.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions.text import WS

BLANK = re.compile(WS)
THINKING = re.compile(r"<(thinking|thought|think)[^>]*>", re.I | re.A)
TOOL = re.compile(rf"<tool>{WS}*[a-z0-9_.-]+{WS}*</tool>{WS}*(\{{[^}}]*\}}|\[[^\]]*\])?", re.I | re.A)
BRACKET = re.compile(rf"\[{WS}*start{WS}+thinking{WS}*\]", re.I | re.A)
#: What closes a block, by the name of its tag; [ is the one in brackets.
CLOSES = {
    "think": re.compile("</think>", re.I | re.A),
    "thought": re.compile("</thought>", re.I | re.A),
    "thinking": re.compile("</think(?:ing)?>", re.I | re.A),
    "[": re.compile(rf"\[{WS}*end{WS}+thinking{WS}*\]", re.I | re.A),
}


def beginnings(*parts: str) -> re.Pattern:
    """All that a sequence of the parts can begin with: nothing of the last parts, or a part of one. A part
    is a word, letter by letter, or a class with its repetition."""
    out = ""
    for part in reversed(parts):
        if part.startswith("["):
            out = f"{part}{out}" if part.endswith("*") else f"(?:{part}{out})?"
        else:
            for letter in reversed(part):
                out = f"(?:{re.escape(letter)}{out})?"
    return re.compile(out, re.I | re.A)


SPACE, SPACES = f"{WS}*", f"{WS}+"
UNCLOSED_THINKING = (re.compile(r"<(?:think|thought)[^>]*", re.I | re.A), beginnings("<think"), beginnings("<thought"))
UNCLOSED_TOOL = (
    beginnings("<tool>", SPACE, "[a-z0-9_.-]+", SPACE, "</tool>"),
    re.compile(rf"<tool>{WS}*[a-z0-9_.-]+{WS}*</tool>{WS}*(?:\{{[^}}]*|\[[^\]]*)?", re.I | re.A),
)
#: Behind a bracket.
UNCLOSED_BRACKET = beginnings(SPACE, "start", SPACES, "thinking", SPACE)
UNCLOSED_END = beginnings(SPACE, "end", SPACES, "thinking", SPACE)


class State(NamedTuple):
    inside: str = ""  # the open block
    tail: str = ""  # raw text in which a block may begin or end
    call: str = ""  # text without thinking in which a tool call may begin or go on
    begun: bool = False  # whether anything was shown
    gap: str = ""  # white space that is shown only if something follows
    bracketed: bool = False  # one block in brackets is taken out, later ones are text
    volatile: int = 0  # shown characters of what is not settled


def without_thinking(inside: str, tail: str, bracketed: bool) -> tuple[str, str, str, bool]:
    """(text that is surely not thinking, and inside, tail and bracketed behind it)."""
    out = []
    while True:
        if inside:
            close = CLOSES[inside].search(tail)
            if close is None:
                start = tail.rfind("[" if inside == "[" else "<")
                kept = start >= 0 and (UNCLOSED_END.fullmatch(tail, start + 1) is not None if inside == "[" else len(tail) - start < len("</thinking>"))
                return "".join(out), inside, tail[start:] if kept else "", bracketed
            inside, tail = "", tail[close.end() :]
        for mark in re.finditer(r"<" if bracketed else r"[<\[]", tail):
            at = mark.start()
            found = BRACKET.match(tail, at) if tail[at] == "[" else THINKING.match(tail, at)
            if found:
                out.append(tail[:at])
                tail, inside = tail[found.end() :], "[" if tail[at] == "[" else found[1].lower()
                bracketed |= inside == "["
                break
            if UNCLOSED_BRACKET.fullmatch(tail, at + 1) if tail[at] == "[" else any(p.fullmatch(tail, at) for p in UNCLOSED_THINKING):
                return "".join([*out, tail[:at]]), "", tail[at:], bracketed
        else:
            return "".join([*out, tail]), "", "", bracketed


def without_calls(text: str) -> tuple[str, str]:
    """(text without the tool calls that are complete, the text from one on that may go on)."""
    out = []
    while (at := text.find("<")) >= 0:
        found = TOOL.match(text, at)
        if any(p.fullmatch(text, at) for p in UNCLOSED_TOOL):
            return "".join([*out, text[:at]]), text[at:]
        out.append(text[:at] if found else text[: at + 1])
        text = text[found.end() if found else at + 1 :]
    return "".join([*out, text]), ""


def visible(text: str, begun: bool, gap: str) -> tuple[str, bool, str]:
    """(what is shown of the text behind the gap, begun, the new gap)."""
    text = re.sub("\n{3,}", "\n\n", gap + text)
    if not begun:
        text = re.sub(rf"\A{WS}+", "", text)
    end = len(text)
    while end and BLANK.match(text[end - 1]):
        end -= 1
    return text[:end], begun or end > 0, text[end:] if begun or end else ""


def shown(state: State, piece: str | None) -> tuple[int, str, State]:
    """(back, text, state): what one more piece changes of what is shown."""
    said, inside, tail, bracketed = without_thinking(state.inside, state.tail + (piece or ""), state.bracketed)
    settled, call = without_calls(state.call + said)
    text, begun, gap = visible(settled, state.begun, state.gap)
    open_, _, _ = visible(TOOL.sub("", call + ("" if inside else tail)), begun, gap)
    return state.volatile, text + open_, State(inside, tail, call, begun, gap, bracketed, len(open_))
