"""Token ids of whole texts with a public tokenizer, encoding each distinct piece once.

A text is cut before white space that follows something else, before marks behind a Latin letter,
and around strings of special tokens; no pre-token of the two byte-level BPE vocabularies crosses
such a place, so the ids of a text are the ids of its pieces in order, as the tokenizer's own
``encode`` of the whole text gives them (special tokens' strings included). Pieces repeat, so they
are encoded once a worker, as long as its bounded cache holds them. A piece of Latin letters
is given to the vocabulary's BPE model directly; others take the tokenizer's whole way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .text import raw

GENERATION = 300_000  # pieces of a cache's generation; a worker keeps two, about 200 bytes a piece
LONGEST_KEPT = 64  # bytes; longer pieces are encoded anew
SLICE = 12 << 20  # bytes of text that are encoded at once
SIMPLE = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;?@[\\]^_`{|}~"))  # no apostrophe, and none that composes with what follows


def cuts(data: np.ndarray, offsets: np.ndarray, whole: Iterable[tuple[int, int]] = ()) -> np.ndarray:
    """Bytes where a piece begins; ``whole``: stretches that are pieces of their own."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    before = data[at - 1]
    # behind a character of several bytes that may be white space itself, no cut
    second = data[np.maximum(at - 2, 0)]
    third = data[np.maximum(at - 3, 0)]
    unsure = (before >= 128) & ((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3)) | ((before >= 0xE1) & (before <= 0xE3)))
    unsure |= (before < 32) | (before == 127)
    at = at[~unsure]
    begins = np.zeros(len(data), bool)
    begins[at] = True
    # marks behind a letter: of ASCII, or of two bytes from 0xC3 on
    mark = np.flatnonzero(MARK[data])
    mark = mark[mark > 0]
    last, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
    letter = ((last | 32) - np.uint8(97) < 26) | ((lead == 0xC3) & (mark > 1) & (last != 0x97) & (last != 0xB7) & (last >= 128))
    begins[mark[letter]] = True
    for a, b in whole:
        begins[a : b + 1] = False
        begins[[a, min(b, len(data) - 1)]] = True, b < len(data)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Encoder:
    """One vocabulary; ``encode`` gives flat ids and where each text's begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # whether words carry the blank before them, and letters their case, is read off the vocabulary
        self.blank = len(self.tokenizer.encode(" a", add_special_tokens=False).ids) and self.tokenizer.encode(" a", add_special_tokens=False).tokens[0] != self.tokenizer.encode("a", add_special_tokens=False).tokens[0]
        self.lower = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.keeps_line = bool(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        # the byte-level alphabet: letters of two bytes become two characters
        shift, spelled = 0, {}
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                spelled[b] = chr(b)
            else:
                spelled[b] = chr(256 + shift)
                shift += 1
        self.spelling = {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.space, self.line = spelled[32], spelled[10]
        strings = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def piece(self, text: bytes) -> bytes:
        """The ids of one piece, as 32-bit numbers."""
        text = text.decode("utf-8")
        m = SIMPLE.fullmatch(text)
        if m is None:
            return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        lead, word = m.groups()
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = word.translate(self.spelling)
        if lead == " " and self.blank:
            ids = self._model(self.space + word)
        elif lead == "\n" and self.keeps_line:
            ids = self._model(self.line) + self._model(word)
        else:
            ids = self._model(word)
        return array("i", ids).tobytes()

    def known(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each piece: from the younger generation, the older one, or made now."""
        found = list(map(self.young.get, parts))
        for i, ids in enumerate(found):
            if ids is None:
                part = parts[i]
                ids = self.old.get(part)
                found[i] = ids = self.piece(part) if ids is None else ids
                if len(part) <= LONGEST_KEPT:
                    self.young[part] = ids
                    if len(self.young) >= GENERATION:
                        self.old, self.young = self.young, {}
        return found

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens' strings stand, each within one text."""
        if self.special is None:
            return []
        at = [m.span() for m in self.special.finditer(data.tobytes())]
        text = np.searchsorted(offsets, [a for a, _ in at], "right") if at else []
        return [(a, b) for (a, b), t in zip(at, text, strict=True) if b <= offsets[t]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = cuts(data, offsets, self.specials(data, offsets))
        bounds = np.append(begin, len(data)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        spelled, ends = raw(coded.dictionary)
        spelled, ends = spelled.tobytes(), ends.tolist()
        ids = self.known([spelled[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.int32)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        index = np.asarray(coded.indices)
        count = size[index]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.repeat(first[index] - ends[:-1], count) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(begin, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each text's ids."""
    n = len(first) - 1
    out = np.insert(ids, first[1:], end) if n else ids
    return out, first + np.arange(n + 1)
