"""The 32-bit FNV-1a hash of a long sequence, folded in pieces that compose.

The hash takes one number after the other, so it seems to need the whole sequence in one place. But a run
of n numbers acts on the state h as h * p**n + c[low bits of h] modulo 2**32: a number is put into the low
bits by an exclusive or, which changes the state by an amount that those bits alone decide, and the low
bits of what follows depend on them alone too. So a piece is a multiplier and a table c of 256 numbers (of
65,536 where a number does not fit in a byte), two pieces compose into one, and any cut of the sequence
gives the same hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The hash's first state and its multiplier.
START, PRIME = 0x811C9DC5, 0x01000193
MASK = 0xFFFFFFFF
NARROW, WIDE = 256, 65536
LANES = 256  # runs of a piece that are folded side by side


@dataclass
class Piece:
    """What a run of numbers does to a state."""

    factor: int
    table: np.ndarray  # uint32, indexed by the low bits of the state before the run

    def then(self, other: Piece) -> Piece:
        """This run and then the other."""
        width = max(len(self.table), len(other.table))
        first, second = self.widened(width), other.widened(width)
        low = np.arange(width, dtype=np.uint32)
        after = low * np.uint32(self.factor) + first  # uint32 wraps
        return Piece(self.factor * other.factor & MASK, first * np.uint32(other.factor) + second[after & np.uint32(width - 1)])

    def widened(self, width: int) -> np.ndarray:
        return self.table if len(self.table) == width else np.tile(self.table, width // len(self.table))

    def apply(self, state: int) -> int:
        return (state * self.factor + int(self.table[state & (len(self.table) - 1)])) & MASK

    def bytes(self) -> bytes:
        return self.factor.to_bytes(4, "little") + self.table.tobytes()

    @staticmethod
    def read(data: bytes) -> Piece:
        return Piece(int.from_bytes(data[:4], "little"), np.frombuffer(data, np.uint32, offset=4))


NOTHING = Piece(1, np.zeros(NARROW, np.uint32))


def units(text: str) -> np.ndarray:
    """A text's UTF-16 code units."""
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


def piece(numbers: np.ndarray) -> Piece:
    """The piece of a run of numbers below 65,536."""
    if not len(numbers):
        return NOTHING
    wide = int(numbers.max()) >= NARROW
    width, lanes = (WIDE, 1) if wide else (NARROW, LANES)
    each = len(numbers) // lanes
    prime, low = np.uint32(PRIME), np.arange(width, dtype=np.uint32)
    out = NOTHING
    if each and lanes > 1:
        # every lane starts from every low byte; then the lanes compose
        states = np.tile(low, (lanes, 1))
        for column in np.ascontiguousarray(numbers[: each * lanes].reshape(lanes, each).T.astype(np.uint32)):
            states ^= column[:, None]
            states *= prime
        factor = pow(PRIME, each, 1 << 32)
        for state in states:
            out = out.then(Piece(factor, state - low * np.uint32(factor)))
        numbers = numbers[each * lanes :]
    states = low.copy()
    for number in numbers.astype(np.uint32):
        states ^= number
        states *= prime
    factor = pow(PRIME, len(numbers), 1 << 32)
    return out.then(Piece(factor, states - low * np.uint32(factor)))


def base36(number: int) -> str:
    digits = ""
    while number:
        number, rest = divmod(number, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[rest] + digits
    return digits or "0"
