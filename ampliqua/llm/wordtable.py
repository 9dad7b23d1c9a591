"""Numbers for the words of many texts at once: an open hash table of short byte strings, kept in numpy arrays.

A key of up to 16 bytes (none of them zero) is two 64-bit integers, padded with zeros, so that equality is exact; longer
keys go through a dictionary. Whole arrays of keys are looked up or added in a few array operations, without an object a
word: a million words take some 50 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Bytes of a key that the arrays hold.
SHORT = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each of these spans (the first 16) as two integers; data has 16 bytes after the last span."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    return words[start] & _MASK[np.minimum(size, 8)], words[start + 8] & _MASK[np.clip(size - 8, 0, 8)]


def gather(arena: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of the arena, put together."""
    ends = np.cumsum(size, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return arena[:0]
    return arena[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]


def parts(text: bytes, most: int) -> list[bytes]:
    """The text, or parts of a very long one: each but the first begins with white space after something else."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(b" ", at + most // 2)
        while cut > at and text[cut - 1 : cut].isspace():
            cut -= 1
        if cut <= at:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def in_blocks(texts: Iterable[bytes], most: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Blocks of about so many bytes: texts or parts of them, and the number of the text that each belongs to."""
    block, owner, filled = [], [], 0
    for k, text in enumerate(texts):
        for part in parts(text, most):
            block.append(part)
            owner.append(k)
            filled += len(part)
            if filled >= most:
                yield block, owner
                block, owner, filled = [], [], 0
    if block:
        yield block, owner


class Arena:
    """An array that grows at its end."""

    def __init__(self, dtype: np.dtype | str, room: int = 1 << 16) -> None:
        self.data, self.n = np.empty(room, dtype), 0

    def extend(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.data):
            grown = np.empty(max(self.n, 2 * len(self.data)), self.data.dtype)
            grown[:at] = self.data[:at]
            self.data = grown
        self.data[at : self.n] = values
        return at


class WordTable:
    """Numbers keys in the order in which they are added, from 0 on."""

    def __init__(self, room: int = 1 << 16) -> None:
        self._make(room)

    def _make(self, room: int) -> None:
        self.n, self.long = 0, {}
        self.first, self.second = np.empty(room, np.uint64), np.empty(room, np.uint64)
        self._make_slots()

    def _make_slots(self) -> None:
        self.bits = int(2 * len(self.first) - 1).bit_length()
        self.slots = np.zeros(1 << self.bits, np.int32)  # number of a key, plus one

    def clear(self) -> None:
        self._make(len(self.first))

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        h = (first ^ (second * _ONE) ^ (second >> np.uint64(29))) * _TWO
        return ((h ^ (h >> np.uint64(32))) * _ONE >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of short keys; -1 of unknown ones."""
        slot = self._slot(first, second)
        number = self.slots[slot] - 1
        miss = (self.first[number] != first) | (self.second[number] != second)  # of an empty slot: the last row, put right below
        todo = np.flatnonzero(miss & (number >= 0))
        number[miss] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            found = self.slots[slot[todo]] - 1
            same = (found >= 0) & (self.first[found] == first[todo]) & (self.second[found] == second[todo])
            number[todo[same]] = found[same]
            todo = todo[~same & (found >= 0)]
        return number

    def _place(self, numbers: np.ndarray) -> None:
        slot, todo = self._slot(self.first[numbers], self.second[numbers]), np.arange(len(numbers))
        while len(todo):
            at, mine = slot[todo], numbers[todo] + 1
            free = self.slots[at] == 0
            self.slots[at[free]] = mine[free]  # of several keys for one slot one stays
            todo = todo[self.slots[at] != mine]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def add(self, first: np.ndarray, second: np.ndarray, long: list[bytes]) -> None:
        """Adds different unknown keys: the short ones get the next numbers, then the long ones."""
        m, total = len(first), self.n + len(first) + len(long)
        if total > len(self.first):
            room = max(total, 2 * len(self.first))
            self.first, self.second = (np.concatenate([x[: self.n], np.zeros(room - self.n, np.uint64)]) for x in (self.first, self.second))
            self._make_slots()
            known = np.arange(self.n, dtype=np.int32)
            known = np.delete(known, np.fromiter(self.long.values(), np.int64, len(self.long)))
            self._place(known)
        self.first[self.n : self.n + m], self.second[self.n : self.n + m] = first, second
        self.first[self.n + m : total] = self.second[self.n + m : total] = 0
        self._place(np.arange(self.n, self.n + m, dtype=np.int32))
        self.long |= {k: self.n + m + j for j, k in enumerate(long)}
        self.n = total

    def lookup(self, raw: bytes, data: np.ndarray, start: np.ndarray, size: np.ndarray, learn: Callable[[list[bytes]], None]) -> np.ndarray:
        """Numbers of the spans of raw (data: the same, and 16 bytes more); learn gets the new keys in the order of their numbers."""
        first, second = lanes(data, start, size)
        number = self.find(first, second)
        big = np.flatnonzero(size > SHORT)
        spans = [raw[s : s + n] for s, n in zip(start[big].tolist(), size[big].tolist(), strict=True)]
        number[big] = [self.long.get(k, -1) for k in spans]
        unknown = np.flatnonzero(number < 0)
        if not len(unknown):
            return number
        rows = unknown[size[unknown] <= SHORT]
        rows = rows[np.lexsort((second[rows], first[rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = (first[rows[1:]] != first[rows[:-1]]) | (second[rows[1:]] != second[rows[:-1]])
        rows, long = rows[new], list({k: None for k in spans if k not in self.long})
        learn([raw[s : s + n] for s, n in zip(start[rows].tolist(), size[rows].tolist(), strict=True)] + long)
        self.add(first[rows], second[rows], long)
        number[unknown] = self.find(first[unknown], second[unknown])
        number[big] = [self.long[k] for k in spans]
        return number
