"""Hashes of the words of many texts at once, from their bytes, without a Python object for each word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers modulo 2^64: of a word's bytes, its inverse, and of words in a run.
BYTE, RUN = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F
BYTE_INVERSE = pow(BYTE, -1, 1 << 64)


def separators(plain: bool) -> np.ndarray:
    """A byte's code, 0 for separators. plain: ASCII white space separates and the rest is kept; otherwise ASCII
    letters count in lower case and ASCII punctuation separates too."""
    code = np.arange(1, 257, dtype=np.uint64)
    code[[0x20, *range(0x09, 0x0E)]] = 0
    if not plain:
        code[ord("A") : ord("Z") + 1] = code[ord("a") : ord("z") + 1]
        code[[b for b in range(0x80) if not chr(b).isalnum()]] = 0
    return code


RAW, FOLDED = separators(True), separators(False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of a number modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.have = U(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.have) < n:
            more = np.full(max(n, 1 << 16), self.base)  # kept: as long as the longest part so far
            more[0] = 1
            self.have = np.multiply.accumulate(more)
        return self.have[:n]


UP, DOWN = Powers(BYTE), Powers(BYTE_INVERSE)


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    start: np.ndarray  # its first byte in data
    end: np.ndarray
    first: np.ndarray  # of each text, and one more: its first word
    data: np.ndarray  # the texts' bytes


#: Bytes that are looked at together (more if a word is longer): what a byte needs meanwhile is about 40 times its size.
PART = 1 << 18


def _part(value: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words among some bytes' codes; edge: where texts begin, and the end."""
    inside = value != 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    at = np.flatnonzero(edge)
    start[at[at < len(value)]] |= inside[at[at < len(value)]]
    end[at[at > 0] - 1] |= inside[at[at > 0] - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    prefix = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * UP.upto(len(value)), out=prefix[1:])
    return mix((prefix[last] - prefix[first]) * DOWN.upto(len(value))[first]), first, last


def words(texts: pa.Array, code: np.ndarray = RAW) -> Words:
    """The words of an array of large strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    low = 0
    while low < len(data):
        # A part ends behind a separator or a text, so that no word is cut.
        high, size = len(data), PART
        while low + size < len(data):
            some = code[data[low : low + size]]
            cut = int(at[np.searchsorted(at, low + size, "right") - 1])
            apart = np.flatnonzero(some == 0)
            cut = max(cut, low + int(apart[-1]) + 1 if len(apart) else low)
            if cut > low:
                high = cut
                break
            size *= 2
        edge = np.zeros(high - low + 1, bool)
        edge[-1] = True
        i, j = np.searchsorted(at, (low, high))
        edge[at[i:j] - low] = True
        hashes, start, end = _part(code[data[low:high]], edge)
        found.append((hashes, start + low, end + low))
        low = high
    hashes, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, start, end, np.searchsorted(start, at), data)


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words that start at each word, and whether the run lies in one text."""
    n = len(w.hashes)
    total = w.hashes.copy()
    power = 1
    for j in range(1, k):
        power = power * RUN % (1 << 64)
        total[: n - j] += w.hashes[j:] * U(power)
    last = np.repeat(w.first[1:], np.diff(w.first))
    return mix(total), np.arange(n) + k <= last
