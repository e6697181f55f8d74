"""Words and shingles of many texts at once, on arrays of bytes inside a task.

Texts are taken in slices of a few hundred kilobytes (a longer text is a slice of its own),
so a task holds some tens of megabytes whatever the table. All hashes depend on bytes only
and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 400_000
U64 = np.uint64

with np.errstate(over="ignore"):
    BASE = U64(0x9E3779B97F4A7C15)
    #: random-looking odd multipliers for the words of a shingle
    STEPS = np.array([U64(0xD6E8FEB86659FD93) * U64(2 * i + 1) ^ U64(i * i) for i in range(64)], U64) | U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


#: a random-looking value for each byte
LETTER = mixed(np.arange(1, 257, dtype=U64))


def table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A truth table over bytes from inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low: high + 1] = True
    return out


#: bytes of words: all but white space; letters, digits and everything beyond ASCII
NOT_SPACE = ~table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse mod 2**64, for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, factor in (("up", BASE), ("down", inverse)):
                steps = np.full(size, factor, U64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as bytes) of about `size` bytes each; NULL is empty."""
    held: list[bytes] = []
    first, total = 0, 0
    for k, text in enumerate(texts.cast(pa.large_binary())):
        raw = text.as_py() or b""
        if held and total + len(raw) > size:
            yield first, held
            held, first, total = [], k, 0
        held.append(raw)
        total += len(raw) + 1
    if held:
        yield first, held


class Words:
    """The words of some texts: byte ranges, their texts, and a hash of each."""

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        self.bytes = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = np.concatenate([[False], kind[self.bytes]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edges[0::2], edges[1::2]
        #: first word of each text, and one more
        self.first = np.concatenate([[0], np.searchsorted(self.begin, ends)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.bytes) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.bytes) + 1, U64)
            np.cumsum(LETTER[self.bytes] * up[: len(self.bytes)], out=sums[1:])
            raw = (sums[self.end] - sums[self.begin]) * down[self.begin]
            return mixed(raw + (self.end - self.begin).astype(U64))

    def shingles(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of `size` words inside one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        with np.errstate(over="ignore"):
            total = hashes[:n] * STEPS[0]
            for k in range(1, size):
                total += hashes[k: k + n] * STEPS[k]
        start = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        return start, mixed(total[start] + U64(size))
