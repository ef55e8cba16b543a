"""Words, hashes and n-grams of many texts at once, as numpy arrays.

A word is a maximal run of a-z and 0-9 of the lower-cased text. Word hashes are polynomial in the bytes,
modulo 2**64, taken from prefix sums, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
#: Bytes of text handled at a time (bounds the memory of a worker).
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (in place on a copy)."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << (max(n, CHUNK) - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Words(NamedTuple):
    buffer: np.ndarray  #: bytes of all texts, parted by a line end
    text: np.ndarray  #: number of the text of each word
    start: np.ndarray  #: first byte of each word
    end: np.ndarray
    hash: np.ndarray  #: uint64

    def word(self, i: int) -> str:
        return self.buffer[self.start[i] : self.end[i]].tobytes().decode()


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about ``limit`` characters together; a longer text is a chunk of its own."""
    held: list[str | None] = []
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and size + n > limit:
            yield first, held
            held, first, size = [], i, 0
        held.append(t)
        size += n
    if held:
        yield first, held


def split_words(texts: list[str | None]) -> Words:
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    inside = _IS_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.r_[0, edge]
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * down[start])
    return Words(data, np.searchsorted(ends_of, start, "right"), start, end, h)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-word runs inside one text, and their hashes."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h *= np.uint64(_BASE)
        h += w.hash[j : j + m]
    at = np.flatnonzero(w.text[:m] == w.text[n - 1 : n - 1 + m])
    return at, mix(h[at])
