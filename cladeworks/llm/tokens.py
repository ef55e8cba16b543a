"""Token counts of many texts under a public byte-level BPE vocabulary.

The vocabulary's own pattern cuts a text into pre-tokens, which are encoded each on its own; so a text's
count is the sum over its pre-tokens. Pre-tokens are found with numpy over code points, and each distinct
one is encoded once per batch and worker. Texts whose cutting is not that regular (an apostrophe that may
begin a contraction, or code points beyond the basic plane) are encoded as a whole. Counts are exact.
"""

from __future__ import annotations

import base64
import os
import unicodedata

import numpy as np

from cladeworks.llm.words import chunks, mix, powers

VOCABULARY = os.environ.get("CLADEWORKS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Cutting pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 0
#: Distinct pre-tokens a worker remembers; beyond that it starts anew (only speed depends on it).
REMEMBER = 2_000_000


def _classes() -> np.ndarray:
    c = np.full(0x10000, _OTHER, np.uint8)
    for i in range(0x10000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            c[i] = _LETTER
        elif k == "N":
            c[i] = _NUMBER
    for i in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        c[i] = _SPACE
    return c


class TokenCounter:
    """Counts tokens; one per worker and vocabulary."""

    _known: dict[str, "TokenCounter"] = {}

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self.seen_hash = np.empty(0, np.uint64)
        self.seen_count = np.empty(0, np.int64)

    @classmethod
    def of(cls, vocabulary: str) -> "TokenCounter":
        if vocabulary not in cls._known:
            cls._known[vocabulary] = cls(vocabulary)
        return cls._known[vocabulary]

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for first, part in chunks(texts, 1 << 19):
            fast = []
            for i, t in enumerate(part):
                if not t:
                    continue
                if len(t) < 1 << 22 and self._regular(t):
                    fast.append(i)
                else:
                    out[first + i] = len(self.encoding.encode_ordinary(t.encode("utf-8", "replace").decode()))
            if fast:
                out[first + np.array(fast)] = self._count([part[i] for i in fast])
        return out

    @staticmethod
    def _regular(t: str) -> bool:
        at = t.find("'")
        while at >= 0:
            # before an apostrophe that begins a pre-token: no contraction may follow it
            if t[at + 1 : at + 2] and t[at + 1] in "strvmld":
                return False
            at = t.find("'", at + 1)
        return t.isascii() or max(t) < "\ud800"

    def _count(self, texts: list[str]) -> np.ndarray:
        # a line end before each text keeps texts apart; its own pre-token is not counted
        sep = "\x00"
        joined = sep.join(texts) + sep
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends_of = np.cumsum(lens)
        cls = self.classes[points]
        stop = ends_of - 1
        cls[stop] = 4  # the separator is a class of its own
        n = len(points)
        begin = np.empty(n, bool)
        begin[0] = True
        np.not_equal(cls[1:], cls[:-1], out=begin[1:])
        # white space before other characters: its last one joins them if it is a blank, else stands alone
        last = np.flatnonzero((cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & (cls[1:] != 4))
        begin[last] = True
        begin[last[points[last] == 0x20] + 1] = False
        start = np.flatnonzero(begin)
        end = np.r_[start[1:], n]
        real = cls[start] != 4
        start, end = start[real], end[real]
        if not len(start):
            return np.zeros(len(texts), np.int64)
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        h = mix((prefix[end] - prefix[start]) * down[start])
        kinds, where, back = np.unique(h, return_index=True, return_inverse=True)
        counts = self._counts(kinds, joined, start[where], end[where])
        return np.bincount(np.searchsorted(ends_of, start, "right"), weights=counts[back], minlength=len(texts)).astype(np.int64)

    def _counts(self, kinds: np.ndarray, joined: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token counts of the distinct pre-tokens joined[start:end]."""
        slot = np.searchsorted(self.seen_hash, kinds)
        slot[slot == len(self.seen_hash)] = 0
        known = self.seen_hash[slot] == kinds if len(self.seen_hash) else np.zeros(len(kinds), bool)
        counts = np.zeros(len(kinds), np.int64)
        counts[known] = self.seen_count[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            one = self.encoding._core_bpe.encode_ordinary if hasattr(self.encoding, "_core_bpe") else self.encoding.encode_ordinary
            counts[new] = [len(one(joined[a:b])) for a, b in zip(start[new].tolist(), end[new].tolist())]
            h = np.r_[self.seen_hash, kinds[new]] if len(self.seen_hash) < REMEMBER else kinds[new]
            c = np.r_[self.seen_count, counts[new]] if len(self.seen_hash) < REMEMBER else counts[new]
            order = np.argsort(h)
            self.seen_hash, self.seen_count = h[order], c[order]
        return counts

