"""Letter codes, k-letter codes and minimizers of sequences as numpy arrays.

Fixed values in this module: the nucleotide codes, the reduced amino-acid alphabet and the toggle constant.
"""

from __future__ import annotations

import numpy as np

#: Nucleotides (2 bits) and groups of amino acids (4 bits); any other letter is ambiguous.
DNA_GROUPS = ("A", "C", "G", "T")
PROTEIN_GROUPS = ("*UO", "A", "NQS", "C", "DE", "F", "G", "H", "IL", "K", "P", "R", "MV", "T", "W", "Y")
#: Bits flipped before minimizers are ordered.
TOGGLE = 0xE37E28C4271B5A2D
AMBIGUOUS = 255


def _table(groups: tuple[str, ...]) -> np.ndarray:
    t = np.full(256, AMBIGUOUS, np.uint8)
    for code, letters in enumerate(groups):
        for c in letters:
            t[ord(c)] = t[ord(c.lower())] = code
    return t


DNA_CODE, PROTEIN_CODE = _table(DNA_GROUPS), _table(PROTEIN_GROUPS)


def joined(seqs: list[str], table: np.ndarray = DNA_CODE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all sequences, each followed by an ambiguous one, and the end of each (that one included)."""
    raw = ("\n".join(seqs) + "\n").encode("latin-1", "replace")
    ends = np.cumsum(np.fromiter((len(s) + 1 for s in seqs), np.int64, len(seqs)))
    return table[np.frombuffer(raw, np.uint8)], ends


def clean_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """For every start whether the k letters from there are unambiguous."""
    bad = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes == AMBIGUOUS, out=bad[1:])
    return bad[k:] == bad[:-k] if len(codes) >= k else np.empty(0, bool)


def kmers(codes: np.ndarray, k: int, bits: int = 2) -> np.ndarray:
    """Code of the k letters from every start (uint64, k * bits <= 64), by doubling; senseless where not clean."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    c = (codes & ((1 << bits) - 1)).astype(np.uint64)
    size, have, rest, out = 1, 0, k, None
    while rest:
        if rest & 1:
            if out is None:
                out = c.copy()
            else:
                m = n - have - size + 1
                out = (out[:m] << np.uint64(bits * size)) | c[have : have + m]
            have += size
        rest >>= 1
        if rest:
            c = (c[:-size] << np.uint64(bits * size)) | c[size:]
            size *= 2
    return out[: n - k + 1]


def reverse_complement(x: np.ndarray, k: int) -> np.ndarray:
    """Reverse complement of k-letter nucleotide codes."""
    x = ~x
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = ((x >> s) & m) | ((x & m) << s)
    return x >> np.uint64(64 - 2 * k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n = len(x)
    if n < w:
        return x[:0]
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m[: n - w + 1] if size == w else np.minimum(m[: n - w + 1], m[w - size : w - size + n - w + 1])


def seed_mask(length: int, spaces: int) -> str:
    """Spaced-seed template as text: ones, then ``spaces`` times a zero and a one."""
    if not 0 <= spaces <= length // 4:
        raise ValueError("spaces must be between 0 and a quarter of the length")
    return "1" * (length - 2 * spaces) + "01" * spaces


class Scheme:
    """How minimizers are made: k, l, spaced seed, toggle, alphabet."""

    def __init__(self, k: int = 35, l: int = 31, spaces: int = 7, protein: bool = False, toggle: int = TOGGLE, strict: bool = False):
        self.bits = 4 if protein else 2
        if not 0 < l <= k or l > (15 if protein else 31):
            raise ValueError("need 0 < l <= k, and l at most 31 (nucleotides) or 15 (protein)")
        self.k, self.l, self.spaces, self.protein, self.strict = k, l, spaces, protein, strict
        self.table = PROTEIN_CODE if protein else DNA_CODE
        full = (1 << (self.bits * l)) - 1
        letter = (1 << self.bits) - 1
        self.mask = int("".join(f"{letter if c == '1' else 0:0{self.bits}b}" for c in seed_mask(l, spaces)), 2) if spaces else full
        self.toggle = toggle & full

    def ordered(self, codes: np.ndarray) -> np.ndarray:
        """Toggled candidate of every l-letter start; the largest number where it is ambiguous."""
        x = kmers(codes, self.l, self.bits)
        if not self.protein:
            x = np.minimum(x, reverse_complement(x, self.l))
        x = (x & np.uint64(self.mask)) ^ np.uint64(self.toggle)
        return np.where(clean_windows(codes, self.l), x, np.iinfo(np.uint64).max)

    def tokens(self, seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence number, minimizer, ambiguous) of every token, in order.

        A token stands for every end e >= k-1 of a sequence. With r clean letters before and at e it is
        ambiguous if r < k-1 (if r < k when l = k); else it is the least of the last min(r-l+1, k-l+1)
        candidates. So a window is taken one letter before it is whole after an ambiguous letter, unless the
        scheme is ``strict``: then r must be k.
        """
        codes, ends = joined(seqs, self.table)
        starts = np.r_[0, ends[:-1]]
        n = len(codes)
        k, l, w = self.k, self.l, self.k - self.l + 1
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
        order = self.ordered(codes)  # by start; end = start + l - 1
        low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        low[k - 1 :] = sliding_min(order, w)
        good = np.zeros(n, bool)
        good[k - 1 :] = clean_windows(codes, k)
        if w > 1 and not self.strict:
            short = np.zeros(n, bool)
            short[k - 2 :] = clean_windows(codes, k - 1)
            short &= ~good
            early = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            early[k - 2 :] = sliding_min(order, w - 1)
            low = np.where(short, early, low)
            good |= short
        owner = np.repeat(np.arange(len(seqs)), ends - starts)
        at = np.arange(n)
        # the separator is no letter, so a sequence's last end is ends - 2
        real = (at - starts[owner] >= k - 1) & (at < ends[owner] - 1)
        m = low[real] ^ np.uint64(self.toggle)
        return owner[real], m, ~good[real]


def chunks(seqs: list[str], limit: int = 1 << 20):
    """(first, sequences) of about ``limit`` letters together."""
    held, first, size = [], 0, 0
    for i, s in enumerate(seqs):
        if held and size + len(s) > limit:
            yield first, held
            held, first, size = [], i, 0
        held.append(s)
        size += len(s)
    if held:
        yield first, held
