"""Six-frame translation with the standard genetic code, whole batches at a time."""

from __future__ import annotations

import numpy as np

from cladeworks.functions.kmers import AMBIGUOUS, DNA_CODE

#: Standard genetic code (fixed values): amino acids of the codons in the order T, C, A, G of each base.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _by_code() -> np.ndarray:
    tcag = {c: i for i, c in enumerate("TCAG")}
    table = np.full(65, ord("X"), np.uint8)
    for i in range(64):
        a, b, c = (tcag["ACGT"[(i >> s) & 3]] for s in (4, 2, 0))
        table[i] = ord(AMINO_ACIDS[16 * a + 4 * b + c])
    return table


_CODON = _by_code()


def six_frames(seq: str) -> list[str]:
    """Frames 0-2 forward, 3-5 of the reverse complement; a codon with a letter other than A, C, G, T is X."""
    codes = DNA_CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if len(codes) < 3:
        return [""] * 6
    out = []
    for strand in (codes, np.where(codes == AMBIGUOUS, AMBIGUOUS, 3 - codes)[::-1].astype(np.uint8)):
        bad = (strand[:-2] == AMBIGUOUS) | (strand[1:-1] == AMBIGUOUS) | (strand[2:] == AMBIGUOUS)
        number = strand[:-2].astype(np.int16) * 16 + strand[1:-1].astype(np.int16) * 4 + strand[2:]
        letters = _CODON[np.where(bad, 64, number)]
        out += [letters[f::3].tobytes().decode("ascii") for f in range(3)]
    return out
