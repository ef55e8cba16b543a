import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeworks.functions import columns as C
from cladeworks.functions.hashing import clear_hash_threshold, fmix64
from cladeworks.functions.kmers import AMBIGUOUS, DNA_CODE, Scheme, kmers, reverse_complement, seed_mask
from cladeworks.functions.translate import six_frames
from cladeworks.operators.dust import low_complexity, mask


def scan(s, sc):
    """Letter by letter, with state."""
    out, r, found = [], 0, []
    for e, ch in enumerate(s):
        if sc.table[ord(ch)] == AMBIGUOUS:
            r, found = 0, []
        else:
            r += 1
            if r >= sc.l:
                digits = [int(sc.table[ord(x)]) for x in s[e - sc.l + 1 : e + 1]]
                v = sum(x << sc.bits * i for i, x in enumerate(reversed(digits)))
                if not sc.protein:
                    v = min(v, sum((3 - x) << 2 * i for i, x in enumerate(digits)))
                found.append((v & sc.mask) ^ sc.toggle)
        if e >= sc.k - 1:
            n = r - sc.l + 1
            out.append(None if r < sc.l or n < sc.k - sc.l else min(found[-min(n, sc.k - sc.l + 1) :]) ^ sc.toggle)
    return out


@pytest.mark.parametrize("k,l,spaces,protein", [(10, 5, 1, False), (5, 5, 0, False), (35, 31, 7, False), (6, 5, 0, False), (15, 12, 0, True), (8, 7, 0, True)])
def test_tokens_against_scan(k, l, spaces, protein):
    random.seed(k * 100 + l)
    sc = Scheme(k, l, spaces, protein)
    letters = "ACDEFGHIKLMNPQRSTVWYX*" if protein else "ACGTACGTACGTacgtN"
    seqs = ["".join(random.choice(letters) for _ in range(random.choice([0, 3, k - 1, k, k + 1, 120]))) for _ in range(60)]
    owner, m, amb = sc.tokens(seqs)
    for i, s in enumerate(seqs):
        got = [None if a else int(x) for x, a in zip(m[owner == i], amb[owner == i])]
        assert got == scan(s, sc)


@settings(max_examples=50, deadline=None)
@given(st.text("ACGT", min_size=31, max_size=60))
def test_reverse_complement(s):
    codes = DNA_CODE[np.frombuffer(s.encode(), np.uint8)]
    back = DNA_CODE[np.frombuffer(s.translate(str.maketrans("ACGT", "TGCA"))[::-1].encode(), np.uint8)]
    assert (reverse_complement(kmers(codes, 31), 31)[::-1] == kmers(back, 31)).all()


def test_seed_mask():
    assert seed_mask(31, 5) == "1111111111111111111110101010101"
    with pytest.raises(ValueError):
        seed_mask(8, 3)
    with pytest.raises(ValueError):
        Scheme(20, 21)
    with pytest.raises(ValueError):
        Scheme(40, 32)
    with pytest.raises(ValueError):
        Scheme(20, 16, 0, True)


def test_fmix64():
    def slow(x):
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> 33
            x = x * f % 2**64
        return x ^ x >> 33

    xs = [0, 1, 2**63, 2**64 - 1, 123456789]
    assert fmix64(np.array(xs, np.uint64)).tolist() == [slow(x) for x in xs]
    assert clear_hash_threshold(100, 200) == 0 and clear_hash_threshold(200, 100) == 2**63


def test_six_frames():
    assert six_frames("ATGAAATAG") == ["MK*", "*N", "EI", "LFH", "YF", "IS"]
    assert six_frames("ATGNAA")[0] == "MX" and six_frames("AC") == [""] * 6


def _perfect(s, window, level):
    from collections import Counter
    from fractions import Fraction

    t = [s[i : i + 3] for i in range(len(s) - 2)]
    score = {}
    for i in range(len(t)):
        seen, r = Counter(), 0
        for j in range(i, min(len(t), i + window - 2)):
            r += seen[t[j]]
            seen[t[j]] += 1
            if j > i:
                score[i, j] = Fraction(r, j - i)
    out = [False] * len(s)
    for (i, j), v in score.items():
        if v * 10 > level and all(score[a, b] <= v for a in range(i, j) for b in range(a + 1, j + 1)):
            out[i : j + 3] = [True] * (j + 3 - i)
    return out


def test_dust_against_definition():
    random.seed(5)
    for _ in range(25):
        s = "".join(random.choice("AC" if random.random() < 0.5 else "ACGT") for _ in range(36))
        codes = DNA_CODE[np.frombuffer(s.encode(), np.uint8)]
        for window, level in ((20, 20), (12, 10)):
            assert low_complexity(codes, window, level).tolist() == _perfect(s, window, level)


def test_dust_mask_text():
    assert mask(["acgtNNaaaaaaaaaaaaaaaaaaaaN", "", "ACG"]) == ["ACGTNNaaaaaaaaaaaaaaaaaaaaN", "", "ACG"]
    assert mask(["A" * 30], replace="x") == ["x" * 30]


def test_parsers():
    assert [C.parse_size(x) for x in ("4096", "16 KiB", "2GB", "3 gibibytes", "5kb")] == [4096, 16384, 2 * 10**9, 3 * 2**30, 5000]
    assert C.parse_ranges("1,3-5,..2,9..", 10) == [1, 2, 3, 4, 5, 9, 10] and C.parse_ranges("all", 3) == [1, 2, 3]
    for bad in ("x", "12 parsecs"):
        with pytest.raises(ValueError):
            C.parse_size(bad)
    with pytest.raises(ValueError):
        C.parse_ranges("0", 3)
