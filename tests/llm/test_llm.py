import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from cladeworks.llm import contamination as CO
from cladeworks.llm import distinct_sketch as DS
from cladeworks.llm import mixing as MX
from cladeworks.llm import near_dup as ND
from cladeworks.llm import pieces as PC
from cladeworks.llm import repetition as RP
from cladeworks.llm import shared_spans as SS
from cladeworks.llm.mail import visible_segments
from cladeworks.llm.words import ngrams, split_words

WORDS = re.compile("[a-z0-9]+")


# ---- words ------------------------------------------------------------------------------------------------


def test_words_and_ngrams():
    texts = ["Ab, cd-9 Ärger x", None, "", "cd ab", "ABC" * 10, "ab cd 9 ab cd 9"]
    w = split_words(texts)
    got = [[w.word(i) for i in np.flatnonzero(w.text == t)] for t in range(len(texts))]
    assert got == [WORDS.findall((t or "").lower()) for t in texts]
    one = {w.word(i): w.hash[i] for i in range(len(w.hash))}
    assert len(set(one.values())) == len(one) and all(w.hash[i] == one[w.word(i)] for i in range(len(w.hash)))
    at, h = ngrams(w, 3)
    text = [" ".join(w.word(j) for j in range(i, i + 3)) for i in at]
    assert len(set(zip(text, h.tolist()))) == len(set(text)) == len(set(h.tolist()))


# ---- 1 ----------------------------------------------------------------------------------------------------

HITS = "cand bigint, t timestamp, s string, b string, day string, sketch int"


def _hits(n, seed=1):
    random.seed(seed)
    return [(random.choice([None, 7, 7, 7, -random.randrange(3000), random.randrange(3000)]), random.choice([None, datetime(2024, 1, 1 + random.randrange(3))]), random.choice([None, "", "u", "v"]), random.choice("xy"), "z", 1) for _ in range(n)]


def test_sketch_counts(spark):
    rows = _hits(6000)
    df = spark.createDataFrame(rows, HITS)
    k = 128
    got = DS.with_estimates(DS.kmv_sketches(df, "cand", "t", ["s", "b"], k), k).collect()
    assert len(got) == len({(g.grouping, g.day, g.s, g.b) for g in got})
    inside = 0
    for g in got:
        dims = g.grouping.split(",")
        mine = [r for r in rows if ("day" not in dims or (r[1] and r[1].date()) == g.day) and ("s" not in dims or r[2] == g.s) and ("b" not in dims or r[3] == g.b)]
        true = len({r[0] for r in mine} - {None})
        assert g.n_rows == len(mine)
        if g.is_exact:
            assert g.n_distinct == g.lower_bound == g.upper_bound == true
        else:
            inside += g.lower_bound <= true <= g.upper_bound
            assert abs(g.n_distinct - true) < 5 * true / (k - 2) ** 0.5
    assert inside > 0.8 * sum(not g.is_exact for g in got)
    assert DS.kmv_sketches(df.where("false"), "cand", "t", ["s"]).count() == 0


def test_sketch_merge_is_associative(spark):
    df = spark.createDataFrame(_hits(3000), HITS)
    whole = DS.kmv_sketches(df, "cand", "t", [], 64)
    parts = DS.kmv_sketches(df.where("b = 'x'"), "cand", "t", [], 64).unionByName(DS.kmv_sketches(df.where("b = 'y'"), "cand", "t", [], 64))
    merged = DS.merge_sketches(parts, ["grouping", "day"], 64)
    key = lambda r: (r.grouping, str(r.day), r.n_rows, bytes(r.sketch))
    assert sorted(map(key, whole.collect())) == sorted(map(key, merged.collect()))


def test_sketch_set_operations(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**40, 4000), rng.integers(0, 2**40, 3000)
    b[:2000] = a[:2000]
    k = 1024
    sk = [np.sort(np.unique(DS.mix64(x.view(np.uint64))))[:k].astype("<u8").tobytes() for x in (a, b)]
    df = spark.createDataFrame([(bytearray(sk[0]), bytearray(sk[1])), (bytearray(sk[0][:80]), None)], "x binary, y binary")
    r, small = DS.set_operations(df, "x", "y").collect()
    for name, true in (("union", 5000), ("intersection", 2000), ("a_not_b", 2000), ("b_not_a", 1000)):
        assert r[name + "_lower"] * 0.97 <= true <= r[name + "_upper"] * 1.03
    assert (small.union, small.intersection, small.a_not_b, small.union_upper) == (10, 0, 10, 10)


# ---- 4 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_and_overlap(seed):
    random.seed(seed)
    text = "".join(random.choice(["ACGTAC" * 3, "N" * random.randrange(1, 25)]) for _ in range(60))
    gaps = PC.find_gaps(text)
    assert gaps == [(m.start(), len(m.group())) for m in re.finditer("[^ACGTacgt]{10,}", text)]
    starts = np.array([s for s, _ in gaps])
    ends = starts + np.array([n for _, n in gaps])
    p = PC.cut(np.arange(len(text) + 1), ends, 100, 15, starts)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < e - s <= 100 for s, e, _ in p)
    for (s, e, how), (s2, _, _) in zip(p, p[1:]):
        assert s2 == e - 15 and s2 > s
        spots = [x for a, b in zip(starts, ends) for x in range(a, b + 1) if s + 15 < x <= s + 100]
        assert (e == max(spots) and how == "natural") if spots else (e == s + 100 and how == "hard")


def test_pieces_of_sized_tokens():
    sizes = [3, 9, 30, 2, 2, 2, 8]
    p = PC.cut(np.r_[0, np.cumsum(sizes)], np.array([1, 4]), 12, 2)
    assert p[-1][1] == 7 and [x[:2] for x in p][:2] == [(0, 1), (1, 2)]
    assert all(sum(sizes[a:b]) <= 12 or b - a == 1 for a, b, _ in p)


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "ACGT" * 10, 0), (4, "A" * 30 + "N" * 12 + "C" * 30, 0), (4, "A" * 30 + "N" * 12 + "C" * 30, 0)], "k bigint, seq string, piece_no int")
    out = PC.split_sequences(df, "k", "seq", 40, 5)
    assert sorted((r.k, r.piece_start, r.piece_end) for r in out.collect()) == [(2, 0, 0), (3, 0, 40), (4, 0, 40), (4, 0, 40), (4, 35, 72), (4, 35, 72)]
    assert sorted((r.k, r.gap_start, r.gap_len) for r in PC.natural_boundaries(out.where("k = 4"), "k").collect()) == [(4, 30, 12)] * 2
    assert PC.split_sequences(df.where("false"), "k", "seq").count() == 0
    with pytest.raises(ValueError):
        PC.split_sequences(df, "k", "seq", 10, 10)


# ---- 5 ----------------------------------------------------------------------------------------------------


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def _near(rows, shingles):
    sets = {i: shingles(t) for i, t in rows if t is not None}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and _jaccard(sets[a], sets[b]) >= 0.6}


def _dna(s):
    return {s.upper()[i : i + 16] for i in range(len(s) - 15) if re.fullmatch("[ACGT]{16}", s.upper()[i : i + 16])}


def test_near_duplicates(spark):
    random.seed(2)
    base = ["".join(random.choice("ACGT") for _ in range(300)) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "ACGT"), (4, "acgt"), (5, "N" * 200)]
    for i in range(60):
        s = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 3, 5, 8])):
            s[random.randrange(300)] = random.choice("ACGTN")
        rows.append((10 + i, "".join(s).lower() if i % 3 else "".join(s)))
    df = spark.createDataFrame([(i, s, 0, "x") for i, s in rows], "k bigint, seq string, cls int, id string")
    links, members = ND.near_duplicates(df, "k", "seq", ND.SEQ)
    want = _near(rows, _dna)
    assert {(r.id_a, r.id_b) for r in ND.all_pairs(links, members).collect()} == want
    group = {r.id: r.group_id for r in ND.groups(links, members).collect()}
    find = {i: i for i in group}
    for _ in find:
        for a, b in want:
            find[a] = find[b] = min(find[a], find[b])
    # texts without a shingle group with their equals only
    assert {i: g for i, g in group.items() if i >= 10} == {i: g for i, g in find.items() if i >= 10} and group[3] == group[4] == 3
    links, members = ND.near_duplicates(df.where("false"), "k", "seq", ND.SEQ)
    assert ND.all_pairs(links, members).count() == 0 and ND.groups(links, members).count() == 0


def test_near_headers(spark):
    random.seed(3)
    words = [f"w{i}ord" for i in range(80)]
    base = [[random.choice(words) for _ in range(14)] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "abc"), (3, "abcde"), (4, "ABCDE")]
    for i in range(120):
        t = list(random.choice(base))
        for _ in range(random.choice([0, 1, 2, 3])):
            t[random.randrange(14)] = random.choice(words)
        rows.append((10 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "k bigint, header string")
    got = {(r.id_a, r.id_b) for r in ND.all_pairs(*ND.near_duplicates(df, "k", "header", ND.HEADER)).collect()}
    want = _near(rows, lambda t: {t.lower()[i : i + 5] for i in range(len(t) - 4)})
    assert got <= want and len(got) >= 0.99 * len(want) and (3, 4) in got


def test_dense_regions_lose_no_equal_pair():
    n = 500
    data = np.zeros(n, ND.ENTRY)
    data["key"], data["cls"] = 5, np.arange(n)
    a, b = ND.region_pairs(data, dense=16)
    assert len(a) == n * (n - 1) // 2


def _family(n, seed=11):
    """n different headers, edited copies of one."""
    rng = random.Random(seed)
    words = [f"w{i}ord" for i in range(80)]
    base = [rng.choice(words) for _ in range(30)]
    out = set()
    while len(out) < n:
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(30)] = rng.choice(words)
        out.add(" ".join(t))
    return sorted(out)


def _similarities(texts):
    sets = [ND.text_shingles(t) for t in texts]
    place = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(texts), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[g] for g in s]] = 1
    both = m @ m.T
    n = m.sum(axis=1)
    return np.triu(both / (n[:, None] + n[None, :] - both), 1)


def test_a_large_family_keeps_its_pairs():
    texts = _family(1000)
    sim = _similarities(texts)
    want = sim >= 0.6
    table, some = ND.text_signatures(texts, ND.HEADER.trees * ND.HEADER.depth)
    got = np.zeros_like(want)
    for _, rec in ND.entries(np.arange(len(texts)), table, ND.HEADER):
        got[ND.region_pairs(rec)] = True
    assert some.all() and ((sim > 0.6) & (sim < 0.7)).sum() > 1000
    assert (want & got).sum() >= 0.999 * want.sum()


def test_headers_of_stock_phrases_keep_their_pairs():
    rng = random.Random(5)
    code = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for _ in range(1200):
        who = name(14)
        for _ in range(2):
            texts.append(f"kraken:taxid|{code(4)}|zx{code(4)}.1 {who} strain isolated from {name(10)}, complete sequence, whole genome shotgun sequence")
    sim = _similarities(texts)
    want = sim >= 0.6
    table, _ = ND.text_signatures(texts, ND.HEADER.trees * ND.HEADER.depth)
    got, largest = np.zeros_like(want), 0
    for key, rec in ND.entries(np.arange(len(texts)), table, ND.HEADER):
        got[ND.region_pairs(rec)] = True
        largest = max(largest, np.unique(key, return_counts=True)[1].max())
    assert largest > 4 * ND.DENSE and want.sum() > 200
    assert (want & got).sum() >= 0.99 * want.sum()


@pytest.mark.parametrize("members, edits", [(120, 25), (400, 25), (1600, 25), (1600, 10)])
def test_sequence_families_keep_their_pairs(members, edits):
    rng = np.random.default_rng(members + edits)
    base = rng.choice(list("ACGT"), 3000)
    seqs = []
    for _ in range(members):
        s = base.copy()
        s[rng.integers(0, 3000, edits)] = rng.choice(list("ACGT"), edits)
        seqs.append("".join(s))
    table, _ = ND.seq_signatures(seqs, ND.SEQ.trees * ND.SEQ.depth)
    got = set()
    at = rng.integers(0, members, (1500, 2))
    wanted = {(int(min(p)), int(max(p))) for p in at if p[0] != p[1]}
    for _, rec in ND.entries(np.arange(members), table, ND.SEQ):
        for a, b in ND.candidates(rec):
            got |= wanted & set(zip(a.tolist(), b.tolist()))
    sets = {i: ND.seq_shingles(seqs[i]) for p in wanted for i in p}
    sim = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in wanted}
    true = {p for p, x in sim.items() if x >= 0.6}
    assert len(true) > 500 and len(true & got) >= 0.995 * len(true)


def test_further_orders_find_what_whole_comparison_finds():
    rng = np.random.default_rng(3)
    n = 40_000
    sig = rng.integers(0, 256, (n, ND.SIG), dtype=np.uint8)
    sig[:, 0] = 7  # a column that all share
    for i in range(0, 400, 2):  # pairs that agree in 8 or more bytes, and some in 7
        cols = rng.choice(ND.SIG, 7 + i % 5, replace=False)
        sig[i + 1, cols] = sig[i, cols]
    part = np.zeros(n, ND.ENTRY)
    part["cls"] = rng.permutation(n)
    part["sig"] = np.ascontiguousarray(sig).view("V24").reshape(-1)
    assert ND._deepen(n, sig)
    pairs = lambda it: {p for a, b in it for p in zip(a.tolist(), b.tolist())}
    whole = pairs(ND._tile_pairs(part, None, ND.AGREE))
    assert len(whole) > 100 and pairs(ND.candidates(part)) == whole
    over = []
    assert pairs(ND.candidates(part, block=1000, over=over)) == whole and not over


def test_clashing_hashes_are_different_classes(spark, monkeypatch):
    # a normal form whose first hash is the same for all texts
    real = ND.F.xxhash64
    monkeypatch.setattr(ND.F, "xxhash64", lambda *c: real(ND.F.lit(0)) if len(c) == 1 and "upper" in str(c[0]) else real(*c))
    seqs = ["ACGT" * 10, "acgt" * 10, "TTGACCA" * 8, "ACGTACGTAC" * 6, "TTGACCA" * 8]
    df = spark.createDataFrame(list(enumerate(seqs)), "k bigint, seq string")
    _, members = ND.near_duplicates(df, "k", "seq", ND.SEQ)
    cls = {r.id: r.cls for r in members.collect()}
    assert cls[0] == cls[1] and cls[2] == cls[4] and len(set(cls.values())) == 3


def test_very_long_sequences_are_signed_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    seq = "".join(rng.choice(list("ACGTN"), 50_000, p=[0.249] * 4 + [0.004]))
    whole, _ = ND.seq_signatures([seq, "ACGT" * 9], 32)
    monkeypatch.setattr(ND, "CHUNK", 700)
    parts, _ = ND.seq_signatures([seq, "ACGT" * 9], 32)
    assert (whole == parts).all()


def test_regions_in_blocks(spark):
    texts = _family(150)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(_similarities(texts) >= 0.6))}
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, header string")
    got = {(r.id_a, r.id_b) for r in ND.all_pairs(*ND.near_duplicates(df, "k", "header", ND.HEADER, block=16)).collect()}
    assert got <= want and len(got) >= 0.999 * len(want)


def test_components(spark):
    from cladeworks.session import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (200, 202)], "a bigint, b bigint")
    got = {r.cls: r.component for r in ND.components(links, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}


# ---- 7 ----------------------------------------------------------------------------------------------------


def _spans(rows):
    seen = {}
    for r, s in rows:
        for i in range(len(s or "") - 79):
            w = s[i : i + 80].upper()
            if re.fullmatch("[ACGT]{80}", w):
                seen.setdefault(w, set()).add(r)
    out = set()
    for r, s in rows:
        cover = np.zeros(len(s or "") + 1, int)
        for i in range(len(s or "") - 79):
            if len(seen.get(s[i : i + 80].upper(), ())) > 1:
                cover[i : i + 80] = 1
        edge = np.flatnonzero(np.diff(np.r_[0, cover]))
        out |= {(r, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def test_shared_spans(spark):
    random.seed(4)
    rnd = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    x, y, unit = rnd(400), rnd(90), rnd(7)
    rows = [(1, x), (2, rnd(50) + x[100:300] + rnd(30) + y), (3, x[:79] + "N" + y.lower() + rnd(20)), (4, None), (5, ""), (6, "A" * 300), (7, rnd(10) + "a" * 150), (8, unit * 40), (9, unit * 30 + "N" + unit[3:] * 3), (10, rnd(200) * 2), (11, x[:200] + "T" + x[200:]), (12, "N" * 200)]
    rows += [(100 + i, x) for i in range(30)]
    df = spark.createDataFrame([(r, s, 1) for r, s in rows], "k bigint, seq string, start int")
    spans = SS.shared_spans(df, "k", "seq")
    assert {tuple(r) for r in spans.collect()} == _spans(rows)
    shares = {r.k: r for r in SS.shared_shares(df, "k", "seq", spans).collect()}
    assert shares[1].shared_share == 1.0 and shares[4].n_letters == 0 and shares[10].n_shared == 0 and len(shares) == len(rows)
    assert SS.shared_spans(df.where("false"), "k", "seq").count() == 0


def test_long_and_small_slices_give_the_same_spans(monkeypatch):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("ACGT"), 6000))
    rows = [(1, base), (2, base[1000:4000] + "N" + base[:500].lower()), (3, "".join(rng.choice(list("ACGT"), 500)) + base[3000:3100]), (4, "ACAC" * 400), (5, "CACA" * 100 + base[:85])]
    rows += [(10 + i, base[i * 7 : i * 7 + 300]) for i in range(40)]
    want = _spans(rows)
    monkeypatch.setattr(SS, "CHUNK", 400)
    monkeypatch.setattr(SS, "SLICE", 50)
    monkeypatch.setattr(SS, "SHARD_LETTERS", 1000)
    held, kept = [], []
    for i in range(0, len(rows), 7):
        recs, texts, first = SS._pieces(np.array([r for r, _ in rows[i : i + 7]]), [s for _, s in rows[i : i + 7]])
        send, keep = SS.thin(SS.passages(recs, texts, first), i + 1)
        send["chunk"] = i + 1
        held.append(send)
        kept.append(keep)
    places, replies = SS.locate(*SS.confirm(np.concatenate(held)))
    assert len(replies)
    got = SS.merge_places(np.concatenate([places, SS.expand(np.concatenate(kept), replies)]))
    assert {(int(p["rec"]), int(p["start"]), int(p["end"] - p["start"])) for p in got} == want


def test_passages_pack_round_trip():
    random.seed(6)
    seqs = ["".join(random.choice("ACGT") for _ in range(500)) for _ in range(20)]
    p = SS.passages(np.arange(20) * 10**12 - 5, seqs)
    texts = SS._texts(p)
    assert all(t == seqs[(int(r) + 5) // 10**12][s : s + n] for t, r, s, n in zip(texts, p["rec"], p["start"], p["len"]))
    back = np.concatenate([SS.unpack(x) for x in SS.pack(p, 7, 99).column(1).to_pylist()])
    assert set(back["chunk"].tolist()) == {99}
    assert sorted(zip(back["rec"].tolist(), back["start"].tolist(), SS._texts(back))) == sorted(zip(p["rec"].tolist(), p["start"].tolist(), texts))


# ---- 8 ----------------------------------------------------------------------------------------------------


def test_mail():
    mail = "Subject: one\n two\nX: =?utf-8?b?aGVsbG8=?= =?utf-8?q?_world?=\r\nContent-Type: multipart/mixed; boundary=\"b\"\n\npre\n--b\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nun=\ncut =41\n--b\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\nPHA+aGkgPGI+Ym88L2I+bGQ8L3A+\n--b\nContent-Type: application/pdf\n\nxxx\n--b--\npost"
    got = [WORDS.findall(s.lower()) for s in visible_segments(mail)]
    assert got[0][:3] == ["subject", "one", "two"] and "hello" in got[0] and "world" in got[0]
    assert got[1] == ["uncut", "a"] and got[2] == ["hi", "bold"] and len(got) == 3
    assert visible_segments(None) == visible_segments("") == []
    assert visible_segments("no headers here\n\nbody") == ["no headers here\n\nbody"]
    assert "kept" in visible_segments("A: b\nContent-Type: multipart/mixed; boundary=x\n\nkept")[1]
    assert visible_segments("A: b\nContent-Transfer-Encoding: base64\n\n!!!")
    deep = "Content-Type: text/plain\n\nat the bottom"
    for i in range(1500):
        deep = f"Content-Type: multipart/mixed; boundary=b{i}x\n\n--b{i}x\n{deep}\n--b{i}x--"
    assert visible_segments("A: b\n" + deep)[-1] == "at the bottom"


def test_leaks(spark):
    random.seed(7)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, text(random.choice([5, 12, 30, 40]))) for i in range(20)] + [(50, None), (51, [])]
    docs = []
    for i in range(60):
        w = text(random.choice([3, 20, 200]))
        src = random.choice([t for _, t in items if t])
        n = random.choice([8, 11, 12, 15, 40])
        at = random.randrange(max(1, len(src) - n + 1))
        docs.append((i, w[: len(w) // 2] + src[at : at + n] + w[len(w) // 2 :]))
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(d, i) for d, w in docs for i, t in items if t and grams(w) & grams(t)}
    rows = [(d, "H: x\n\n" + " ".join(w).upper(), 0) for d, w in docs] + [(100, None, 0), (101, "", 0), (102, "H: x\n\n" + " ".join(docs[0][1]), 0)]
    want |= {(102, i) for d, i in want if d == 0}
    x = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    y = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in items], "item_id bigint, text string")
    for limit in (CO.BROADCAST_LETTERS, 0):
        got = CO.leaked_items(x, "doc_id", "text", y, "item_id", "text", broadcast_letters=limit)
        assert {tuple(r) for r in got.collect()} == want
        exact = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in CO.contained_items(x, "doc_id", "text", y, "item_id", "text", broadcast_letters=limit).collect()}
        five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for (d, i), n in exact.items():
            a, b = five(dict(docs).get(d, docs[0][1])), five(dict(items)[i])
            assert n == (len(a & b), len(b))
    assert CO.leaked_items(x.where("false"), "doc_id", "text", y, "item_id", "text").count() == 0
    assert CO.leaked_items(x, "doc_id", "text", y.where("false"), "item_id", "text").count() == 0


def test_passages_that_repeat_themselves(spark):
    same, two = "ha " * 12, "a b " * 20
    x = spark.createDataFrame([(1, "H: x\n\n" + "u v w " * 50 + same), (2, "H: x\n\nha ha"), (3, "H: x\n\n" + two)], "doc_id bigint, text string")
    y = spark.createDataFrame([(7, same), (8, two + "and more words than that in this item")], "item_id bigint, text string")
    for limit in (CO.BROADCAST_LETTERS, 0):
        assert {tuple(r) for r in CO.leaked_items(x, "doc_id", "text", y, "item_id", "text", broadcast_letters=limit).collect()} == {(1, 7), (3, 8)}


def test_containment_recall_per_size_class():
    """Least leaks (12 words of a 70-word item) in documents of every size class, found by the bands alone."""
    random.seed(11)
    items = [" ".join(f"i{n}w{random.randrange(10**6)}" for _ in range(70)) for n in range(30)]
    index = CO.ItemIndex(list(range(30)), items, CO.SPAN, CO.SHINGLE)
    found = bins = total = 0
    for size in (13, 20, 40, 100, 300, 1000, 5000):
        docs, want = [], []
        for d in range(120):
            i, at = random.randrange(30), random.randrange(58)
            w = [f"d{random.randrange(10**6)}" for _ in range(size)]
            put = random.randrange(size)
            docs.append(" ".join(w[:put] + items[i].split()[at : at + 12] + w[put:]))
            want.append(i)
        w = split_words(docs)
        got = {(t, i): agree / of for t, i, agree, of in index.candidates(w).tolist()}
        total += len(docs)
        found += sum((t, i) in got for t, i in enumerate(want))
        # the estimate stands for 8 of 66 shingles
        est = [got.get((t, i), 0) for t, i in enumerate(want)]
        assert abs(np.mean(est) - 8 / 66) < 0.03
        n = CO.bins_for(int(CO._class_of(np.array([size + 8]))[0]), (8, 66))
        assert n >= bins
        bins = n
    assert found == total


# ---- 9 ----------------------------------------------------------------------------------------------------


def test_rake():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 1000, 60).astype(float)
    src, lang, topic = (rng.integers(0, n, 60) for n in (4, 3, 5))
    shares, caps = np.array([0.4, 0.3, 0.2, 0.1]), np.array([1.0, 2.0, 3.0, 1.0])
    w = MX.rake(tokens, src, [lang, topic], shares, caps).tokens
    got = np.bincount(src, weights=w)
    assert np.allclose(got / got.sum(), shares) and (w <= tokens * caps[src] + 1e-6).all()
    assert MX.rake(tokens, src, [lang], shares * 0, caps).tokens.sum() == 0
    r = MX.rake(tokens, src, [lang, topic], shares, caps, total=500)
    assert r.at_rest and abs(r.tokens.sum() - 500) < 1e-6 and np.allclose(np.bincount(lang, weights=r.tokens) / 500, np.bincount(lang, weights=tokens) / tokens.sum(), atol=1e-6)
    want = np.array([0.7, 0.2, 0.1])
    r = MX.rake(tokens, src, [lang, topic], shares, caps, total=500, wanted=[want, None])
    assert r.at_rest and np.allclose(np.bincount(lang, weights=r.tokens) / 500, want, atol=1e-6)
    assert np.allclose(np.bincount(topic, weights=r.tokens) / 500, np.bincount(topic, weights=tokens) / tokens.sum(), atol=1e-6)


def test_wanted_languages_and_many_topics(spark):
    from pyspark.sql import functions as F

    random.seed(13)
    docs = [(i, "word " * random.randint(5, 60), random.choice("ab"), random.choice(["en", "de", "fr"]), f"t{random.randrange(40)}") for i in range(3000)]
    df = spark.createDataFrame(docs, "k bigint, text string, source string, lang string, topic string")
    targets = spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = MX.select_mix(df, "k", "text", "source", F.col("lang"), F.col("topic"), targets, total_tokens=20000, language_shares={"en": 1, "de": 3, "xx": 0})
    report = {(r.dimension, r.value): r for r in shares.collect()}
    assert all(r.at_rest for r in report.values()) and sum(d == "topic" for d, _ in report) == 40
    for key, x in ((("source", "a"), 0.75), (("lang", "de"), 0.75), (("lang", "en"), 0.25), (("lang", "xx"), 0.0)):
        assert abs(report[key].reached_share - x) < 0.02
    assert {r.topic for r in chosen.select("topic").distinct().collect()} == {f"t{i}" for i in range(40)}


def test_mix(spark):
    from pyspark.sql import functions as F

    random.seed(8)
    docs = [(i, "word " * random.randint(1, 400), random.choice(["a", "a", "a", "b", "c", None, "x"]), random.choice(["en", "EN ", "de", None, ""]), random.choice(["t1", "t2", None]), 0) for i in range(900)]
    docs += [(1000, None, "a", "en", "t1", 0), (1001, "", "a", "en", "t1", 0), (1002, "'s it's \U0001f600 don't", "b", "en", "t1", 0)]
    df = spark.createDataFrame(docs, "k bigint, text string, source string, lang string, topic string, n_tokens int")
    targets = spark.createDataFrame([("a", 2.0, 1), ("b", 2.0, 2), ("c", 1.0, 4), ("none", 5.0, 9), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = MX.select_mix(df, "k", "text", "source", F.col("lang"), F.col("topic"), targets)
    rows, cap = chosen.collect(), {"a": 1, "b": 2, "c": 4}
    assert rows and all(0 < r.n_copies <= cap[r.source] for r in rows) and len({r.k for r in rows}) == len(rows)
    total = Counter()
    for r in rows:
        total[r.source] += r.n_tokens * r.n_copies
    assert all(abs(total[s] / sum(total.values()) - x) < 0.02 for s, x in (("a", 0.4), ("b", 0.4), ("c", 0.2)))
    report = {(r.dimension, r.value): r for r in shares.collect()}
    assert report["source", "none"].reached_share == 0 and report["source", "a"].n_tokens == total["a"]
    assert {v for d, v in report if d == "lang"} == {"en", "de", "und"} and ("topic", "none") in report
    for empty in ((df.where("false"), targets), (df, targets.where("false"))):
        assert MX.select_mix(empty[0], "k", "text", "source", F.col("lang"), F.col("topic"), empty[1])[0].count() == 0


def test_token_counts_are_exact():
    from cladeworks.llm.tokens import VOCABULARY, TokenCounter

    c = TokenCounter.of(VOCABULARY)
    texts = [None, "", "a  b", "\n\n x", "  ", "x\n", "'s it's don't", "a\t b", "İ é x", "1a!b 2", " \n a", "a b  c", "x''y 'z 'quote'", "\U0001f600 ok", "A" * 3000, "line\r\n\r\nnext  end ", "\x00a\x00", "日本 語1２"]
    random.seed(1)
    texts += ["".join(random.choice(" \n\tab'sZ9é!.　") for _ in range(random.randrange(40))) for _ in range(500)]
    assert c.count(texts).tolist() == [len(c.encoding.encode_ordinary(t)) if t else 0 for t in texts]


# ---- 10 ---------------------------------------------------------------------------------------------------


def _share(text):
    w = WORDS.findall((text or "").lower())
    n = Counter(tuple(w[i : i + 6]) for i in range(len(w) - 5))
    hit = {j for i in range(len(w) - 5) if n[tuple(w[i : i + 6])] >= 3 for j in range(i, i + 6)}
    return len(hit), len(w)


def test_repetition(spark):
    random.seed(9)
    rows = [(0, None), (1, ""), (2, "-- !"), (3, "a a a a a a a a"), (4, "a a a a a a a"), (5, "x " * 3000)]
    for i in range(80):
        w = [f"w{random.randrange(40)}" for _ in range(random.choice([10, 60, 150]))]
        phrase = " ".join(w[:7])
        rows.append((10 + i, " ".join(w) + ("\n" + phrase) * random.choice([0, 1, 2, 3, 6])))
    df = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id bigint, text string, votes string")
    judged = RP.repetition(df, "doc_id", "text").cache()
    got = {r.doc_id: (r.n_repeated, r.n_words) for r in judged.collect()}
    assert got == {i: _share(t) for i, t in rows}
    assert {r.doc_id for r in RP.repetitive(judged, "doc_id").collect()} == {i for i, t in rows if (s := _share(t))[1] and s[0] >= 0.25 * s[1]}
    assert all(0 <= r.posterior <= 1 for r in judged.collect())
    assert RP.repetition(df.where("false"), "doc_id", "text").count() == 0


def test_em_finds_the_accurate_rule():
    random.seed(10)
    n = Counter()
    for _ in range(5000):
        bad = random.random() < 0.15
        votes = [bad and random.random() < 0.9] + [bad if random.random() < p else (not bad) for p in (0.93, 0.85, 0.75, 0.7)]
        n["".join(str(int(v)) if i == 0 or random.random() < 0.8 else "2" for i, v in enumerate(votes))] += 1
    found = RP.fit(dict(n))
    assert found.converged and found.rounds < RP.ROUNDS
    assert abs(found.prior - 0.15) < 0.03 and abs(found.accuracy["spans"][0] - 0.9) < 0.05
    assert abs(found.accuracy["lines"][0] - 0.93) < 0.05 and found.accuracy["lines"][1] > found.accuracy["vocabulary"][1]
    assert found.posterior["11111"] > 0.95 and found.posterior["00000"] < 0.05
    assert RP.fit({}).posterior == {}


def test_strong_vote_is_never_outvoted():
    # every pattern against it, in a corpus where repetition is as rare as the prior allows
    found = RP.fit({"10000": 1, "00000": 10**9, "20000": 10**6})
    assert found.posterior["10000"] >= RP.LIKELY
    found = RP.fit({"1" + f"{x:04b}": 1 for x in range(16)} | {"00000": 10**7})
    assert all(p >= RP.LIKELY for v, p in found.posterior.items() if v[0] == "1")


def test_weak_rules_decide_where_the_measure_abstains(spark):
    df = spark.createDataFrame([(i, f"word{i} other{i} plain{i} text{i} of{i} mail{i} nobody{i} wrote{i} twice{i} in{i} one{i} day{i}") for i in range(60)] + [(100 + i, "buy now cheap. " * 40) for i in range(20)], "doc_id bigint, text string")
    rules = {r.rule: r for r in RP.rule_accuracies(df, "doc_id", "text").collect()}
    assert rules["spans"].n_for == 20 and rules["spans"].converged and abs(rules["spans"].prior - 0.25) < 0.05
    assert {r.doc_id for r in RP.repetition(df, "doc_id", "text").where(f"posterior >= {RP.LIKELY}").collect()} == set(range(100, 120))
