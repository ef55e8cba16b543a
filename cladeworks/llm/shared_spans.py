"""Long exact spans shared between records, by repeated-phrase automata.

A window is ``SPAN`` consecutive letters, all A, C, G or T, of the upper-cased sequence. Equal windows have an
equal anchor: the least hash among their k-mers. So:

1. each sequence is cut into passages, maximal runs of windows with one anchor (about 110 letters, 2 bits
   each), and the passages are shuffled by anchor. Of passages that two records of one chunk have in common
   only one copy travels; the chunk keeps the list of its places, so a sequence held by very many records is no
   hot spot;
2. per bucket of anchors, recurring passages are confirmed: whole passages found in two records, compared letter
   by letter, and for passages that share an anchor but differ, the runs of windows found in two records, by
   128 bits of hash;
3. the confirmed passages are compiled into Aho-Corasick automata, sharded by size, and all passages of all
   documents are streamed through the automata of their anchor's bucket. A passage can only hold phrases of its own
   anchor, so streaming it through the other automata would find nothing, and the work stays linear in the
   data;
4. every occurrence found by an automaton goes to its record, or, for the copy that stands for several places, to
   the chunk that keeps their list and from there to the records, where the places are merged. No place comes from
   anywhere else.

Very long sequences are cut into pieces that share SPAN - 1 letters: every window lies in one piece.

Defined cases: null, empty and short sequences have no windows; a span repeated only inside one record is
not shared; repeated records share everything; record ids are expected to be distinct (equal ids count as
one record); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions.kmers import clean_windows, joined, kmers, sliding_min
from cladeworks.llm.buckets import SCHEMA, by_bucket, layout, per_bucket
from cladeworks.llm.words import CHUNK, chunks, mix, powers

SPAN, K = 80, 20
#: Most windows in a passage; anchors that last longer (repeats) are cut there.
MOST = SPAN - K + 1
#: Letters compiled into one automaton.
SHARD_LETTERS = 400_000
#: Passages gathered in a task before they are thinned and sent.
FLUSH = 300_000
#: Stands for "two or more records" in place of a record's number.
SEVERAL = np.iinfo(np.int64).min
_WORDS = 9  #: 9 * 16 letters hold the longest passage, SPAN + MOST - 1 = 140 letters
#: Of a copy that stands for several places, ``start`` is its number in the chunk.
PASSAGE = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("rec", "<i8"), ("chunk", "<i8"), ("start", "<i4"), ("len", "<i4"), ("codes", "<u4", (_WORDS,))])
PLACE = np.dtype([("rec", "<i8"), ("start", "<i4"), ("end", "<i4")])
#: A place that a chunk keeps, and an occurrence in one of its copies.
KEPT = np.dtype([("chunk", "<i8"), ("rec", "<i8"), ("start", "<i4"), ("number", "<i4")])
REPLY = np.dtype([("chunk", "<i8"), ("number", "<i4"), ("begin", "<i4"), ("end", "<i4"), ("pad", "<i4")])
#: Passages whose windows are looked at together (about 2 kB each).
SLICE = 20_000


def _text_hash(p: np.ndarray) -> np.ndarray:
    """Hash of the passages' letters."""
    h = p["len"].astype(np.uint64)
    used = (p["len"] + 15) // 16
    for j in range(_WORDS):
        h = np.where(j < used, mix(h + p["codes"][:, j]), h)
    return h


def pack(p: np.ndarray, buckets: int, chunk: int = 0) -> pa.RecordBatch:
    """One row per bucket of anchors: columns one after another, only the words in use, records as differences."""
    at = (p["anchor"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    p, at = p[order], at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    rows = []
    for x, y in zip(first.tolist(), np.r_[first[1:], len(p)].tolist()):
        q = p[x:y]
        one = q["rec"] != SEVERAL
        base = int(q["rec"][one].min()) if one.any() else 0
        gap = np.where(one, q["rec"] - base + 1, 0)
        wide = bool(gap.max() >= 1 << 32)
        used = np.arange(_WORDS) < ((q["len"] + 15) // 16)[:, None]
        head = np.array([len(q), wide, base, chunk], "<i8").tobytes()
        short = (q["anchor"] // np.uint64(buckets)).astype("<u4")
        rows.append(b"".join((head, short.tobytes(), gap.astype("<i8" if wide else "<u4").tobytes(), q["start"].tobytes(), q["len"].astype(np.uint8).tobytes(), q["codes"][used].tobytes())))
    return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "data"])


def unpack(data: bytes) -> np.ndarray:
    n, wide, base, chunk = np.frombuffer(data, "<i8", 4).tolist()
    at, cols = 32, []
    for kind in ("<u4", "<i8" if wide else "<u4", "<i4", "u1"):
        cols.append(np.frombuffer(data, kind, n, at))
        at += n * cols[-1].itemsize
    out = np.zeros(n, PASSAGE)
    out["anchor"], out["start"], out["len"], out["chunk"] = cols[0], cols[2], cols[3], chunk
    gap = cols[1].astype(np.int64)
    out["rec"] = np.where(gap > 0, gap + (base - 1), SEVERAL)
    used = np.arange(_WORDS) < ((out["len"] + 15) // 16)[:, None]
    codes = np.zeros((n, _WORDS), np.uint32)
    codes[used] = np.frombuffer(data, "<u4", int(used.sum()), at)
    out["codes"] = codes
    return out


def _pieces(recs: np.ndarray, seqs: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Records, texts and first letters of pieces of at most CHUNK + SPAN - 1 letters."""
    rows, texts, first = [], [], []
    for i, s in enumerate(seqs):
        for at in range(0, max(1, len(s) - SPAN + 1), CHUNK) if len(s) > CHUNK else (0,):
            rows.append(i)
            texts.append(s[at : at + CHUNK + SPAN - 1] if len(s) > CHUNK else s)
            first.append(at)
    return recs[np.array(rows, np.int64)], texts, np.array(first, np.int64)


def passages(recs: np.ndarray, seqs: list[str], first_letter: np.ndarray | None = None) -> np.ndarray:
    """Passages of the sequences; ``recs`` numbers their records, ``first_letter`` places them in these."""
    codes, ends = joined(seqs)
    n = len(codes)
    if n < SPAN:
        return np.empty(0, PASSAGE)
    h = mix(kmers(codes, K))
    low = sliding_min(h, MOST)
    ok = clean_windows(codes, SPAN)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.empty(0, PASSAGE)
    cut = np.r_[True, (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]])]
    first = np.flatnonzero(cut)
    run = np.diff(np.r_[first, len(at)])
    if run.max() > MOST:
        inside = np.arange(len(at)) - np.repeat(first, run)
        cut |= inside % MOST == 0
        first = np.flatnonzero(cut)
        run = np.diff(np.r_[first, len(at)])
    s = at[first]
    out = np.zeros(len(s), PASSAGE)
    length = run + SPAN - 1
    out["anchor"] = low[s]
    owner = np.searchsorted(ends, s, "right")
    out["rec"] = recs[owner]
    out["start"] = s - (ends - np.diff(np.r_[0, ends]))[owner] + (0 if first_letter is None else first_letter[owner])
    out["len"] = length
    sixteen = kmers(codes, 16)
    for j in range(_WORDS):
        # words beyond the passage end repeat its last 16 letters
        out["codes"][:, j] = sixteen[np.minimum(s + 16 * j, s + length - 16)]
    return out


def _runs(values: list[np.ndarray]) -> np.ndarray:
    """Number of the group of equal neighbours (arrays are sorted together)."""
    new = np.zeros(len(values[0]), bool)
    if len(new):
        new[0] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new) - 1


def several(group: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Per element whether its group (numbered in order) holds two records."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low, high = np.minimum.reduceat(rec, first), np.maximum.reduceat(rec, first)
    return ((low != high) | (low == SEVERAL))[group]


def _same(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p sorted by anchor and text, number of the group of each): groups are equal letter by letter."""
    p["hash"] = _text_hash(p)
    while True:
        p = p[np.lexsort((p["hash"], p["anchor"]))]
        group = _runs([p["anchor"], p["hash"]])
        first = p[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[group]] if len(p) else p
        # codes beyond a passage's words repeat its end, so equal texts have equal codes
        used = np.arange(_WORDS) < ((p["len"] + 15) // 16)[:, None]
        other = (p["len"] != first["len"]) | ((p["codes"] != first["codes"]) & used).any(axis=1)
        if not other.any():
            return p, group
        p["hash"][other] = mix(p["hash"][other] + np.uint64(1))


def thin(p: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(passages to send, places to keep): one copy of each passage that two records here have in common."""
    if not len(p):
        return p, np.empty(0, KEPT)
    p, group = _same(p)
    shared = several(group, p["rec"])
    lead = np.r_[True, group[1:] != group[:-1]]
    kept = np.empty(int(shared.sum()), KEPT)
    kept["chunk"], kept["number"] = chunk, group[shared]
    kept["rec"], kept["start"] = p["rec"][shared], p["start"][shared]
    pick = ~shared | lead
    send, copy = p[pick].copy(), shared[pick]
    send["rec"][copy], send["start"][copy] = SEVERAL, group[pick][copy]
    return send, kept


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_SHIFTS = np.arange(30, -2, -2, dtype=np.uint32)


def decode(p: np.ndarray) -> np.ndarray:
    """Letter codes (rows of 144) of passages; row i holds len[i] letters."""
    full = ((p["codes"][:, :, None] >> _SHIFTS) & np.uint32(3)).astype(np.uint8).reshape(len(p), 16 * _WORDS)
    # the word that crosses the end holds the last 16 letters: move them into place
    length = p["len"].astype(np.int64)
    word, over = length // 16, length % 16
    rows = np.flatnonzero(over)
    if len(rows):
        cols = np.arange(16)
        source = full[rows[:, None], (word[rows] * 16)[:, None] + cols].copy()
        full[rows[:, None], (length[rows] - 16)[:, None] + cols] = source
    return full


def _texts(p: np.ndarray) -> list[str]:
    letters = _LETTERS[decode(p)]
    return [row[:n].tobytes().decode("ascii") for row, n in zip(letters, p["len"].tolist())]


def _window_hashes(codes: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    prefix = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=prefix[:, 1:])
    return mix((prefix[:, SPAN : SPAN + MOST] - prefix[:, :MOST]) * down[:MOST])


def _shared_windows(q: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """(passage, window) flags: the window stands in passages of two records, by 128 bits of hash.

    The windows' hashes are looked at in as many passes as there are slices, each with its part of the hashes.
    """
    hit = np.zeros((len(q), MOST), bool)
    passes = -(-len(q) // SLICE)
    up, down = powers(16 * _WORDS + 1)
    for turn in range(passes):
        keys, others, rows, cols = [], [], [], []
        for at in range(0, len(q), SLICE):
            part = q[at : at + SLICE]
            codes = decode(part)
            # two polynomials, of a base and of its square
            w, v = (_window_hashes(codes, x[: codes.shape[1]], y) for x, y in ((up, down), (up * up, down * down)))
            row, col = np.nonzero(np.arange(MOST) < (part["len"] - SPAN + 1)[:, None])
            key = mix(w[row, col] + part["anchor"][row])
            mine = key % np.uint64(passes) == turn
            keys.append(key[mine])
            others.append(v[row, col][mine])
            rows.append(row[mine] + at)
            cols.append(col[mine])
        key, other, row, col = (np.concatenate(x) for x in (keys, others, rows, cols))
        order = np.lexsort((other, key))
        row, col = row[order], col[order]
        yes = several(_runs([key[order], other[order]]), rec[row]) if len(row) else order
        hit[row[yes], col[yes]] = True
    return hit


def _slices(anchor: np.ndarray) -> Iterator[slice]:
    """Consecutive rows of whole anchors, about SLICE of them; a larger anchor is a slice of its own."""
    edges = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor)]
    at = 0
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if high - at > SLICE and low > at:
            yield slice(at, low)
            at = low
    if at < len(anchor):
        yield slice(at, len(anchor))


def confirm(p: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(passages of recurring anchors, sorted as by ``_same``; texts confirmed to stand in two records)."""
    p = p[np.argsort(p["anchor"], kind="stable")]
    p = p[several(_runs([p["anchor"]]), p["rec"])] if len(p) else p
    if not len(p):
        return p, []
    p, whole = _same(p)
    shared = several(whole, p["rec"])
    lead = np.r_[True, whole[1:] != whole[:-1]]
    found = dict.fromkeys(_texts(p[shared & lead]))
    # anchors under which passages differ: look at their windows, one copy of each passage and record kind
    anchor = _runs([p["anchor"]])
    mixed = np.bincount(anchor, weights=lead)[anchor] > 1
    pick = mixed & (lead | ~shared)
    every, known = p[pick], shared[pick]
    for rows in _slices(every["anchor"]):
        q = every[rows]
        hit = _shared_windows(q, np.where(known[rows], SEVERAL, q["rec"]))
        hit &= ~known[rows][:, None]
        flat = np.zeros((len(q), MOST + 2), np.int8)
        flat[:, 1:-1] = hit
        step = np.diff(flat, axis=1)
        r, a = np.nonzero(step == 1)
        _, b = np.nonzero(step == -1)
        some, r = np.unique(r, return_inverse=True)
        letters = _LETTERS[decode(q[some])] if len(some) else None
        for i, x, y in zip(r.tolist(), a.tolist(), b.tolist()):
            found[letters[i, x : y - 1 + SPAN].tobytes().decode("ascii")] = None
    return p, list(found)


def locate(p: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, replies): every occurrence of the texts in the passages, by automata of bounded size.

    Equal passages next to each other are streamed once and their occurrences copied.
    """
    import ahocorasick

    if not len(p) or not texts:
        return np.empty(0, PLACE), np.empty(0, REPLY)
    group = _runs([p["anchor"], p["hash"]])
    lead = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    many = np.diff(np.r_[lead, len(p)])
    owner, begin, end = [], [], []

    def search(shard: list[str]) -> None:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for t in shard:
            automaton.add_word(t)
        automaton.make_automaton()
        for at in range(0, len(lead), SLICE):
            for i, s in enumerate(_texts(p[lead[at : at + SLICE]]), at):
                for e, n in automaton.iter(s):
                    owner.append(i)
                    begin.append(e + 1 - n)
                    end.append(e + 1)

    shard, size = [], 0
    for t in texts:
        shard.append(t)
        size += len(t)
        if size >= SHARD_LETTERS:
            search(shard)
            shard, size = [], 0
    if shard:
        search(shard)
    once = np.empty(len(owner), PLACE)
    once["rec"], once["start"], once["end"] = owner, begin, end
    once = merge_places(once)
    o, a, b = once["rec"], once["start"], once["end"]
    n = many[o]
    row = np.repeat(lead[o], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = np.repeat(a, n), np.repeat(b, n)
    copy = p["rec"][row] == SEVERAL
    places, replies = np.empty(int((~copy).sum()), PLACE), np.zeros(int(copy.sum()), REPLY)
    x = p[row[~copy]]
    places["rec"], places["start"], places["end"] = x["rec"], x["start"] + a[~copy], x["start"] + b[~copy]
    x = p[row[copy]]
    replies["chunk"], replies["number"], replies["begin"], replies["end"] = x["chunk"], x["start"], a[copy], b[copy]
    return places, replies


def expand(kept: np.ndarray, replies: np.ndarray) -> np.ndarray:
    """Places of the occurrences in the copies that chunks keep the places of."""
    kept, replies = (x[np.lexsort((x["number"], x["chunk"]))] for x in (kept, replies))
    # numbers of the (chunk, number) pairs of both, in order
    both = np.concatenate([kept[["chunk", "number"]], replies[["chunk", "number"]]])
    order = np.lexsort((both["number"], both["chunk"]))
    name = np.empty(len(both), np.int64)
    name[order] = _runs([both["chunk"][order], both["number"][order]])
    k, r = name[: len(kept)], name[len(kept) :]
    a, b = np.searchsorted(r, k, "left"), np.searchsorted(r, k, "right")
    n = b - a
    at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(len(at), PLACE)
    start = np.repeat(kept["start"], n)
    out["rec"], out["start"], out["end"] = np.repeat(kept["rec"], n), start + replies["begin"][at], start + replies["end"][at]
    return out


def merge_places(places: np.ndarray) -> np.ndarray:
    """Disjoint, not touching places per record."""
    if not len(places):
        return places
    p = places[np.lexsort((places["start"], places["rec"]))]
    far = np.int64(1) << 33
    group = _runs([p["rec"]])
    reach = np.maximum.accumulate(p["end"].astype(np.int64) + group * far) - group * far
    cut = np.r_[True, (group[1:] != group[:-1]) | (p["start"][1:] > reach[:-1])]
    first = np.flatnonzero(cut)
    out = p[first].copy()
    out["end"] = np.maximum.reduceat(p["end"], first)
    return out


_SPANS = "rec bigint, start bigint, len bigint"


def shared_spans(df: DataFrame, key: str, seq: str) -> DataFrame:
    """``key, span_start, span_len``: maximal runs of letters covered by windows that another record has too."""
    source = df.select(F.col(key).cast("bigint").alias("rec"), F.col(seq).alias("seq")).where(F.col("rec").isNotNull() & (F.length("seq") >= SPAN))

    partitions, buckets = layout(source)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, chunk = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            recs, texts, letter = _pieces(b.column(0).to_numpy(), b.column(1).to_pylist())
            for first, part in chunks(texts):
                rows = slice(first, first + len(part))
                held.append(passages(recs[rows], part, letter[rows]))
                size += len(held[-1])
                if size >= FLUSH:
                    chunk += 1
                    yield from send(held, chunk)
                    held, size = [], 0
        if size:
            yield from send(held, chunk + 1)

    def by_chunk(x: np.ndarray) -> pa.RecordBatch:
        """To the buckets of negative numbers."""
        out = by_bucket(mix(x["chunk"].astype(np.uint64)), x, buckets)
        mark = b"K" if x.dtype == KEPT else b"R"
        return pa.RecordBatch.from_arrays([pa.array(-1 - out.column(0).to_numpy()), pa.array([mark + d.as_py() for d in out.column(1)], pa.binary())], ["bucket", "data"])

    def by_record(places: np.ndarray) -> pa.RecordBatch:
        places = merge_places(places)
        return by_bucket(mix(places["rec"].astype(np.uint64)), places, buckets)

    def send(held: list[np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
        p, kept = thin(np.concatenate(held), chunk)
        yield pack(p, buckets, chunk)
        if len(kept):
            yield by_chunk(kept)

    def as_they_are(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(held), pa.int32()), pa.array(held, pa.binary())], ["bucket", "data"])

    def find(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield from as_they_are(bucket, held)
            return
        places, replies = locate(*confirm(np.concatenate([unpack(x) for x in held])))
        if len(places):
            yield by_record(places)
        if len(replies):
            yield by_chunk(replies)

    def answer(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket >= 0:
            yield from as_they_are(bucket, held)
            return
        kept, replies = (np.frombuffer(b"".join(x[1:] for x in held if x[:1] == mark), kind) for mark, kind in ((b"K", KEPT), (b"R", REPLY)))
        places = expand(kept, replies)
        if len(places):
            yield by_record(places)

    def merge(_: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        places = merge_places(np.frombuffer(b"".join(held), PLACE))
        if len(places):
            yield pa.RecordBatch.from_arrays([pa.array(places["rec"]), pa.array(places["start"].astype(np.int64)), pa.array((places["end"] - places["start"]).astype(np.int64))], ["rec", "start", "len"])

    located = per_bucket(source.mapInArrow(cut, SCHEMA), find, SCHEMA, partitions)
    answered = per_bucket(located, answer, SCHEMA, partitions)
    spans = per_bucket(answered, merge, _SPANS, partitions)
    return spans.select(F.col("rec").alias(key), F.col("start").alias("span_start"), F.col("len").alias("span_len"))


def shared_shares(df: DataFrame, key: str, seq: str, spans: DataFrame) -> DataFrame:
    """``key, n_letters, n_shared, n_spans, shared_share`` of every record, 0 where nothing is shared."""
    total = spans.groupBy(key).agg(F.sum("span_len").alias("n_shared"), F.count("*").alias("n_spans"))
    n = F.coalesce(F.length(seq), F.lit(0)).cast("bigint")
    out = df.select(key, n.alias("n_letters")).join(total, key, "left")
    shared = F.coalesce("n_shared", F.lit(0))
    return out.select(key, "n_letters", shared.alias("n_shared"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.round(F.when(F.col("n_letters") > 0, shared / F.col("n_letters")).otherwise(0.0), 6).alias("shared_share"))
