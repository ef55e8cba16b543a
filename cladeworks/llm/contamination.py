"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified exactly.

An item leaks into a document if ``SPAN`` consecutive words of the item stand consecutively in the document.
Items and documents are sets of shingles (``SHINGLE`` consecutive words); a leak is at least
``SPAN - SHINGLE + 1`` shared shingles, so an item of q shingles is searched with the containment threshold
(SPAN - SHINGLE + 1) / q, which a document of any size may reach.

1. Segments of documents are partitioned by size: class c holds those of up to 2**c shingles. A class has its
   own banding, tuned to its largest set, the largest item and the threshold: ``bins`` MinHash values (one
   permutation, parted in bins by the hash's upper bits), each a band of one row. A small item in a long
   document has a tiny Jaccard similarity, so the bands grow with the document; ``bins_for`` takes the least
   power of two at which a leak of the least size is missed with chance ``MISS`` at most (longer leaks: less).
2. Items are signed once per class. The agreeing bands over the item's bands estimate the containment
   (``estimate``). Candidates are the pairs whose estimate reaches half the threshold; the bins are tuned so that
   leaks reach it, while pairs that share a stock phrase do not. Every candidate is verified.
3. First by exact containment: the distinct shingles of the item that stand in the segment, compared by their
   words, must be as many as its poorest passage has. Then by the rule, a run of SPAN words. Nothing is
   reported by hashes alone.

The items' signatures are broadcast while they hold at most ``BROADCAST_LETTERS`` letters; beyond that the
signatures of both sides are joined by a shuffle, and the candidates' texts meet for the same exact check.
An item's bands that stand in very many documents make no hot task: they are split by salted document.

Defined cases: null and empty texts and items hold nothing; repeated items or documents are found each on its
own; documents are decoded as mails by default (``decode`` may be any function from text to segments, and
passages never cross segments); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.mail import visible_segments
from cladeworks.llm.words import CHUNK, Words, ngrams, split_words
from cladeworks.session import Scratch

SPAN, SHINGLE = 12, 5
MISS = 1e-5
BROADCAST_LETTERS = 1_000_000
#: Copies of a band's item rows that documents of one band are dealt to, on the shuffle path.
SALTS = 16
#: The least size class: sets of up to 8 shingles.
FIRST_CLASS = 3
#: Hashes have 64 bits, so there are no finer bins.
MOST_BINS = 1 << 62


def as_is(text: str | None) -> list[str]:
    return [text] if text else []


def agreeing(shared: int) -> int:
    """Bands that a candidate must agree in: half of the shingles that the least leak shares."""
    return max(1, shared // 2)


def missed(size: int, bins: int, shared: int) -> float:
    """Chance that fewer than ``agreeing(shared)`` of ``shared`` common shingles are the least of their bins in a
    set of ``size`` shingles.

    A shingle is the least of its bin with chance (1 - exp(-x)) / x at x = size / bins shingles a bin.
    """
    x = size / bins
    p = -math.expm1(-x) / x
    return sum(math.comb(shared, k) * p**k * (1 - p) ** (shared - k) for k in range(agreeing(shared)))


def bins_for(size_class: int, bounds: tuple[int, int]) -> int:
    """MinHash bins of the class of up to 2**size_class shingles; ``bounds`` as by ``item_bounds``."""
    shared, most = bounds
    bins = 1
    while bins < MOST_BINS and missed((1 << size_class) + most, bins, shared) > MISS:
        bins *= 2
    return bins


def _class_of(n: np.ndarray) -> np.ndarray:
    """Size class of sets of n shingles."""
    return np.maximum(FIRST_CLASS, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def signatures(owner: np.ndarray, h: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, least hash) of every filled bin; ``bins`` (powers of two) are per element of h.

    The bin is the hash's upper bits, so the least hash names its bin as well.
    """
    shift = (np.uint64(64) - np.log2(bins).astype(np.uint64)) % np.uint64(64)
    slot = np.where(bins > 1, h >> shift, np.uint64(0))
    order = np.lexsort((h, owner))
    o, s, x = owner[order], slot[order], h[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    return o[first], x[first]


def _segments(texts: list[str | None], decode: Callable) -> Iterator[tuple[list[str], np.ndarray]]:
    """Chunks of segments and the row of each."""
    held: list[str] = []
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for s in decode(t):
            held.append(s)
            rows.append(i)
            size += len(s)
        if size >= CHUNK:
            yield held, np.array(rows, np.int64)
            held, rows, size = [], [], 0
    if held:
        yield held, np.array(rows, np.int64)


def _sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, class of the text's set) of every shingle; the class counts repeats, an upper bound."""
    at, h = ngrams(w, shingle)
    owner = w.text[at]
    n = np.bincount(owner, minlength=int(owner[-1]) + 1) if len(owner) else np.zeros(1, np.int64)
    return owner, h, _class_of(n)[owner] if len(owner) else np.empty(0, np.int64)


class _Banding:
    """Bins of each size class, as found on demand."""

    def __init__(self, bounds: tuple[int, int]):
        self.bounds, self.bins = bounds, {}

    def of(self, classes: np.ndarray) -> np.ndarray:
        out = np.ones(len(classes), np.int64)
        for c in np.unique(classes).tolist():
            if c not in self.bins:
                self.bins[c] = bins_for(c, self.bounds)
            out[classes == c] = self.bins[c]
        return out


def _grams(words: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


class Item:
    """Words of an item, for the exact checks."""

    def __init__(self, words: list[str], span: int, shingle: int):
        grams = _grams(words, shingle)
        self.shingles, self.passages = set(grams), set(_grams(words, span))
        width = span - shingle + 1
        #: distinct shingles of the passage that has fewest (a passage may repeat itself)
        self.least = min(len(set(grams[i : i + width])) for i in range(len(grams) - width + 1))


def contained(words: list[str], grams: list[tuple[str, ...]], item: Item, span: int) -> tuple[int, bool]:
    """(item's distinct shingles among the words' ``grams``, whether a passage of the item stands there)."""
    ours = [i for i, g in enumerate(grams) if g in item.shingles]
    shared = len({grams[i] for i in ours})
    return shared, shared >= item.least and any(tuple(words[i : i + span]) in item.passages for i in ours)


def _items_of(texts: list[str | None], span: int, shingle: int) -> tuple[Words, list[Item | None]]:
    w = split_words(texts)
    edge = np.searchsorted(w.text, np.arange(len(texts) + 1))
    return w, [Item([w.word(i) for i in range(a, b)], span, shingle) if b - a >= span else None for a, b in zip(edge[:-1], edge[1:])]


def item_bounds(items: list[Item | None]) -> tuple[int, int]:
    """(distinct shingles of the poorest passage, shingles of the largest item)."""
    real = [x for x in items if x is not None]
    return min((x.least for x in real), default=1), max((len(x.shingles) for x in real), default=1)


class ItemIndex:
    """Signatures per size class and exact words of a bounded set of items."""

    def __init__(self, ids: list, texts: list[str | None], span: int, shingle: int, bounds: tuple[int, int] | None = None):
        self.ids, self.span, self.shingle = ids, span, shingle
        w, self.items = _items_of(texts, span, shingle)
        owner, h, _ = _sets(w, shingle)
        keep = np.array([x is not None for x in self.items], bool)
        self.owner, self.h = (owner[keep[owner]], h[keep[owner]]) if len(owner) else (owner, h)
        self.any = np.unique(self.h)
        self.banding = _Banding(bounds or item_bounds(self.items))
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def signed(self, size_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least hashes in order, item of each, bands of each item) for documents of one class."""
        if size_class not in self.classes:
            o, x = signatures(self.owner, self.h, self.banding.of(np.full(len(self.h), size_class)))
            order = np.argsort(x, kind="stable")
            self.classes[size_class] = (x[order], o[order], np.bincount(o, minlength=len(self.items)))
        return self.classes[size_class]

    def candidates(self, w: Words) -> np.ndarray:
        """(text, item, agreeing bands, bands of the item) of all texts and items that agree in enough bands."""
        owner, h, size_class = _sets(w, self.shingle)
        if not len(owner) or not len(self.any):
            return np.empty((0, 4), np.int64)
        # texts without a shingle of any item need no signature
        slot = np.minimum(np.searchsorted(self.any, h), len(self.any) - 1)
        some = np.zeros(int(owner[-1]) + 1, bool)
        some[owner[self.any[slot] == h]] = True
        pick = some[owner]
        owner, h, size_class = owner[pick], h[pick], size_class[pick]
        out = []
        for c in np.unique(size_class).tolist():
            of = size_class == c
            o, x = signatures(owner[of], h[of], self.banding.of(size_class[of]))
            values, items, bands = self.signed(c)
            a, b = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = b - a
            if not n.any():
                continue
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, agree = np.unique(np.repeat(o, n) * len(self.items) + items[at], return_counts=True)
            enough = agree >= agreeing(self.banding.bounds[0])
            pair, agree = pair[enough], agree[enough]
            item = pair % len(self.items)
            out.append(np.stack([pair // len(self.items), item, agree, bands[item]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 4), np.int64)

    def search(self, texts: list[str | None], decode: Callable) -> dict[tuple[int, int], list]:
        """(row, item) to [exact shared shingles, estimated share, whether a passage stands there] of its candidates."""
        found: dict[tuple[int, int], list] = {}
        for segments, rows in _segments(texts, decode):
            w = split_words(segments)
            edge = np.searchsorted(w.text, np.arange(len(segments) + 1))
            held, words, grams = -1, [], []
            for t, item, agree, bands in self.candidates(w).tolist():
                if t != held:
                    held, words = t, [w.word(i) for i in range(edge[t], edge[t + 1])]
                    grams = _grams(words, self.shingle)
                shared, passage = contained(words, grams, self.items[item], self.span)
                best = found.setdefault((int(rows[t]), item), [0, 0.0, False])
                best[:] = [max(best[0], shared), max(best[1], agree / bands), best[2] or passage]
        return found


_EXTRA = "shared int, item_shingles int, estimate double, passage boolean"


def _found_by_broadcast(docs: DataFrame, doc_id: str, index: ItemIndex, item_id: str, item_type: str, decode: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            hits = sorted(index.search(b.column(1).to_pylist(), decode).items()) if len(index.any) else []
            if hits:
                rows, items = zip(*(k for k, _ in hits))
                n, estimate, passage = zip(*(v for _, v in hits))
                sizes = [len(index.items[i].shingles) for i in items]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([index.ids[i] for i in items]), pa.array(n, pa.int32()), pa.array(sizes, pa.int32()), pa.array(estimate), pa.array(passage)], [doc_id, item_id, "shared", "item_shingles", "estimate", "passage"]
                )

    return docs.mapInArrow(run, f"`{doc_id}` {kind}, `{item_id}` {item_type}, {_EXTRA}")


def _bounds(items: DataFrame, span: int, shingle: int) -> tuple[int, int]:
    """``item_bounds`` of a table of items of any size: one row per batch, then a least and a greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least, most = item_bounds(_items_of(b.column(1).to_pylist(), span, shingle)[1])
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([most], pa.int32())], ["least", "most"])

    r = items.mapInArrow(run, "least int, most int").agg(F.min("least").alias("least"), F.max("most").alias("most")).first()
    return (r.least or 1, r.most or 1)


def _signature_rows(df: DataFrame, span: int, shingle: int, decode: Callable, bounds: tuple[int, int], classes: list[int] | None) -> DataFrame:
    """(id, class, low): the signature of each segment in its class, or of each item in every class."""
    kind = df.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = _Banding(bounds)
        for b in batches:
            for segments, rows in _segments(b.column(1).to_pylist(), decode):
                owner, h, own = _sets(split_words(segments), shingle)
                if not len(owner):
                    continue
                for c in np.unique(own).tolist() if classes is None else classes:
                    of = own == c if classes is None else np.ones(len(own), bool)
                    o, x = signatures(owner[of], h[of], banding.of(np.full(int(of.sum()), c)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[o])), pa.array(np.full(len(o), c, np.int32)), pa.array(x.view(np.int64))], ["id", "class", "low"])

    return df.mapInArrow(run, f"id {kind}, class int, low bigint")


def _found_by_shuffle(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, item_type: str, span: int, shingle: int, decode: Callable) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    bounds = _bounds(items, span, shingle)
    a = scratch.write(_signature_rows(docs, span, shingle, decode, bounds, None), "documents")
    classes = sorted(r[0] for r in a.select("class").distinct().collect())  # at most 64 size classes
    b = _signature_rows(items, span, shingle, as_is, bounds, classes).distinct()
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    left = a.select(F.col("id").alias("d"), "class", "low", salt.alias("salt")).distinct()
    right = b.select(F.col("id").alias("i"), "class", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # a document's segments count together here, which only adds candidates
    pairs = left.join(right, ["class", "low", "salt"]).groupBy("d", "i").agg(F.count("*").alias("n")).where(F.col("n") >= agreeing(bounds[0])).select("d", "i")
    # the candidates' texts meet: a document once per item it may hold
    d, i = docs.toDF("d", "doc_text"), items.toDF("i", "item_text")
    texts = pairs.join(d, "d").join(i, "i").select("d", "i", "doc_text", "item_text")
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, (text, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                one = ItemIndex([0], [item], span, shingle, bounds)
                for n, estimate, passage in one.search([text], decode).values():
                    out.append((r, n, len(one.items[0].shingles), estimate, passage))
            if out:
                r, *cols = zip(*out)
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.bool_()))]], [doc_id, item_id, "shared", "item_shingles", "estimate", "passage"])

    return texts.mapInArrow(run, f"`{doc_id}` {kind}, `{item_id}` {item_type}, {_EXTRA}")


def contained_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, span: int = SPAN, shingle: int = SHINGLE, decode: Callable = visible_segments, broadcast_letters: int = BROADCAST_LETTERS) -> DataFrame:
    """Candidates with their exact containment: ``doc_id, item_id, shared, item_shingles, estimate, passage``.

    ``shared`` of the item's ``item_shingles`` distinct shingles stand in one segment of the document,
    ``passage`` tells whether a run of ``span`` words does; ``estimate`` is the containment by MinHash.
    """
    source = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text"))
    wanted = items.select(F.col(item_id).alias(item_id), F.col(item_text).alias("_text"))
    item_type = wanted.schema[item_id].dataType.simpleString()
    letters = wanted.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0)).alias("n")).first().n
    if letters <= broadcast_letters:
        rows = wanted.where("_text IS NOT NULL").collect()  # at most broadcast_letters letters
        return _found_by_broadcast(source, doc_id, ItemIndex([r[0] for r in rows], [r[1] for r in rows], span, shingle), item_id, item_type, decode)
    return _found_by_shuffle(source, doc_id, wanted, item_id, item_type, span, shingle, decode)


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, **options) -> DataFrame:
    """Distinct (doc_id, item_id) such that a passage of the item stands in the document."""
    return contained_items(docs, doc_id, text, items, item_id, item_text, **options).where("passage").select(doc_id, item_id).distinct()
