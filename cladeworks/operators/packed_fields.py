"""Several values packed in one field: split by the dialect of least description length.

A dialect is a set of delimiters and a way of reading double quotes. Every field is parsed under each
dialect that can matter for it; the parses are scored in bits:

* a token of an entry costs -log2 of its shape's share among all tokens at that place (head or body); shapes
  are first priced by a fixed prior, then by their counts over the whole corpus in the parses that prior
  chooses, one distributed aggregation over a fixed alphabet of shapes;
* a boundary costs log2 of the number of the dialect's delimiters plus one;
* naming the dialect costs the same for all.

The cheapest parse wins; ties go to the dialect with fewer delimiters, then to the earlier one.
An entry begins with an id: an accession with version, alone or after ``kraken:taxid|N|``.

Defined cases: a null or empty field, or one with no id at an entry's start, has no entries; empty entries
are not counted, repeated ones are; an unclosed quote is an ordinary character; rows with equal keys are
split each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delimiters entries may be parted by (fixed values).
DELIMITERS = {"soh": "\x01", "caret": "^A", "tab": "\t", "bars": "||", "semicolon": ";", "comma": ",", "gt": ">"}
ID = r"(?:kraken:taxid\|\d+\|)?([A-Z]+_?\d+\.\d+)(?![\w.])"
QUOTED = r'"(?:[^"]|"")*"'
#: Shapes tokens are counted by: a bounded alphabet.
HEADS = ("id", "quoted_id", "word")
BODIES = ("word", "id", "mark", "mark_id", "quoted", "quoted_id", "half_quote")

_id_at = re.compile(ID)
_blank = re.compile(r"[ \r\n]*")
_plain_quote = re.compile(QUOTED)
_open_quote = re.compile(r'(?<![^\s=>;,|^A\x01])"')


class Dialect:
    """Delimiters and quote reading of one parse."""

    def __init__(self, names: tuple[str, ...], quotes: bool):
        self.names, self.quotes = names, quotes
        alternatives = "|".join(re.escape(DELIMITERS[n]) for n in names)
        quoted = r'|(?P<q>(?<![^\s=\x01\t;,|>A])"(?:[^"]|"")*")' if quotes else ""
        boundary = rf'(?P<d>[ \r\n]*(?:(?:{alternatives})[ \r\n]*)+(?="?{ID}|[ \r\n]*$))' if names else r"(?P<d>(?!))"
        self.scan = re.compile(boundary + quoted)
        self.first = re.compile(rf"[ \r\n]*(?:(?:{alternatives})[ \r\n]*)*" if names else r"[ \r\n]*")
        self.per_boundary = log2(len(names) + 1)

    def parse(self, text: str) -> list[str]:
        """The fields between boundaries, empty ones left out."""
        fields, start = [], self.first.match(text).end()
        pos = start
        if self.quotes and start < len(text) and text[start] == '"':
            pos = self._whole(text, start)
        while m := self.scan.search(text, pos):
            if m.lastgroup == "q" or m.group("d") is None:
                pos = m.end()
                continue
            fields.append(text[start : m.start()])
            start = pos = m.end()
            if self.quotes and start < len(text) and text[start] == '"':
                pos = self._whole(text, start)
        fields.append(text[start:])
        return [f for f in fields if f.strip()]

    @staticmethod
    def _whole(text: str, start: int) -> int:
        """End of a wholly quoted entry that begins here, or the place after its quote if it never closes."""
        m = _plain_quote.match(text, start)
        return m.end() if m else start + 1


_made: dict[tuple[tuple[str, ...], bool], Dialect] = {}


def dialect(names: tuple[str, ...], quotes: bool) -> Dialect:
    if (names, quotes) not in _made:
        _made[names, quotes] = Dialect(names, quotes)
    return _made[names, quotes]


_may_split = {n: re.compile(rf'{re.escape(d)}[\s"]*(?:{"|".join(map(re.escape, DELIMITERS.values()))}|[\s"])*{ID}') for n, d in DELIMITERS.items()}


def candidates(text: str) -> list[Dialect]:
    """Dialects that can differ on this text: subsets of the delimiters it has before an id, with and without quotes."""
    present = tuple(n for n in DELIMITERS if DELIMITERS[n] in text and _may_split[n].search(text))
    ways = (True, False) if '"' in text else (False,)
    return [dialect(s, q) for k in range(len(present) + 1) for s in combinations(present, k) for q in ways]


_token = re.compile(r"\S+")
_delimiter = re.compile("|".join(map(re.escape, DELIMITERS.values())))
_quoted_token = re.compile(rf"(?:[^\s\"]*=)?{QUOTED}")


def shapes(field: str, quotes: bool) -> list[tuple[str, str]]:
    """(place, shape) of the tokens of one entry."""
    out = []
    body, pos = field, 0
    if quotes and field[:1] == '"' and (m := _plain_quote.match(field)) and not field[m.end() :].strip():
        inner = field[1 : m.end() - 1]
        m = _id_at.match(inner)
        out.append(("head", "quoted_id" if m else "word"))
        body, pos = inner.replace('""', '"'), m.end() if m else 0
    elif m := _id_at.match(field):
        out.append(("head", "id"))
        pos = m.end()
    else:
        out.append(("head", "word"))
    rest = body[pos:]
    if quotes and '"' in rest:
        for m in _quoted_token.finditer(rest):
            inner = m.group().partition('"')[2]
            out.append(("body", "quoted_id" if _id_at.match(inner) else "quoted"))
            out += [("body", "quoted")] * (inner.count('""') // 2)
            out += [("body", "word")] * len(inner.split())
        rest = _quoted_token.sub(" ", rest)
    for m in _token.finditer(rest):
        t = m.group()
        if '"' in t:
            out.append(("body", "half_quote"))
        has_id = _id_at.search(t) is not None
        mark = _delimiter.search(t[:-1] if t[-1:] in ",;" else t) is not None
        out.append(("body", "mark_id" if has_id and mark else "id" if has_id else "mark" if mark else "word"))
    return out


def entry_id(field: str) -> str | None:
    m = _id_at.match(field[1:] if field[:1] == '"' else field)
    return m.group(1) if m else None


#: Shape counts to begin with, for the first choice of parses and as weak prior of the counted ones.
PRIOR = {("head", "id"): 90, ("head", "quoted_id"): 5, ("head", "word"): 5, ("body", "word"): 1000, ("body", "id"): 10, ("body", "mark"): 10, ("body", "mark_id"): 10, ("body", "quoted"): 15, ("body", "quoted_id"): 1, ("body", "half_quote"): 10}


def bits_of(counts: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Code lengths of the shapes at each place."""
    bits = {}
    for place, alphabet in (("head", HEADS), ("body", BODIES)):
        total = sum(counts[place, s] for s in alphabet)
        bits |= {(place, s): -log2(counts[place, s] / total) for s in alphabet}
    return bits


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes of the parses that are cheapest under the prior."""
    n: Counter = Counter()
    bits = bits_of(PRIOR)
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                d, fields = cheapest(text, bits)
                for f in fields:
                    n.update(shapes(f, d.quotes))
    if n:
        yield pa.RecordBatch.from_pydict({"place": [p for p, _ in n], "shape": [s for _, s in n], "n": list(n.values())})


def code_lengths(df: DataFrame, field: str) -> dict[tuple[str, str], float]:
    """Bits of each (place, shape), from one aggregation whose result has at most a dozen rows."""
    counts = df.select(field).mapInArrow(_counted, "place string, shape string, n bigint").groupBy("place", "shape").agg(F.sum("n").alias("n"))
    seen = {(r.place, r.shape): r.n for r in counts.collect()}
    return bits_of({k: n + seen.get(k, 0) for k, n in PRIOR.items()})


def cheapest(text: str, bits: dict[tuple[str, str], float]) -> tuple[Dialect, list[str]]:
    best = None
    for d in candidates(text):
        fields = d.parse(text)
        cost = sum(bits[s] for f in fields for s in shapes(f, d.quotes)) + d.per_boundary * max(0, len(fields) - 1)
        if best is None or cost < best[0] - 1e-9:
            best = (cost, d, fields)
    return best[1], best[2]


def split_packed(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row per entry: ``key, entry_pos, n_entries, entry_id, entry_text, dialect``."""
    source = df.select(F.col(key).alias("k"), F.col(field).alias("v"))
    bits = code_lengths(source, "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                d, fields = cheapest(text, bits)
                found = [(i, f) for f in fields if (i := entry_id(f))]
                name = "+".join(d.names) + ("/quotes" if d.quotes else "") or "none"
                for n, (i, f) in enumerate(found, 1):
                    if d.quotes and f[0] == '"' and f.rstrip()[-1] == '"':
                        f = f.rstrip()[1:-1].replace('""', '"')
                    for column, x in zip(out, (k, n, len(found), i, f, name)):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), *[pa.array(c, pa.string()) for c in out[3:]]], names)

    names = [key, "entry_pos", "n_entries", "entry_id", "entry_text", "dialect"]
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, entry_pos int, n_entries int, entry_id string, entry_text string, dialect string")
