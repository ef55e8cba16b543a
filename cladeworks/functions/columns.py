"""Spark expressions for headers, names and formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a sequence id, tried in this order (fixed values); the first group is the value.
TAXID_ID = r"(?:^|\|)kraken:taxid\|(\d+)"
NUMERIC_ID = r"^(\d+)$"
ACCESSION_ID = r"(?:^|\|)([A-Z]+_?[A-Z0-9]+)(?:\||\b|\.)"
ASSEMBLY = r"(GC[AF]_[0-9]{9}\.\d+)"


def id_kind(c: Column) -> Column:
    """TAXID, ACCNUM or null for a sequence id."""
    return F.when(c.rlike(TAXID_ID) | c.rlike(NUMERIC_ID), "TAXID").when(c.rlike(ACCESSION_ID), "ACCNUM")


def id_value(c: Column) -> Column:
    """The taxid or accession a sequence id holds, null if it has none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (TAXID_ID, NUMERIC_ID, ACCESSION_ID)])


def tagged_header(taxid: Column, rest: Column) -> Column:
    return F.concat(F.lit("kraken:taxid|"), taxid.cast("string"), F.lit("|"), rest)


def assembly_accession(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ASSEMBLY, 1), F.lit(""))


def rna_to_dna(c: Column) -> Column:
    return F.translate(c, "Uu", "Tt")


def with_stop(c: Column) -> Column:
    """A protein that ends in a stop."""
    return F.when(c.endswith("*"), c).otherwise(F.concat(c, F.lit("*")))


def trim_mate(c: Column) -> Column:
    """An id without its trailing /1 or /2."""
    return F.regexp_replace(c, r"(?<=.)/[12]$", "")


def wrapped(c: Column, width: int = 72) -> Column:
    """Text broken into lines of ``width`` letters."""
    return F.regexp_replace(F.regexp_replace(c, "(.{%d})" % width, "$1\n"), "\n$", "")


def fields(c: Column, delimiter: str, most: int) -> Column:
    """The first ``most`` fields; the rest is dropped."""
    return F.slice(F.split(c, re.escape(delimiter)), 1, most)


_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40, "pi": 2**50}
_WORDS = {"kilo": "k", "mega": "m", "giga": "g", "tera": "t", "peta": "p", "kibi": "ki", "mebi": "mi", "gibi": "gi", "tebi": "ti", "pebi": "pi"}


def parse_size(text: str) -> int:
    """Bytes of a size such as 4096, "16 KiB", "2GB" or "3 gibibytes"."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]*)\s*", str(text).lower())
    if not m:
        raise ValueError(f"no size: {text!r}")
    unit = re.sub(r"(bytes?|b)$", "", m.group(2))
    unit = _WORDS.get(unit, unit)
    if unit not in _UNITS:
        raise ValueError(f"unknown unit in {text!r}")
    return int(float(m.group(1)) * _UNITS[unit])


def parse_ranges(text: str, most: int) -> list[int]:
    """Numbers named by "1,3-5,..7,all" out of 1..most, ascending."""
    out: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        if part == "all":
            out |= set(range(1, most + 1))
        elif m := re.fullmatch(r"(\d*)(?:-|\.\.)(\d*)", part):
            out |= set(range(int(m.group(1) or 1), int(m.group(2) or most) + 1))
        else:
            out.add(int(part))
    if not out or min(out) < 1 or max(out) > most:
        raise ValueError(f"numbers must be within 1 and {most}: {text!r}")
    return sorted(out)
