"""Mixing sources to target weights by iterative proportional fitting (raking).

Sizes are tokens of a public tokenizer. Token weights of the cells (source x language x topic) are raked to
the wanted source shares and to the wanted language and topic shares (where none are given, to the corpus'
own), under the cap of ``max_repeats`` copies per document; the source shares are met last and exactly. Each
document of a cell then has the same calibrated expected number of copies, and systematic sampling along
documents ordered by size gives every document that number rounded up or down.

The selection is as large as the scarcest source allows at its cap (or ``total_tokens``, if less). A wanted
source without tokens can have no share: its reached share is 0 and the others keep their proportions.

Raking runs on the driver over the cells' sums, at most ``MAX_CELLS`` of them; more (a topic that is nearly an id)
are an error, never folded together. Every document's tokens enter the cells. The report tells the rounds and
whether the weights came to rest: where caps make the marginals impossible together they do not, and
the language and topic shares stay as near as the last round brought them.

Defined cases: documents of null or unwanted source, and those without tokens, are not selected; null or
blank language is "und", null topic "none"; a source wanted twice has the sum of its shares and the least of its
caps; null or negative shares and caps count as 0; empty tables give empty selections; repeated documents
are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.llm.tokens import VOCABULARY, TokenCounter
from cladeworks.session import Scratch

MAX_SOURCES, MAX_CELLS, ROUNDS = 1000, 500_000, 1000
#: Documents of one source in one running sum, about (times the size classes that they are spread over).
PER_SALT = 200_000
#: Largest move of a cell, as part of the selection, at which the weights are at rest.
REST = 1e-9


def token_table(df: DataFrame, key: str, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, *keep, n_tokens``; null text has 0 tokens."""
    source = df.select(key, *keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(vocabulary)
        for b in batches:
            n = counter.count(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], [*b.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(run, f"{fields}, n_tokens bigint")


class Raked(NamedTuple):
    tokens: np.ndarray  #: wanted tokens per cell
    rounds: int
    at_rest: bool


def rake(tokens: np.ndarray, source: np.ndarray, others: list[np.ndarray], shares: np.ndarray, caps: np.ndarray, total: float | None = None, wanted: list[np.ndarray | None] | None = None) -> Raked:
    """Wanted tokens per cell. ``source`` and ``others`` number each cell's source and other dimensions;
    ``shares`` and ``caps`` are per source. ``wanted`` are the other dimensions' shares per value, None for those of
    ``tokens``; values without tokens can have none."""
    have = np.bincount(source, weights=tokens, minlength=len(shares))
    usable = (have > 0) & (shares > 0) & (caps > 0)
    if not usable.any():
        return Raked(np.zeros(len(tokens)), 0, True)
    share = np.where(usable, shares, 0.0)
    share = share / share.sum()
    most = float(np.min(caps[usable] * have[usable] / share[usable]))
    size = most if total is None else min(most, float(total))
    limit = tokens * caps[source] * usable[source]
    w = np.where(usable[source], tokens, 0.0)
    goals = []
    for i, o in enumerate(others):
        there = np.bincount(o, weights=tokens)
        p = there if wanted is None or wanted[i] is None else np.where(there > 0, wanted[i], 0.0)
        goals.append(p / p.sum() if p.sum() > 0 else there / there.sum())

    def fit_sources(w: np.ndarray) -> np.ndarray:
        """Scale each source to its size; what goes beyond a cell's cap goes to the source's other cells."""
        base, free = np.maximum(w, 1e-12 * limit), usable[source].copy()
        while True:
            rest = size * share - np.bincount(source, weights=np.where(free, 0.0, limit), minlength=len(share))
            scale = rest / np.maximum(np.bincount(source, weights=np.where(free, base, 0.0), minlength=len(share)), 1e-300)
            x = np.where(free, base * scale[source], limit)
            over = free & (x > limit * (1 + 1e-12))
            if not over.any():
                return np.minimum(x, limit)
            free &= ~over

    for rounds in range(1, ROUNDS + 1):
        before = w
        for o, p in zip(others, goals):
            now = np.bincount(o, weights=w, minlength=len(p))
            factor = np.where(now > 0, p * size / np.maximum(now, 1e-300), 1.0)
            w = np.minimum(w * factor[o], limit)
        w = fit_sources(w)
        if np.abs(w - before).max() <= REST * size:
            return Raked(w, rounds, True)
    return Raked(w, ROUNDS, False)


def select_mix(df: DataFrame, key: str, text: str, source: str, language: Column, topic: Column, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, language_shares: dict[str, float] | None = None, topic_shares: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). Selection: ``key, source, lang, topic, n_tokens, n_copies`` with n_copies > 0.

    ``language_shares`` and ``topic_shares`` are relative weights per value; values they do not name get none.
    Shares: ``dimension, value, target_share, reached_share, n_docs, n_tokens, max_copies, rounds, at_rest`` per
    source (every wanted one), language and topic.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    lang = F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), F.lit("und"))
    base = df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), lang.alias("lang"), F.coalesce(topic, F.lit("none")).alias("topic"), F.col(text).alias("text"))
    docs = scratch.write(token_table(base, "id", "text", ["source", "lang", "topic"], vocabulary), "tokens")
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("cap"))
    want = wanted.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(want) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} wanted sources")
    number = {r.source: i for i, r in enumerate(want)}
    kept = docs.join(F.broadcast(wanted.select("source")), "source").where("n_tokens > 0")
    summed = scratch.write(kept.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "cells")
    if summed.count() > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    cells = summed.collect()  # at most MAX_CELLS rows
    cells.sort(key=lambda r: (r.source, r.lang, r.topic))
    named = (language_shares, topic_shares)
    values = [sorted({r[c] for r in cells}) for c in ("lang", "topic")]
    places = [{x: i for i, x in enumerate(v)} for v in values]
    tokens = np.array([r.n for r in cells], float)
    src = np.array([number[r.source] for r in cells], int)
    others = [np.array([v[r[c]] for r in cells], int) for c, v in zip(("lang", "topic"), places)]
    shares, caps = np.array([r.share for r in want], float), np.array([r.cap for r in want], float)
    wanted_shares = [None if g is None else np.array([max(0.0, g.get(x, 0.0)) for x in v], float) for g, v in zip(named, values)]
    w, rounds, at_rest = rake(tokens, src, others, shares, caps, total_tokens, wanted_shares) if cells else Raked(np.zeros(0), 0, True)

    many: dict[str, int] = {}
    for r in cells:
        many[r.source] = many.get(r.source, 0) + r.docs
    salts = {s: -(-n // PER_SALT) for s, n in many.items()}
    rates = spark.createDataFrame([(r.source, r.lang, r.topic, float(x / r.n), salts[r.source]) for r, x in zip(cells, w)], "source string, lang string, topic string, rate double, salts int")
    # order inside a source: size class, salt, size; a document's place is the sum of the rates before it, a
    # prefix over at most size classes * salts blocks plus a running sum inside its block
    part = ["source", "size_class", "salt"]
    placed = kept.join(F.broadcast(rates), ["source", "lang", "topic"]).withColumn("size_class", F.floor(F.log2("n_tokens") * 8).cast("int")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    blocks = placed.groupBy(*part).agg(F.sum("rate").alias("rates"))
    before = Window.partitionBy("source").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*part, (F.coalesce(F.sum("rates").over(before), F.lit(0.0)) + 0.5).alias("start"))
    inside = F.sum("rate").over(Window.partitionBy(*part).orderBy("n_tokens", "id").rowsBetween(Window.unboundedPreceding, 0))
    drawn = placed.withColumn("inside", inside).join(blocks, part)
    upper = F.floor(F.col("start") + F.col("inside") + 1e-9)
    lower = F.floor(F.col("start") + F.col("inside") - F.col("rate") + 1e-9)
    chosen = drawn.select("id", "source", "lang", "topic", "n_tokens", (upper - lower).cast("int").alias("n_copies")).where("n_copies > 0")
    chosen = scratch.write(chosen, "chosen")

    def reached(column: str, target: dict[str, float]) -> DataFrame:
        goal = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "value string, target_share double")
        got = chosen.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("n_tokens"), F.max("n_copies").alias("max_copies"))
        return goal.join(got, "value", "left").withColumn("dimension", F.lit(column))

    total_share = float(shares.sum()) or 1.0
    goals = [("source", {r.source: r.share / total_share for r in want})]
    for c, v, o, g in zip(("lang", "topic"), values, others, named):
        own = np.bincount(o, weights=tokens, minlength=len(v)) if len(tokens) else np.zeros(0)
        goal = dict(zip(v, own.tolist())) if g is None else {x: max(0.0, n) for x, n in g.items()}
        whole = sum(goal.values()) or 1.0
        goals.append((c, {x: n / whole for x, n in goal.items()}))
    report = None
    for column, target in goals:
        report = reached(column, target) if report is None else report.unionByName(reached(column, target))
    whole = F.sum("n_tokens").over(Window.partitionBy("dimension"))
    report = report.select("dimension", "value", "target_share", F.round(F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)), 6).alias("reached_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"), F.lit(rounds).alias("rounds"), F.lit(at_rest).alias("at_rest"))
    return chosen.withColumnRenamed("id", key), report
