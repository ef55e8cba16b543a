"""Repetition inside a single document, judged by weak supervision.

Rules measure one document each and vote repetitive (1), clean (0) or abstain (-1). The votes' patterns are
counted over all documents (one aggregation, at most 3**rules rows); expectation-maximisation on those
counts estimates every rule's accuracy and the share of repetitive documents; each document then gets the
posterior probability of being repetitive, and the posterior decides. Nothing is filtered by all rules at once.

Measure: a word is repeated if it lies in a run of ``SPAN`` consecutive words that occurs ``TIMES`` or more
times in the document; ``share`` is repeated words over words.

The measure is also the strong rule: at ``SHARE`` or more a document is repetitive by definition, so its vote
for repetition is wrong on a clean document with chance ``STRONG_ERROR`` only, a fixed value so small that the
other rules and the least prior together cannot outvote it (checked when the module is loaded). How often it
votes on repetitive documents is estimated like the rest. So the documents of posterior ``LIKELY`` or more hold all
of share ``SHARE`` or more, and others that the weaker rules speak against; ``repetitive`` takes the likely
ones and confirms them by the exact share.

Defined cases: null, empty and wordless texts have share 0 and every rule abstains on them, and on texts of
fewer than ``MIN_WORDS`` words every rule but the measure itself; documents are
judged each on its own, so repeated rows repeat in the result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.words import chunks, mix, ngrams, split_words
from cladeworks.session import Scratch

SPAN, TIMES, SHARE = 6, 3, 0.25
#: The strong rule first.
RULES = ("spans", "lines", "sentences", "top_pair", "vocabulary")
#: (clean at most, repetitive at least) of each rule's measure; between them the rule abstains. Ordinary mails repeat
#: a tenth of their lines (quoting) and half of their words (function words); what EM finds a level to be worth
#: is in ``rule_accuracies``.
LEVELS = {"spans": (0.05, SHARE), "lines": (0.10, 0.35), "sentences": (0.05, 0.30), "top_pair": (0.03, 0.10), "vocabulary": (0.55, 0.75)}
#: Two runs of SPAN words: below, shares of lines, pairs and vocabulary are chance.
MIN_WORDS = 2 * SPAN
#: A weak rule is better than chance and never certain.
WEAK, CERTAIN = 0.55, 0.95
LEAST_PRIOR, STRONG_ERROR, LIKELY = 1e-4, 1e-10, 0.5
ROUNDS, CLOSE = 1000, 1e-9


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


if math.log(WEAK / STRONG_ERROR) + _odds(LEAST_PRIOR) - (len(RULES) - 1) * _odds(CERTAIN) <= _odds(LIKELY):
    raise AssertionError("the strong rule's vote can be outvoted")


def _repeated_words(text_of: np.ndarray, at: np.ndarray, h: np.ndarray, words: int, span: int, times: int) -> np.ndarray:
    """Whether each word lies in a run that occurs often enough in its text."""
    own = mix(h + mix(text_of[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    s = own[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[first, len(s)])
    hot = at[order[np.repeat(n >= times, n)]]
    depth = np.zeros(words + span + 1, np.int32)
    np.add.at(depth, hot, 1)
    np.add.at(depth, hot + span, -1)
    return np.cumsum(depth)[:words] > 0


def _dup_share(parts: list[str]) -> float:
    """Share of letters in parts that occur more than once."""
    parts = [p for p in (x.strip() for x in parts) if len(p) > 3]
    total = sum(map(len, parts))
    if len(set(parts)) == len(parts) or not total:
        return 0.0
    return sum(len(p) * n for p, n in Counter(parts).items() if n > 1) / total


def measures(texts: list[str | None], span: int = SPAN, times: int = TIMES) -> dict[str, np.ndarray]:
    """words, repeated, and each rule's measure for every text."""
    n = len(texts)
    out = {"words": np.zeros(n, np.int64), "repeated": np.zeros(n, np.int64), **{r: np.zeros(n) for r in RULES}}
    for first, part in chunks(texts):
        w = split_words(part)
        m = slice(first, first + len(part))
        count = np.bincount(w.text, minlength=len(part))
        out["words"][m] = count
        at, h = ngrams(w, span)
        if len(at):
            rep = _repeated_words(w.text, at, h, len(w.hash), span, times)
            out["repeated"][m] = np.bincount(w.text[rep], minlength=len(part))
        least = np.maximum(count, 1)
        at, h = ngrams(w, 2)
        if len(at):
            own = mix(h + mix(w.text[at].astype(np.uint64) + np.uint64(1)))
            _, where, n2 = np.unique(own, return_index=True, return_counts=True)
            top = np.zeros(len(part), np.int64)
            np.maximum.at(top, w.text[at[where]], n2)
            out["top_pair"][m] = np.where(top > 1, top / least, 0.0)
        own = mix(w.hash + mix(w.text.astype(np.uint64) + np.uint64(1)))
        _, where = np.unique(own, return_index=True)
        out["vocabulary"][m] = 1.0 - np.bincount(w.text[where], minlength=len(part)) / least
        for i, t in enumerate(part):
            if t:
                out["lines"][first + i] = _dup_share(t.splitlines())
                out["sentences"][first + i] = _dup_share(t.replace("\r\n", " ").replace("\n", " ").replace("!", ".").replace("?", ".").split(". "))
    out["spans"] = out["repeated"] / np.maximum(out["words"], 1)
    return out


def rule_table(df: DataFrame, key: str, text: str, span: int = SPAN, times: int = TIMES) -> DataFrame:
    """``key, n_words, n_repeated, <rule measures>, votes`` per document; votes is one digit (0, 1, 2=abstain) per rule."""
    source = df.select(F.col(key).alias(key), F.col(text).alias("_text"))
    kind = source.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_repeated", *RULES, "votes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measures(b.column(1).to_pylist(), span, times)
            votes = []
            for r in RULES:
                low, high = LEVELS[r]
                v = np.where(m[r] >= high, 1, np.where(m[r] <= low, 0, 2))
                least = 1 if r == "spans" else MIN_WORDS
                votes.append(np.where(m["words"] < least, 2, v))
            digits = np.array(votes, np.uint8).T + 48
            text_votes = [bytes(row).decode() for row in digits]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m["words"]), pa.array(m["repeated"]), *[pa.array(m[r]) for r in RULES], pa.array(text_votes)], names)

    return source.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_repeated bigint, " + ", ".join(f"{r} double" for r in RULES) + ", votes string")


class Fit(NamedTuple):
    """What expectation-maximisation found."""

    prior: float
    accuracy: dict[str, tuple[float, float]]  #: per rule: right on repetitive documents, right on clean ones
    posterior: dict[str, float]  #: per vote pattern
    rounds: int
    converged: bool


def fit(patterns: dict[str, int]) -> Fit:
    """Expectation-maximisation over the counted vote patterns, until nothing moves by more than ``CLOSE``."""
    total = sum(patterns.values())
    acc = {r: (0.8, 0.9) for r in RULES}
    acc[RULES[0]] = (0.8, 1 - STRONG_ERROR)
    prior = 0.1

    def posterior(p: str) -> float:
        a, b = math.log(prior), math.log(1 - prior)
        for r, v in zip(RULES, p):
            wrong = STRONG_ERROR if r == RULES[0] else 1 - acc[r][1]
            if v == "1":
                a, b = a + math.log(acc[r][0]), b + math.log(wrong)
            elif v == "0":
                a, b = a + math.log(1 - acc[r][0]), b + math.log(acc[r][1])
        return 1 / (1 + math.exp(min(500.0, max(-500.0, b - a))))

    def within(x: float) -> float:
        return min(CERTAIN, max(WEAK, x))

    done, moved = 0, 1.0
    while total and done < ROUNDS and moved > CLOSE:
        post = {p: posterior(p) for p in patterns}
        before = (prior, *(x for r in RULES for x in acc[r]))
        prior = min(0.5, max(LEAST_PRIOR, sum(post[p] * n for p, n in patterns.items()) / total))
        for i, r in enumerate(RULES):
            hit = [sum(n * post[p] for p, n in patterns.items() if p[i] == v) for v in "10"]
            miss = [sum(n * (1 - post[p]) for p, n in patterns.items() if p[i] == v) for v in "10"]
            # a weak prior keeps rules that seldom vote near what they start from
            clean = acc[r][1] if r == RULES[0] else within((miss[1] + 9) / (sum(miss) + 10))
            acc[r] = (within((hit[0] + 4) / (sum(hit) + 5)), clean)
        done += 1
        moved = max(abs(x - y) for x, y in zip(before, (prior, *(x for r in RULES for x in acc[r]))))
    return Fit(prior, acc, {p: posterior(p) for p in patterns}, done, moved <= CLOSE or not total)


def _fitted(df: DataFrame, key: str, text: str, span: int, times: int) -> tuple[DataFrame, dict[str, int], Fit]:
    rules = Scratch(df.sparkSession).write(rule_table(df, key, text, span, times), "rules")
    counted = {r.votes: r.n for r in rules.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3**5 rows
    return rules, counted, fit(counted)


def repetition(df: DataFrame, key: str, text: str, span: int = SPAN, times: int = TIMES) -> DataFrame:
    """``key, n_words, n_repeated, share, <rule measures>, votes, posterior`` per document."""
    rules, _, found = _fitted(df, key, text, span, times)
    known = df.sparkSession.createDataFrame([(p, float(x)) for p, x in found.posterior.items()], "votes string, posterior double")
    share = F.col("n_repeated") / F.greatest(F.col("n_words"), F.lit(1))
    return rules.join(F.broadcast(known), "votes").select(key, "n_words", "n_repeated", share.alias("share"), *RULES, "votes", "posterior")


def rule_accuracies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``rule, n_for, n_against, n_abstain, right_on_repetitive, right_on_clean, prior, rounds, converged`` per rule."""
    spark: SparkSession = df.sparkSession
    _, counted, found = _fitted(df, key, text, SPAN, TIMES)
    votes = {r: [sum(n for p, n in counted.items() if p[i] == v) for v in "102"] for i, r in enumerate(RULES)}
    rows = [(r, *votes[r], *map(float, found.accuracy[r]), float(found.prior), found.rounds, found.converged) for r in RULES]
    return spark.createDataFrame(rows, "rule string, n_for bigint, n_against bigint, n_abstain bigint, right_on_repetitive double, right_on_clean double, prior double, rounds int, converged boolean")


def repetitive(judged: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """Documents that are likely repetitive, confirmed by their exact share of repeated words."""
    return judged.where(F.col("posterior") >= LIKELY).where((F.col("n_words") > 0) & (F.col("n_repeated") >= F.col("n_words") * F.lit(share))).select(key)
