"""A taxonomy as arrays in preorder, for work on whole batches: common ancestors, votes, confidence.

The tree is broadcast, so it is made only up to ``MOST_NODES`` nodes (20 bytes each); callers join paths beyond.
Nodes are named by their place in preorder from 0; -1 is none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 4_000_000


class Tree(NamedTuple):
    tax_id: np.ndarray  #: int64, by preorder
    parent: np.ndarray  #: int32
    last: np.ndarray  #: int32, the last node of the clade
    sorted_ids: np.ndarray
    place: np.ndarray  #: preorder place of each of sorted_ids

    def places(self, tax_ids: np.ndarray) -> np.ndarray:
        if not len(self.tax_id):
            return np.full(len(tax_ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted_ids, tax_ids), len(self.sorted_ids) - 1)
        return np.where(self.sorted_ids[at] == tax_ids, self.place[at], -1)

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Tax ids, 0 for none."""
        return np.where(places >= 0, self.tax_id[np.maximum(places, 0)], 0) if len(self.tax_id) else np.zeros(len(places), np.int64)

    def common(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Lowest common ancestor of the nodes first and last in preorder: of all nodes between them, too."""
        a = low.astype(np.int64)
        while True:
            up = np.flatnonzero((a >= 0) & (self.last[np.maximum(a, 0)] < high))
            if not len(up):
                return a
            a[up] = self.parent[a[up]]

    def vote(self, read: np.ndarray, node: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, call, hits at or under the call) of every read; ``need`` has one number per read.

        ``read, node, n`` are hits, any number per read and node. A node's score is the hits on its path: in
        preorder, the hits that began at or before it less those whose clade ended before it. The candidate is the
        lowest common ancestor of the best; the call its lowest ancestor-or-self with ``need`` hits in its clade.
        """
        reads = len(need)
        candidate = np.full(reads, -1, np.int64)
        if not len(read):
            return candidate, candidate.copy(), np.zeros(reads, np.int64)
        size = np.int64(len(self.tax_id) + 1)
        key, at = np.unique(read.astype(np.int64) * size + node, return_inverse=True)
        hits = np.bincount(at, weights=n).astype(np.int64)
        owner, where = key // size, key % size
        begun = np.r_[0, np.cumsum(hits)]
        ends = owner * size + self.last[where]
        order = np.argsort(ends, kind="stable")
        ends, ended = ends[order], np.r_[0, np.cumsum(hits[order])]
        # both sums count the earlier reads whole, so these cancel out
        score = begun[1:] - ended[np.searchsorted(ends, key, "left")]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.r_[first, len(owner)])) == score
        o, w = owner[best], where[best]
        lead = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        candidate[o[lead]] = self.common(np.minimum.reduceat(w, lead), np.maximum.reduceat(w, lead))

        def clade(r: np.ndarray, a: np.ndarray) -> np.ndarray:
            return begun[np.searchsorted(key, r * size + self.last[a], "right")] - begun[np.searchsorted(key, r * size + a, "left")]

        call, under = candidate.copy(), np.zeros(reads, np.int64)
        open_ = np.flatnonzero(call >= 0)
        while len(open_):
            under[open_] = clade(open_, call[open_])
            short = under[open_] < need[open_]
            open_ = open_[short]
            call[open_] = self.parent[call[open_]]
            under[open_] = 0
            open_ = open_[call[open_] >= 0]
        return candidate, call, under


def small_tree(taxonomy: DataFrame) -> Tree | None:
    """The tree, or None if it has too many nodes to be broadcast."""
    if taxonomy.count() > MOST_NODES:
        return None
    rows = taxonomy.select(F.col("tax_id").cast("bigint").alias("tax_id"), F.col("parent_tax_id").cast("bigint").alias("parent_tax_id"), F.col("pre").cast("int").alias("pre"), F.col("post").cast("int").alias("post")).toArrow()
    tax_id, pre, post = (rows[c].to_numpy() for c in ("tax_id", "pre", "post"))
    parent = rows["parent_tax_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.argsort(pre, kind="stable")
    tax_id, parent, last = tax_id[order], parent[order], post[order].astype(np.int32) - 1
    by_id = np.argsort(tax_id, kind="stable")
    t = Tree(tax_id, np.zeros(0, np.int32), last, tax_id[by_id], by_id)
    return t._replace(parent=t.places(parent).astype(np.int32))
