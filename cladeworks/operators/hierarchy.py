"""Parent-child links to full hierarchies by nested sets; rounds grow with the log of the depth.

1. Subtree sizes, upward: after round i a node knows its descendants nearer than 2**i and the node 2**i above;
   it adds its count to that node (a partial aggregation, so a parent with very many children is no hot spot)
   and jumps on. A node whose jump passes a root is processed: root, depth and the sizes below it are known.
   When a round processes no node while some are left, sizing cannot end for these: depths along a way are
   consecutive, so a doubling that nobody finishes in proves that none will. The unprocessed nodes are those
   with no end to their way, on a cycle or below one.
2. Preorder ranges, downward: siblings get consecutive ranges by a prefix sum of subtree sizes; the prefix sum over
   a huge family runs in blocks. A node's preorder number is the sum of the offsets along its way, by the
   same doubling. Descendants of a are the nodes with pre in (a.pre, a.pre + n_descendants].
3. Ancestors and descendants are a join of ranges with preorder numbers. Ranges are cut into dyadic blocks of at most
   2**``LEVELS`` numbers and joined by tree and block, so a large tree is no hot key and the work is that of the
   result.

Every round is a written table in the shared folder, so lineage stays short and executors may be lost.

Defined cases: rows with a null id are left out; of several rows with one id the one with the smallest
tie-break value counts; a null, zero or own parent is a root, and so is a node whose parent is absent
(``root_kind`` tells which); an empty table gives no rows; nodes without an end get no path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.session import Scratch

#: Children of one node per block of the sibling prefix sum.
BLOCKS = 64
MAX_ROUNDS = 62
#: Preorder numbers per block of the range join, as a power of two.
LEVELS = 12


def _edges(df: DataFrame, node: str, parent: str, order: str, label: str | None = None) -> DataFrame:
    """One row per node: id, p (null for roots), root_kind, label."""
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    rows = df.select(F.col(node).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("p"), F.col(order).alias("o"), name.alias("label")).where("id IS NOT NULL")
    one = rows.groupBy("id").agg(F.min(F.struct(F.col("o"), F.col("p"), F.col("label"))).alias("r")).select("id", "r.p", "r.label")
    known = one.select(F.col("id").alias("p"), F.lit(True).alias("known"))
    e = one.join(known, "p", "left")
    kind = F.when(F.col("p").isNull() | (F.col("p") == 0) | (F.col("p") == F.col("id")), "declared").when(F.col("known").isNull(), "absent_parent")
    return e.select("id", F.when(kind.isNull(), F.col("p")).alias("p"), kind.alias("root_kind"), "label")


def _size_upward(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(``id, jump, root, depth, size`` of every node, rounds, unprocessed nodes).

    ``jump`` is null for processed nodes, which have a root, a depth and the size of their subtree, themselves
    included; the others keep a jump, and their sizes mean nothing.
    """
    top = F.col("p").isNull()
    state = scratch.write(edges.select("id", F.col("p").alias("jump"), F.when(top, F.col("id")).alias("root"), F.when(top, 0).otherwise(1).alias("depth"), F.lit(1.0).alias("size")), "size")
    left, rounds = state.where("jump IS NOT NULL").count(), 0
    while left:
        # doubles are exact up to 2**53 and do not overflow where a cycle counts itself again and again
        gained = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        beyond = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("above"), F.col("depth").alias("up"))
        moved = state.join(beyond, "jump", "left").join(gained, "id", "left")
        depth = F.col("depth") + F.when(F.col("root").isNull(), F.coalesce("up", F.lit(0))).otherwise(0)
        new = moved.select("id", F.col("next").alias("jump"), F.coalesce("root", "above").alias("root"), depth.alias("depth"), (F.col("size") + F.coalesce("more", F.lit(0.0))).alias("size"))
        new = scratch.write(new, "size")
        scratch.drop(state)
        state, rounds = new, rounds + 1
        now = state.where("jump IS NOT NULL").count()
        if now == left:
            break
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"more than {MAX_ROUNDS} doublings")
        left = now
    return state, rounds, left


def endless_nodes(df: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """Nodes that sizing leaves unprocessed, with the smallest id on the cycle they reach."""
    scratch = Scratch(df.sparkSession)
    edges = scratch.write(_edges(df, node, parent, order), "edges")
    state, _, left = _size_upward(edges, scratch)
    bad = scratch.write(state.where("jump IS NOT NULL").select("id").join(edges, "id").select("id", F.col("p").alias("jump"), F.least("id", "p").alias("low")), "bad")
    scratch.drop(state)
    # after enough doublings a jump stands on the cycle and "low" has seen all of it
    steps = 1
    while steps < left:
        up = bad.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("low").alias("above"))
        wider = scratch.write(bad.join(up, "jump").select("id", F.col("next").alias("jump"), F.least("low", "above").alias("low")), "bad")
        scratch.drop(bad)
        bad, steps = wider, steps * 2
    on_cycle = bad.select(F.col("id").alias("jump"), F.col("low").alias("cycle_id"))
    return bad.join(on_cycle, "jump").select(F.col("id").alias(node), "cycle_id")


def _sibling_offsets(sized: DataFrame) -> DataFrame:
    """(id, offset): 1 + the sizes of the earlier siblings, by prefix sums within and over blocks of a family."""
    ranked = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)))
    totals = ranked.groupBy("p", "block").agg(F.sum("size").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("p").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "block", "before")
    w = Window.partitionBy("p", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranked.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return inside.join(before, ["p", "block"]).select("id", (F.col("before") + F.col("inside") + 1).alias("offset"))


def build_hierarchy(df: DataFrame, node: str, parent: str, order: str, label: str | None = None) -> DataFrame:
    """One row per node: ``node, parent, root_id, root_kind, depth, pre, n_descendants, path_ids, path``.

    ``path`` joins ``label:id`` from the root down ("?" for an unknown label); ``pre`` counts from 0 inside
    each tree. Nodes without an end have null root, depth, pre and paths.
    """
    scratch = Scratch(df.sparkSession)
    edges = scratch.write(_edges(df, node, parent, order, label), "edges")
    state, rounds, _ = _size_upward(edges, scratch)
    tree = scratch.write(edges.join(state.where("jump IS NULL").select("id", "root", "depth", F.col("size").cast("bigint").alias("size")), "id"), "tree")
    scratch.drop(state)
    offsets = _sibling_offsets(tree.where("p IS NOT NULL").select("id", "p", "size"))
    step = F.concat_ws(":", F.coalesce("label", F.lit("?")), F.col("id").cast("string"))
    down = tree.join(offsets, "id", "left").select("id", F.col("p").alias("jump"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("pre"), F.array("id").alias("ids"), F.array(step).alias("steps"))
    down = scratch.write(down, "down")
    for _ in range(rounds):
        above = down.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("pre").alias("a"), F.col("ids").alias("b"), F.col("steps").alias("c"))
        moved = down.join(above, "jump", "left").select("id", F.col("next").alias("jump"), (F.col("pre") + F.coalesce("a", F.lit(0))).alias("pre"), F.when(F.col("b").isNull(), F.col("ids")).otherwise(F.concat("b", "ids")).alias("ids"), F.when(F.col("c").isNull(), F.col("steps")).otherwise(F.concat("c", "steps")).alias("steps"))
        moved = scratch.write(moved, "down")
        scratch.drop(down)
        down = moved
    good = tree.join(down.select("id", "pre", "ids", "steps"), "id")
    return edges.select("id", "p", "root_kind").join(good.select("id", "root", "depth", "pre", "size", "ids", "steps"), "id", "left").select(
        F.col("id").alias(node), F.col("p").alias(parent), F.col("root").alias("root_id"), "root_kind", "depth", "pre", (F.col("size") - 1).alias("n_descendants"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("path_ids"), F.array_join("steps", "/").alias("path")
    )


def related(hierarchy: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``ancestor_id, <node>, distance``: every pair of a node and a descendant of it, by nested-set ranges.

    ``tops`` (one column named as the node's) leaves only the descendants of its ids. A range is the union of
    at most 2 * LEVELS dyadic blocks at its ends and whole blocks of 2**LEVELS between them; a node lies in one
    block of each size. So every pair is met once, and no block has more than 2**LEVELS nodes.
    """
    node = hierarchy.columns[0]
    inside = hierarchy.where("pre IS NOT NULL").select(F.col(node).alias("id"), "root_id", "depth", F.col("pre").cast("bigint").alias("pre"), "n_descendants")
    above = inside.where("n_descendants > 0")
    if tops is not None:
        above = above.join(tops.select(F.col(node).alias("id")).distinct(), "id")
    # [lo, hi) in steps of the largest aligned block that fits
    lo, hi = F.col("pre") + 1, F.col("pre") + 1 + F.col("n_descendants")
    blocks = []
    for level in range(LEVELS + 1):
        size = 1 << level
        first, last = F.ceil(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint")
        if level == LEVELS:
            own = F.when(last > first, F.sequence(first, last - 1))
        else:
            # blocks of this size that stick out of the whole blocks of the next size
            low, high = F.when((first % 2 != 0) & (last > first), first), F.when((last % 2 != 0) & (last > first), last - 1)
            own = F.array_distinct(F.array_compact(F.array(low, high)))
        own = F.coalesce(own, F.array().cast("array<bigint>"))
        blocks.append(F.arrays_zip(F.array_repeat(F.lit(level), F.size(own)).alias("level"), own.alias("block")))
    ranges = above.select(F.col("id").alias("ancestor_id"), "root_id", F.col("depth").alias("_top"), F.explode(F.concat(*blocks)).alias("b")).select("ancestor_id", "root_id", "_top", "b.level", "b.block")
    places = F.array(*[F.struct(F.lit(i).alias("level"), F.expr(f"pre div {1 << i}").alias("block")) for i in range(LEVELS + 1)])
    nodes = inside.where("depth > 0").select("id", "root_id", "depth", F.explode(places).alias("b")).select("id", "root_id", "depth", "b.level", "b.block")
    return ranges.join(nodes, ["root_id", "level", "block"]).select("ancestor_id", F.col("id").alias(node), (F.col("depth") - F.col("_top")).alias("distance"))


def ancestors(hierarchy: DataFrame) -> DataFrame:
    """``<node>, ancestor_id, distance`` of every node's ancestors, itself left out."""
    return related(hierarchy).select(hierarchy.columns[0], "ancestor_id", "distance")


def descendants(hierarchy: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``ancestor_id, <node>, distance`` of all descendants, or of those of the ids in ``wanted``."""
    return related(hierarchy, wanted)
