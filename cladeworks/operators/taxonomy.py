"""Taxonomies as tables: ``tax_id, parent_tax_id, rank, name, depth, internal_id, pre, post, path``.

``path`` holds the tax ids from the root down to the node, ``pre`` and ``post`` bound its clade in preorder
(ancestor test: a.pre <= b.pre <= a.post), ``internal_id`` counts breadth first with siblings by tax id.
Unclassified is null, never a node.

Defined cases: the root is the node without a parent, or its own parent (several roots give several trees);
nodes on a cycle or under an absent parent are left out; of repeated rows of a node the least by parent, then
rank, counts as a whole; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cladeworks.operators.tree import small_tree
from cladeworks.session import Scratch

MAX_ROUNDS = 40


def build_taxonomy(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """From ``tax_id, parent_tax_id, rank`` and ``tax_id, name``.

    Paths grow by pointer doubling, twice a round: after round i a node knows its last 4**i ancestors, so the
    rounds are the logarithm of the depth, each one written to the shared folder.
    """
    scratch = Scratch(nodes.sparkSession)
    n = nodes.where("tax_id IS NOT NULL").groupBy("tax_id").agg(F.min(F.struct("parent_tax_id", "rank")).alias("r")).select("tax_id", "r.parent_tax_id", "r.rank")
    n = n.withColumn("parent_tax_id", F.when((F.col("parent_tax_id") == F.col("tax_id")) | (F.col("parent_tax_id") == 0), None).otherwise(F.col("parent_tax_id")))
    n = scratch.write(n, "nodes")
    state = scratch.write(n.select("tax_id", F.col("parent_tax_id").alias("jump"), F.array("tax_id").alias("path")), "paths")
    left = state.where("jump IS NOT NULL").count()
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        new = scratch.write(_double(_double(state)), "paths")
        scratch.drop(state)
        state = new
        now = state.where("jump IS NOT NULL").count()
        if now == left:  # nobody arrived and nobody left: these go round in cycles
            break
        left = now
    return number_nodes(n.join(state.where("jump IS NULL").select("tax_id", "path"), "tax_id"), names)


def _double(state: DataFrame) -> DataFrame:
    """Paths twice as long: each path is put behind the path of the node its jump names.

    A node whose parent is absent finds nobody to join and leaves, and so does all below it.
    """
    up = state.select(F.col("tax_id").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("above"))
    moved = state.where("jump IS NOT NULL").join(up, "jump").select("tax_id", F.col("next").alias("jump"), F.concat("above", "path").alias("path"))
    return state.where("jump IS NULL").unionByName(moved)


def number_nodes(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Depth, breadth-first and preorder numbers of nodes with paths."""
    t = nodes.withColumn("depth", F.size("path") - 1)
    # numbering is one total order over the nodes of one taxonomy, a table of a few million rows at most
    t = t.withColumn("internal_id", F.row_number().over(Window.orderBy("depth", "path")).cast("int"))
    t = t.withColumn("pre", F.row_number().over(Window.orderBy("path")).cast("int"))
    clade = t.select(F.explode("path").alias("tax_id")).groupBy("tax_id").agg(F.count("*").cast("int").alias("clade_size"))
    t = t.join(clade, "tax_id").withColumn("post", F.col("pre") + F.col("clade_size") - 1).drop("clade_size")
    t = t.join(names.groupBy("tax_id").agg(F.min("name").alias("name")), "tax_id", "left") if names is not None else t.withColumn("name", F.col("tax_id").cast("string"))
    return t.select("tax_id", "parent_tax_id", "rank", "name", "depth", "internal_id", "pre", "post", "path")


def lca_of_paths(a: Column, b: Column) -> Column:
    """Lowest common ancestor of two paths; null is the identity."""
    both = F.try_element_at(F.array_intersect(a, b), F.lit(-1))
    return F.when(a.isNull(), F.try_element_at(b, F.lit(-1))).when(b.isNull(), F.try_element_at(a, F.lit(-1))).otherwise(both)


def is_ancestor(a_pre: Column, a_post: Column, b_pre: Column) -> Column:
    """A node is its own ancestor; unclassified is nobody's."""
    return F.coalesce((a_pre <= b_pre) & (b_pre <= a_post), F.lit(False))


def prune(taxonomy: DataFrame, used: DataFrame) -> DataFrame:
    """The nodes that ``used`` (one column tax_id) needs: the marked ones and all above them, and the roots."""
    marked = taxonomy.join(used.select("tax_id").distinct(), "tax_id", "left_semi").select(F.explode("path").alias("tax_id"))
    keep = marked.union(taxonomy.where("depth = 0").select("tax_id")).distinct()
    kept = taxonomy.join(keep, "tax_id", "left_semi").select("tax_id", "parent_tax_id", "rank", "path", "name")
    return number_nodes(kept.drop("name"), kept.select("tax_id", "name"))


def pair_lca(pairs: DataFrame, taxonomy: DataFrame, a: str, b: str, out: str = "lca") -> DataFrame:
    """Append the lowest common ancestor of two tax id columns (null is the identity)."""
    p = taxonomy.select(F.col("tax_id").alias("_a"), F.col("path").alias("_pa"))
    q = taxonomy.select(F.col("tax_id").alias("_b"), F.col("path").alias("_pb"))
    j = pairs.join(p, F.col(a) == F.col("_a"), "left").join(q, F.col(b) == F.col("_b"), "left")
    return j.withColumn(out, lca_of_paths(F.col("_pa"), F.col("_pb"))).drop("_a", "_b", "_pa", "_pb")


def lca_by_group(df: DataFrame, keys: list[str], taxon: str, taxonomy: DataFrame) -> DataFrame:
    """``*keys, taxon``: the lowest common ancestor of each group's taxa.

    It is that of the members first and last in preorder: two integers per group, a hash aggregation with
    partial sums. Only groups whose two members differ need a tree look-up, once per distinct pair.
    """
    pre = taxonomy.select(F.col("tax_id").alias(taxon), "pre")
    ends = df.join(pre, taxon).groupBy(*keys).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    return resolve_ends(ends, keys, taxonomy, taxon)


def resolve_ends(ends: DataFrame, keys: list[str], taxonomy: DataFrame, taxon: str) -> DataFrame:
    """``*keys, taxon`` of rows with the least and greatest preorder number ``lo, hi`` of a group.

    A tree of up to ``MOST_NODES`` nodes is broadcast and the rows stay where they are. Beyond it, groups with one
    taxon are named by a join on it, and only the distinct pairs of the others meet the paths.
    """
    tree = small_tree(taxonomy)
    if tree is None:
        names = taxonomy.select(F.col("pre").alias("lo"), F.col("tax_id").alias(taxon))
        lo = taxonomy.select(F.col("pre").alias("lo"), F.col("path").alias("_pl"))
        hi = taxonomy.select(F.col("pre").alias("hi"), F.col("path").alias("_ph"))
        differ = ends.where("lo <> hi")
        pairs = differ.select("lo", "hi").distinct().join(lo, "lo").join(hi, "hi").select("lo", "hi", lca_of_paths(F.col("_pl"), F.col("_ph")).alias(taxon))
        return ends.where("lo = hi").join(names, "lo").select(*keys, taxon).unionByName(differ.join(pairs, ["lo", "hi"]).select(*keys, taxon))
    shared = ends.sparkSession.sparkContext.broadcast(tree)
    rows = ends.select(*keys, "lo", "hi")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    kind = taxonomy.schema["tax_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            low, high = (b.column(i).to_numpy().astype(np.int64) - 1 for i in (len(keys), len(keys) + 1))
            top = tree.common(low, high)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(tree.ids(top), mask=top < 0).cast(to_arrow_type(kind))], [*keys, taxon])

    return rows.mapInArrow(run, f"{fields}, `{taxon}` {kind.simpleString()}")


def common_places(ends: DataFrame, keys: list[str], taxonomy: DataFrame) -> DataFrame:
    """``*keys, pre``: the preorder number of the lowest common ancestor, from ``lo, hi`` as in ``resolve_ends``.

    Nothing goes through the driver, whatever the tree's size: a group of one taxon has its number already, and only
    the distinct pairs of the others meet the paths. ``ends`` is read three times. Groups without a common ancestor
    are left out.
    """
    lo = taxonomy.select(F.col("pre").alias("lo"), F.col("path").alias("_pl"))
    hi = taxonomy.select(F.col("pre").alias("hi"), F.col("path").alias("_ph"))
    differ = ends.where("lo <> hi")
    pairs = differ.select("lo", "hi").distinct().join(lo, "lo").join(hi, "hi").select("lo", "hi", lca_of_paths(F.col("_pl"), F.col("_ph")).alias("tax_id"))
    pairs = pairs.join(taxonomy.select("tax_id", "pre"), "tax_id").select("lo", "hi", "pre")
    return ends.where("lo = hi").select(*keys, F.col("lo").alias("pre")).unionByName(differ.join(pairs, ["lo", "hi"]).select(*keys, "pre"))


class Taxonomy:
    """Look-ups on a taxonomy table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def parent(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.table.select("tax_id", "parent_tax_id"), "tax_id")

    def ancestors(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.table, "tax_id").select("tax_id", F.posexplode("path").alias("depth", "ancestor_id"))

    def children(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.table.select(F.col("parent_tax_id").alias("tax_id"), F.col("tax_id").alias("child_id")), "tax_id")

    def child_count(self, ids: DataFrame) -> DataFrame:
        n = self.table.groupBy(F.col("parent_tax_id").alias("tax_id")).agg(F.count("*").alias("n_children"))
        return ids.join(n, "tax_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    def rank(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.table.select("tax_id", "rank"), "tax_id")

    def name(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.table.select("tax_id", "name"), "tax_id")

    def lca(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pair_lca(pairs, self.table, a, b)

    def is_ancestor(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        x = self.table.select(F.col("tax_id").alias(a), F.col("pre").alias("_apre"), F.col("post").alias("_apost"))
        y = self.table.select(F.col("tax_id").alias(b), F.col("pre").alias("_bpre"))
        j = pairs.join(x, a, "left").join(y, b, "left")
        return j.withColumn("is_ancestor", is_ancestor(F.col("_apre"), F.col("_apost"), F.col("_bpre"))).drop("_apre", "_apost", "_bpre")

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


def conflicting_parents(taxonomies: list[DataFrame]) -> DataFrame:
    """Tax ids whose parent differs between taxonomies: they cannot be searched together."""
    rows = None
    for t in taxonomies:
        part = t.select("tax_id", F.coalesce("parent_tax_id", F.lit(0)).alias("parent_tax_id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("tax_id").agg(F.count_distinct("parent_tax_id").alias("n_parents")).where("n_parents > 1")
