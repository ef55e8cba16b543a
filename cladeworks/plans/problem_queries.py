"""The general data problems over the test tables (queries pN_...), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.operators.hierarchy import ancestors, build_hierarchy, descendants, endless_nodes
from cladeworks.operators.orphans import orphan_counts, orphan_references
from cladeworks.operators.packed_fields import split_packed
from cladeworks.session import Scratch, table

#: What the tables' text references are trimmed of.
SPACE = " \t\n\x0b\x0c\r"


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def trim(c):
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    seqid, prelim = table(spark, d, "seqid2taxid"), table(spark, d, "prelim_map")
    refs = (
        seqid.select(F.lit("seqid2taxid.seqid").alias("field"), trim("seqid").alias("key"), F.col("mapped_at").alias("t"), F.col("map_id").alias("row_id"))
        .unionByName(seqid.where("taxid <> 0").select(F.lit("seqid2taxid.taxid").alias("field"), F.col("taxid").cast("string").alias("key"), F.col("mapped_at").alias("t"), F.col("map_id").alias("row_id")))
        .unionByName(prelim.where("map_kind = 'ACCNUM'").select(F.lit("prelim_map.mapped_value").alias("field"), trim("mapped_value").alias("key"), F.col("scanned_at").alias("t"), F.col("prelim_id").alias("row_id")))
    )
    targets = (
        table(spark, d, "library").select(F.lit("seqid2taxid.seqid").alias("field"), F.col("id").alias("key"), F.col("loaded_at").alias("born"), F.col("removed_at").alias("died"))
        .unionByName(table(spark, d, "taxonomy_nodes").select(F.lit("seqid2taxid.taxid").alias("field"), F.col("external_id").cast("string").alias("key"), F.col("loaded_at").alias("born"), F.col("deleted_at").alias("died")))
        .unionByName(table(spark, d, "accession2taxid").select(F.lit("prelim_map.mapped_value").alias("field"), F.col("accession").alias("key"), F.col("loaded_at").alias("born"), F.col("deleted_at").alias("died")))
    )
    return refs, targets


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = _references(spark, d)
    parts = F.split("field", r"\.")
    return orphan_references(refs, targets).select(parts[0].alias("ref_table"), parts[1].alias("ref_field"), "row_id")


def p2_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = _references(spark, d)
    parts = F.split("field", r"\.")
    return orphan_counts(refs, targets).select(parts[0].alias("ref_table"), parts[1].alias("ref_field"), F.date_format("period", "yyyy-MM").alias("month"), "n_refs", "n_orphans")


_ORPHAN_SQL = """
WITH refs AS (
  SELECT 'seqid2taxid' AS ref_table, 'seqid' AS ref_field, map_id AS row_id, regexp_replace(seqid, '^\\s+|\\s+$', '', 'g') AS k, mapped_at AS t FROM seqid2taxid WHERE seqid IS NOT NULL
  UNION ALL SELECT 'seqid2taxid', 'taxid', map_id, CAST(taxid AS VARCHAR), mapped_at FROM seqid2taxid WHERE taxid IS NOT NULL AND taxid <> 0
  UNION ALL SELECT 'prelim_map', 'mapped_value', prelim_id, regexp_replace(mapped_value, '^\\s+|\\s+$', '', 'g'), scanned_at FROM prelim_map WHERE map_kind = 'ACCNUM' AND mapped_value IS NOT NULL
), targets AS (
  SELECT 'seqid' AS f, id AS k, loaded_at AS a, removed_at AS b FROM library
  UNION ALL SELECT 'taxid', CAST(external_id AS VARCHAR), loaded_at, deleted_at FROM taxonomy_nodes
  UNION ALL SELECT 'mapped_value', accession, loaded_at, deleted_at FROM accession2taxid
), alive AS (
  SELECT r.ref_field, r.row_id FROM refs r JOIN targets x ON x.f = r.ref_field AND x.k = r.k AND x.a <= r.t AND (x.b IS NULL OR x.b > r.t) GROUP BY ALL
), marked AS (
  SELECT r.*, a.row_id IS NULL AS orphan FROM refs r LEFT JOIN alive a ON a.ref_field = r.ref_field AND a.row_id = r.row_id WHERE r.t IS NOT NULL
)"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries = split_packed(table(spark, d, "library"), "seq_no", "header")
    return entries.where("n_entries >= 2").select("seq_no", F.col("entry_pos").cast("bigint").alias("entry_pos"), "entry_id")


def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "library"), "seq_no", "header")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "taxonomy_nodes").select("external_id", "parent_id", "node_id")
    return endless_nodes(nodes, "external_id", "parent_id", "node_id")


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "taxonomy_nodes")
    ranked = nodes.join(F.broadcast(table(spark, d, "rank_names")), "rank_offset", "left")
    return build_hierarchy(ranked, "external_id", "parent_id", "node_id", label="rank_name")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Everything but ``pre``, whose order among siblings is the operator's own; ``p6_nesting`` checks it."""
    return _hierarchy(spark, d).drop("pre")


def p6_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose range is not inside their parent's or overlaps a neighbour's: none, of all nodes."""
    h = Scratch(spark).write(_hierarchy(spark, d).select("external_id", "parent_id", "root_id", "pre", "n_descendants"), "ranges")
    up = h.select(F.col("external_id").alias("parent_id"), F.col("pre").alias("a"), F.col("n_descendants").alias("m"))
    outside = h.where("pre IS NOT NULL AND parent_id IS NOT NULL").join(up, "parent_id").where("pre <= a OR pre + n_descendants > a + m").count()
    # consecutive numbers from 0 in each tree: as many as the root has descendants, no number twice
    trees = h.where("pre IS NOT NULL").groupBy("root_id").agg(F.count("*").alias("n"), F.count_distinct("pre").alias("u"), F.max("pre").alias("last"), F.max("n_descendants").alias("m"))
    gaps = trees.where("u <> n OR last <> n - 1 OR m <> n - 1").count()
    return h.agg(F.lit(outside + gaps).cast("bigint").alias("n_broken"), F.count("*").alias("n_nodes"))


def p6_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return ancestors(_hierarchy(spark, d)).select("external_id", "ancestor_id", "distance")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node that has some."""
    return descendants(_hierarchy(spark, d))


_UP = """
WITH RECURSIVE n AS (
  SELECT external_id AS id, arg_min(parent_id, node_id) FILTER (WHERE TRUE) AS p0 FROM (SELECT external_id, coalesce(parent_id, 0) AS parent_id, node_id FROM taxonomy_nodes WHERE external_id IS NOT NULL) GROUP BY 1
), e AS (
  SELECT n.id, CASE WHEN n.p0 = 0 OR n.p0 = n.id OR q.id IS NULL THEN NULL ELSE n.p0 END AS p FROM n LEFT JOIN n q ON q.id = n.p0
)"""


_PAIRS = """, up AS (
  SELECT id, p AS a, 1 AS distance FROM e WHERE p IS NOT NULL
  UNION ALL SELECT up.id, e.p, up.distance + 1 FROM up JOIN e ON e.id = up.a WHERE e.p IS NOT NULL AND up.distance < 2000
), roots AS (SELECT id, 0 AS d FROM e WHERE p IS NULL UNION ALL SELECT e.id, r.d + 1 FROM roots r JOIN e ON e.p = r.id)"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_orphan_counts, p3_found, p3_entries, p6_found, p6_hierarchy, p6_nesting, p6_ancestors, p6_descendants)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _ORPHAN_SQL + " SELECT ref_table, ref_field, row_id FROM marked WHERE orphan",
        "p2_orphan_counts": _ORPHAN_SQL + " SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n_refs, sum(orphan::INT)::BIGINT AS n_orphans FROM marked GROUP BY 1, 2, 3",
        "p6_ancestors": _UP + _PAIRS + " SELECT up.id AS external_id, up.a AS ancestor_id, up.distance::INT AS distance FROM up JOIN roots USING (id) WHERE up.distance <= roots.d",
        "p6_descendants": _UP + _PAIRS + " SELECT up.a AS ancestor_id, up.id AS external_id, up.distance::INT AS distance FROM up JOIN roots USING (id) WHERE up.distance <= roots.d",
        "p6_hierarchy": _UP
        + _PAIRS
        + """, label AS (SELECT external_id AS id, arg_min(coalesce(rank_name, '?'), node_id) AS r FROM taxonomy_nodes LEFT JOIN rank_names USING (rank_offset) WHERE external_id IS NOT NULL GROUP BY 1),
real AS (SELECT up.id, up.a, up.distance FROM up JOIN roots USING (id) WHERE up.distance <= roots.d UNION ALL SELECT id, id, 0 FROM roots),
agg AS (SELECT real.id, arg_max(a, distance) AS root_id, max(distance)::INT AS depth, string_agg(a::VARCHAR, ',' ORDER BY distance DESC) AS path_ids, string_agg(r || ':' || a, '/' ORDER BY distance DESC) AS path FROM real JOIN label ON label.id = real.a GROUP BY real.id),
sub AS (SELECT a AS id, count(*) - 1 AS n FROM real GROUP BY 1),
-- preorder: siblings in the operator's order (block of a hash, then id) are not SQL's to know, so only what all orders agree on
n0 AS (SELECT n.id, n.p0, e.p, CASE WHEN n.p0 = 0 OR n.p0 = n.id THEN 'declared' WHEN e.p IS NULL THEN 'absent_parent' END AS root_kind FROM n JOIN e ON e.id = n.id)
SELECT n0.id AS external_id, n0.p AS parent_id, agg.root_id, n0.root_kind, agg.depth, sub.n AS n_descendants, agg.path_ids, agg.path FROM n0 LEFT JOIN agg ON agg.id = n0.id LEFT JOIN sub ON sub.id = n0.id AND agg.id IS NOT NULL""",
        "p6_nesting": "SELECT 0::BIGINT AS n_broken, (SELECT count(*) FROM (SELECT DISTINCT external_id FROM taxonomy_nodes WHERE external_id IS NOT NULL))::BIGINT AS n_nodes",
        "p6_found": _UP
        + """, ok AS (SELECT id FROM e WHERE p IS NULL UNION ALL SELECT e.id FROM ok JOIN e ON e.p = ok.id), bad AS (SELECT id, p FROM e WHERE id NOT IN (SELECT id FROM ok)),
walk AS (SELECT id, id AS x, 0 AS s FROM bad UNION ALL SELECT walk.id, bad.p, s + 1 FROM walk JOIN bad ON bad.id = walk.x WHERE s < 2 * (SELECT count(*) FROM bad))
SELECT id AS external_id, min(x)::BIGINT AS cycle_id FROM walk WHERE s >= (SELECT count(*) FROM bad) GROUP BY 1""",
    }
