"""Reports: counts rolled up the tree, rank codes, depth-first order.

Counts are rolled up by exploding each counted taxon's path (partial sums before the shuffle), never by
walking the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.taxonomy import common_places
from cladeworks.session import Scratch

#: Ranks with a letter of their own (fixed values).
RANK_LETTERS = {"superkingdom": "D", "domain": "D", "kingdom": "K", "phylum": "P", "class": "C", "order": "O", "family": "F", "genus": "G", "species": "S"}
MPA_LETTERS = {"superkingdom": "d", "domain": "d", "kingdom": "k", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}


def _letter(rank: Column, letters: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    return F.try_element_at(m, F.coalesce(rank, F.lit("")))


def rank_codes(taxonomy: DataFrame) -> DataFrame:
    """``tax_id, rank_code``: letter of the nearest named rank at or above, and the steps since then if any."""
    up = taxonomy.select("tax_id", "depth", F.posexplode("path").alias("at", "above"))
    ranks = taxonomy.select(F.col("tax_id").alias("above"), _letter(F.col("rank"), RANK_LETTERS).alias("letter"))
    named = up.join(ranks, "above").groupBy("tax_id", "depth").agg(F.max(F.when(F.col("letter").isNotNull(), F.struct("at", "letter"))).alias("m"))
    # above every named rank the code counts from the root, which is plain R
    steps = F.when(F.col("m").isNull(), F.col("depth")).otherwise(F.col("depth") - F.col("m.at"))
    return named.select("tax_id", F.concat(F.coalesce("m.letter", F.lit("R")), F.when(steps > 0, steps.cast("string")).otherwise("")).alias("rank_code"))


def clade_rollup(counts: DataFrame, taxonomy: DataFrame, columns: list[str]) -> DataFrame:
    """``tax_id, clade_<c>...``: sums of the columns over each node's clade, for nodes with any."""
    up = counts.join(taxonomy.select("tax_id", "path"), "tax_id").select(F.explode("path").alias("tax_id"), *columns)
    return up.groupBy("tax_id").agg(*[F.sum(c).alias(f"clade_{c}") for c in columns])


def _ordered(rows: DataFrame) -> DataFrame:
    """Append ``position``: preorder with siblings by falling clade count, ties by internal id."""
    key = rows.select(F.col("tax_id").alias("above"), F.struct((-F.col("clade_reads")).alias("a"), F.col("internal_id").alias("b")).alias("k"))
    steps = rows.select("tax_id", F.posexplode("path").alias("at", "above")).join(key, "above")
    paths = steps.groupBy("tax_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "k"))), lambda x: x["k"]).alias("sort_path"))
    # a report has a row per taxon: one sort of at most a few million rows
    return rows.join(paths, "tax_id").withColumn("position", F.row_number().over(Window.orderBy("sort_path"))).drop("sort_path")


def report(counts: DataFrame, taxonomy: DataFrame, total: int | None = None, unclassified: int = 0, zeros: bool = False) -> DataFrame:
    """Report rows from ``tax_id, reads[, minimizers, distinct_minimizers]``: ``position, pct, clade_reads, reads,
    [minimizers, distinct_minimizers,] rank_code, tax_id, name, depth`` (``position`` 0 is the unclassified row).

    The minimizer columns are sums over clades: a minimizer has one taxon, so distinct counts add up.

    ``total`` defaults to all counted and unclassified reads; ``zeros`` keeps taxa without reads.
    """
    more = [c for c in ("minimizers", "distinct_minimizers") if c in counts.columns]
    own = counts.groupBy("tax_id").agg(*[F.sum(c).alias(c) for c in ("reads", *more)])
    clade = clade_rollup(own, taxonomy, ["reads", *more])
    rows = taxonomy.join(own.select("tax_id", "reads"), "tax_id", "left").join(clade, "tax_id", "left" if zeros else "inner")
    rows = rows.withColumn("reads", F.coalesce("reads", F.lit(0)).cast("bigint")).withColumn("clade_reads", F.coalesce("clade_reads", F.lit(0)).cast("bigint"))
    if not zeros:
        rows = rows.where("clade_reads > 0")
    rows = _ordered(rows).join(rank_codes(taxonomy), "tax_id")
    out = rows.select("position", "clade_reads", "reads", *[F.coalesce(f"clade_{c}", F.lit(0)).cast("bigint").alias(c) for c in more], "rank_code", F.col("tax_id").cast("bigint").alias("tax_id"), "name", "depth")
    spark = counts.sparkSession
    if unclassified or zeros:
        u = spark.createDataFrame([(0, unclassified, unclassified, "U", 0, "unclassified", 0)], "position int, clade_reads bigint, reads bigint, rank_code string, tax_id bigint, name string, depth int")
        u = u.withColumns({c: F.lit(0).cast("bigint") for c in more})
        out = u.unionByName(out)
    if total is None:
        whole = own.agg((F.coalesce(F.sum("reads"), F.lit(0)) + unclassified).alias("whole"))
        out = out.join(F.broadcast(whole))  # one row
    else:
        out = out.withColumn("whole", F.lit(total))
    pct = F.format_string("%6.2f", F.when(F.col("whole") > 0, 100.0 * F.col("clade_reads") / F.col("whole")).otherwise(0.0))
    return out.select("position", pct.alias("pct"), "clade_reads", "reads", *more, "rank_code", "tax_id", "name", "depth")


def report_lines(rows: DataFrame) -> DataFrame:
    """``position, line``: tab-separated, the name indented by two blanks a level."""
    name = F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.col("name"))
    more = [F.col(c).cast("string") for c in ("minimizers", "distinct_minimizers") if c in rows.columns]
    return rows.select("position", F.concat_ws("\t", "pct", F.col("clade_reads").cast("string"), F.col("reads").cast("string"), *more, "rank_code", F.col("tax_id").cast("string"), name).alias("line"))


def mpa_report(counts: DataFrame, taxonomy: DataFrame, zeros: bool = False) -> DataFrame:
    """``lineage, clade_reads`` of the nodes of named rank; the lineage names the named ranks above too."""
    own = counts.groupBy("tax_id").agg(F.sum("reads").alias("reads"))
    clade = clade_rollup(own, taxonomy, ["reads"])
    rows = taxonomy.join(clade, "tax_id", "left" if zeros else "inner").where(_letter(F.col("rank"), MPA_LETTERS).isNotNull())
    label = taxonomy.select(F.col("tax_id").alias("above"), F.concat(_letter(F.col("rank"), MPA_LETTERS), F.lit("__"), F.col("name")).alias("label")).where("label IS NOT NULL")
    steps = rows.select("tax_id", "clade_reads", F.posexplode("path").alias("at", "above")).join(label, "above")
    return steps.groupBy("tax_id", F.coalesce("clade_reads", F.lit(0)).alias("clade_reads")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), "|").alias("lineage")).select("lineage", "clade_reads")


def minimizer_counts(found: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Per taxon: look-up hits and exactly distinct minimizers, own and over the clade, from looked-up runs."""
    hits = found.where("is_lookup AND taxon IS NOT NULL").select(F.col("taxon").alias("tax_id"), "minimizer")
    # a minimizer has one taxon, so distinct counts add up over a clade
    own = hits.groupBy("tax_id", "minimizer").agg(F.count("*").alias("n")).groupBy("tax_id").agg(F.sum("n").alias("minimizers"), F.count("*").alias("distinct_minimizers"))
    return _with_clades(own, taxonomy)


def _with_clades(own: DataFrame, taxonomy: DataFrame) -> DataFrame:
    clade = clade_rollup(own, taxonomy, ["minimizers", "distinct_minimizers"])
    return clade.join(own, "tax_id", "left").select("tax_id", F.coalesce("minimizers", F.lit(0)).alias("minimizers"), F.coalesce("distinct_minimizers", F.lit(0)).alias("distinct_minimizers"), "clade_minimizers", "clade_distinct_minimizers")


def _per_taxon(groups: DataFrame, columns: list[str], taxonomy: DataFrame) -> DataFrame:
    """``tax_id`` and the columns of groups ``lo, hi``; several rows a taxon."""
    groups = Scratch(groups.sparkSession).write(groups, "groups")
    return common_places(groups, columns, taxonomy).join(taxonomy.select("pre", "tax_id"), "pre").select("tax_id", *columns)


def hit_counts(hits: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``minimizer_counts`` from a row per minimizer: ``minimizer, n`` look-ups and its ends ``lo, hi`` in the index.

    Minimizers are counted by their ends before these become taxa.
    """
    columns = ["minimizers", "distinct_minimizers"]
    groups = hits.groupBy("lo", "hi").agg(F.sum("n").alias("minimizers"), F.count("*").alias("distinct_minimizers"))
    own = _per_taxon(groups, columns, taxonomy).groupBy("tax_id").agg(*[F.sum(c).alias(c) for c in columns])
    return _with_clades(Scratch(hits.sparkSession).write(own, "own"), taxonomy)


def minimizer_sketches(found: DataFrame, bits: int = 12) -> DataFrame:
    """``tax_id, sketch, estimate``: mergeable HyperLogLog sketches of the distinct minimizers."""
    hits = found.where("is_lookup AND taxon IS NOT NULL")
    s = hits.groupBy(F.col("taxon").alias("tax_id")).agg(F.hll_sketch_agg("minimizer", bits).alias("sketch"))
    return s.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def hit_sketches(hits: DataFrame, taxonomy: DataFrame, bits: int = 12) -> DataFrame:
    """``minimizer_sketches`` from a row per minimizer as in ``hit_counts``: sketches by ends, united per taxon."""
    groups = hits.groupBy("lo", "hi").agg(F.hll_sketch_agg("minimizer", bits).alias("sketch"))
    united = _per_taxon(groups, ["sketch"], taxonomy).groupBy("tax_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def clade_sketches(sketches: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``tax_id, sketch, estimate`` over clades: the taxa's sketches united up their paths, no minimizer counted again."""
    up = sketches.join(taxonomy.select("tax_id", "path"), "tax_id").select(F.explode("path").alias("tax_id"), "sketch")
    return up.groupBy("tax_id").agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("estimate", F.hll_sketch_estimate("sketch"))


def inspect(index: DataFrame, taxonomy: DataFrame, zeros: bool = False) -> DataFrame:
    """Report rows of an index: minimizers per taxon in place of reads."""
    counts = index.groupBy(F.col("taxon").alias("tax_id")).agg(F.count("*").alias("reads"))
    return report(counts, taxonomy, zeros=zeros)


def index_summary(index: DataFrame, taxonomy: DataFrame, scheme, least_hash: int = 0) -> DataFrame:
    """One row describing an index: scheme, masks as bit strings, node and key counts."""
    n = index.agg(F.count("*").alias("n_keys")).first().n_keys
    nodes = taxonomy.count()
    row = (scheme.k, scheme.l, "protein" if scheme.protein else "nucleotide", f"{scheme.mask:064b}", f"{scheme.toggle:064b}", nodes, n, f"{least_hash:020d}")
    return index.sparkSession.createDataFrame([row], "k int, l int, alphabet string, seed_mask string, toggle_mask string, n_nodes bigint, n_keys bigint, least_hash string")


def renormalise(reports: list[DataFrame]) -> DataFrame:
    """Reports of several indexes one after another, percentages of their common total (rows are not merged)."""
    out = None
    for i, r in enumerate(reports):
        part = r.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    roots = out.where("depth = 0 AND tax_id <> 0").agg(F.sum("clade_reads").alias("whole"))
    out = out.drop("pct").join(F.broadcast(roots))  # one row
    return out.withColumn("pct", F.format_string("%6.2f", 100.0 * F.col("clade_reads") / F.col("whole"))).drop("whole")
