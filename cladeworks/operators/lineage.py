"""Taxonomies from lineage texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.session import Scratch

#: Rank prefixes of lineage texts (fixed values).
PREFIX_RANKS = {"d": "domain", "k": "kingdom", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}


def lineage_nodes(lineages: Column, df: DataFrame, root_rank: str = "no rank") -> DataFrame:
    """``path_text, parent_text, level``: all distinct prefixes of the lineages (arrays of names)."""
    parts = df.select(lineages.alias("l")).where("size(l) > 0").distinct()
    pref = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda n: F.slice("l", 1, n))).alias("p")).distinct()
    return pref.select(F.array_join("p", ";").alias("path_text"), F.array_join(F.slice("p", 1, F.size("p") - 1), ";").alias("parent_text"), F.size("p").alias("level"), F.element_at("p", -1).alias("label"))


def taxonomy_from_lineages(df: DataFrame, lineage: str, delimiter: str = ";", binomial: bool = False) -> DataFrame:
    """Nodes ``tax_id, parent_tax_id, rank, name, path_text`` of texts such as "d__A;p__B;s__C".

    Ids count breadth first from 1, the root, siblings by text. Empty names (``g__``) end a lineage. With
    ``binomial`` a species is named by genus and species.
    """
    names = F.filter(F.transform(F.split(F.trim(lineage), delimiter), lambda x: F.trim(x)), lambda x: x.rlike("^[a-z]__.+"))
    n = lineage_nodes(names, df)
    # numbers go over distinct names, a table of a few million rows at most
    n = n.withColumn("tax_id", F.row_number().over(Window.orderBy("level", "path_text")) + 1)
    up = n.select(F.col("path_text").alias("parent_text"), F.col("tax_id").alias("parent_tax_id"), F.col("label").alias("parent_label"))
    ranks = F.create_map(*[F.lit(x) for kv in PREFIX_RANKS.items() for x in kv])
    name = F.substring("label", 4, 10_000)
    if binomial:
        name = F.when(F.col("label").startswith("s__") & F.col("parent_label").isNotNull(), F.concat_ws(" ", F.substring("parent_label", 4, 10_000), name)).otherwise(name)
    rows = n.join(up, "parent_text", "left").select("tax_id", F.coalesce("parent_tax_id", F.lit(1)).alias("parent_tax_id"), F.coalesce(F.try_element_at(ranks, F.substring("label", 1, 1)), F.lit("no rank")).alias("rank"), name.alias("name"), "path_text")
    root = df.sparkSession.createDataFrame([(1, 1, "no rank", "root", "")], "tax_id int, parent_tax_id int, rank string, name string, path_text string")
    return root.unionByName(rows)


def lineage_map(df: DataFrame, key: str, lineage: str, taxonomy: DataFrame, delimiter: str = ";") -> DataFrame:
    """``key, tax_id``: the deepest node of each row's lineage; the root without names, no row for null."""
    names = F.filter(F.transform(F.split(F.trim(lineage), delimiter), lambda x: F.trim(x)), lambda x: x.rlike("^[a-z]__.+"))
    return df.select(key, F.array_join(names, ";").alias("path_text")).join(taxonomy.select("path_text", "tax_id"), "path_text").select(key, "tax_id")


def ranked_path_taxonomy(df: DataFrame) -> DataFrame:
    """From ``path (names each followed by ;), tax_id, rank``: nodes with parents found by path text.

    A path whose parent path is absent is an error; the rank "domain" is written "superkingdom".
    """
    parts = F.filter(F.split("path", ";"), lambda x: x != "")
    n = df.select("tax_id", F.when(F.col("rank") == "domain", "superkingdom").otherwise(F.col("rank")).alias("rank"), F.element_at(parts, -1).alias("name"), F.array_join(parts, ";").alias("path_text"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), ";").alias("parent_text"))
    up = n.select(F.col("path_text").alias("parent_text"), F.col("tax_id").alias("parent_tax_id"))
    j = n.join(up, "parent_text", "left")
    parent = F.when(F.col("parent_text") == "", 1).when(F.col("parent_tax_id").isNull(), F.raise_error(F.concat(F.lit("no parent of "), F.col("path_text")))).otherwise(F.col("parent_tax_id"))
    return j.select("tax_id", parent.alias("parent_tax_id"), "rank", "name")


def name_rank_pairs_taxonomy(df: DataFrame, lineage: str) -> DataFrame:
    """From texts "name;rank;name;rank;...": nodes as of ``taxonomy_from_lineages``, the first pair being the root."""
    parts = F.filter(F.split(lineage, ";"), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1), lambda i: F.concat(F.get(parts, i * 2 + 1), F.lit("\t"), F.get(parts, i * 2)))
    n = lineage_nodes(pairs, df.where(F.size(parts) >= 2))
    n = n.withColumn("tax_id", F.row_number().over(Window.orderBy("level", "path_text")))
    up = n.select(F.col("path_text").alias("parent_text"), F.col("tax_id").alias("parent_tax_id"))
    return n.join(up, "parent_text", "left").select("tax_id", F.coalesce("parent_tax_id", "tax_id").alias("parent_tax_id"), F.split_part("label", F.lit("\t"), F.lit(1)).alias("rank"), F.split_part("label", F.lit("\t"), F.lit(2)).alias("name"))


def unknown_taxids(metadata: DataFrame, nodes: DataFrame, column: str = "ncbi_taxid") -> DataFrame:
    """Taxids of the metadata that are no nodes."""
    return metadata.select(F.col(column).alias("tax_id")).where("tax_id IS NOT NULL").distinct().join(nodes.select("tax_id"), "tax_id", "left_anti")


def split_groups(df: DataFrame, lineage: str, groups: list[str], level: str = "p") -> DataFrame:
    """Append ``part``: the lineage's name at a level if it is one of ``groups``, else "others"."""
    name = F.regexp_extract(F.coalesce(lineage, F.lit("")), rf"(?:^|;)\s*{level}__([^;]*)", 1)
    return df.withColumn("part", F.when(name.isin(groups), name).otherwise("others"))


def name_at_level(lineage: Column, level: str) -> Column:
    """Name of a "d__A;p__B;..." lineage at a level (its letter); null where it has none."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(lineage, F.lit("")), rf"(?:^|;)\s*{level}__([^;]*)", 1)), F.lit(""))


def remap_taxids(df: DataFrame, column: str, nodes: DataFrame, secondary: DataFrame) -> DataFrame:
    """``df`` with taxids that are no nodes replaced by those of ``secondary (old, new)``; null where neither helps."""
    known = nodes.select(F.col("tax_id").alias(column)).distinct().withColumn("_known", F.lit(True))
    new = secondary.groupBy(F.col("old").alias(column)).agg(F.min("new").alias("_new"))
    j = df.join(known, column, "left").join(new, column, "left")
    return j.withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise(F.col("_new"))).drop("_known", "_new")


def bin_pack(df: DataFrame, size: str, capacity: int) -> DataFrame:
    """Append ``bin``: groups of rows whose sizes sum to at most ``capacity``; a larger row is a bin of its own.

    Rows are sorted into classes of sizes above capacity / (j + 1) and up to capacity / j, of which j always
    fit together; each class is cut by the rows' numbers, which come from counts per partition of a range
    sort, not from one task.
    """
    fit = F.when(F.col(size) > 0, F.greatest(F.floor(F.lit(capacity) / F.col(size)), F.lit(1))).otherwise(F.lit(capacity)).cast("bigint")
    rows = Scratch(df.sparkSession).write(df.withColumn("_fit", fit).repartitionByRange("_fit", size).sortWithinPartitions("_fit", size).withColumn("_part", F.spark_partition_id()), "sorted")
    here = Window.partitionBy("_part", "_fit").orderBy(F.desc(size))
    counts = rows.groupBy("_fit", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("_fit", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("_fit").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_i", F.row_number().over(here)).join(before, ["_fit", "_part"])
    return numbered.withColumn("bin", F.concat_ws("-", F.col("_fit").cast("string"), F.floor((F.col("_before") + F.col("_i") - 1) / F.col("_fit")).cast("string"))).drop("_fit", "_part", "_i", "_before")
