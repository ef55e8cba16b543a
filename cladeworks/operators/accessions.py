"""Mapping sequence ids to taxa by accession, and repairing the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions.columns import id_kind, id_value


def scan_headers(headers: DataFrame, header: str, lenient: bool = False) -> DataFrame:
    """``map_kind, seqid, mapped_value, header_comment`` of every id in the headers (ids parted by \\x01).

    An id that holds neither taxid nor accession is an error, or left out if ``lenient``.
    """
    ids = headers.where(F.col(header).isNotNull()).select(F.explode(F.split(header, "\x01")).alias("h")).where("h <> ''")
    rows = ids.select(F.split_part(F.regexp_replace("h", r"\s+", " "), F.lit(" "), F.lit(1)).alias("seqid"), F.nullif(F.trim(F.regexp_replace("h", r"^\S+\s*", "")), F.lit("")).alias("header_comment"))
    kind, value = id_kind(F.col("seqid")), id_value(F.col("seqid"))
    if lenient:
        rows = rows.where(kind.isNotNull())
    else:
        kind = F.when(kind.isNull(), F.raise_error(F.concat(F.lit("no taxid or accession in "), F.col("seqid")))).otherwise(kind)
    return rows.select(kind.alias("map_kind"), "seqid", value.alias("mapped_value"), "header_comment")


def map_accessions(ids: DataFrame, accessions: DataFrame, also_gi: bool = False) -> DataFrame:
    """``ids (seqid, accession)`` to ``seqid, accession, taxid``; of repeated accessions the first line counts.

    ``accessions`` is (accession, taxid, line[, gi]). With ``also_gi`` a numeric accession may be a gi number.
    """
    wanted = ids.select("accession").distinct()
    first = accessions.join(wanted, "accession", "left_semi").groupBy("accession").agg(F.min_by("taxid", "line").alias("taxid"))
    if also_gi:
        gi = accessions.where("gi IS NOT NULL AND gi <> 0").select(F.col("gi").cast("string").alias("accession"), "taxid", "line")
        more = gi.join(wanted, "accession", "left_semi").groupBy("accession").agg(F.min_by("taxid", "line").alias("taxid"))
        first = first.unionByName(more.join(first, "accession", "left_anti"))
    return ids.join(first, "accession").select("seqid", "accession", "taxid")


def union_maps(*maps: DataFrame) -> DataFrame:
    """``seqid, taxid`` of several maps; of a repeated id the last map that has it counts (equal ids in one map: the
    greatest line, if there are lines)."""
    rows = None
    for i, m in enumerate(maps):
        line = F.col("line") if "line" in m.columns else F.lit(0)
        part = m.where("taxid <> 0 AND seqid IS NOT NULL").select("seqid", "taxid", F.struct(F.lit(i).alias("map"), line.cast("bigint").alias("line")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("seqid").agg(F.max_by("taxid", "at").alias("taxid"))


def unmapped(ids: DataFrame, accessions: DataFrame) -> DataFrame:
    return ids.join(accessions.select("accession"), "accession", "left_anti").select("seqid", "accession")


def repair_map(seqid_map: DataFrame, nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """``seqid, taxid, outcome``: kept if the taxid is a node, else remapped by ``merged (old, new)``, else dropped."""
    known = nodes.select(F.col("tax_id").alias("taxid")).distinct().withColumn("known", F.lit(True))
    new = merged.groupBy(F.col("old").alias("taxid")).agg(F.min("new").alias("new"))
    j = seqid_map.select("seqid", "taxid").join(known, "taxid", "left").join(new, "taxid", "left")
    return j.select("seqid", F.when(F.col("known"), F.col("taxid")).otherwise(F.col("new")).alias("taxid"), F.when(F.col("known"), "kept").when(F.col("new").isNotNull(), "remapped").otherwise("dropped").alias("outcome"))


def filter_assemblies(manifest: DataFrame, level: str = "^(complete genome|chromosome)$") -> DataFrame:
    """Rows of an assembly manifest ``taxid, level, path`` of a wanted level (any case) with a path."""
    return manifest.where(F.lower("level").rlike(level) & F.col("path").isNotNull() & (F.col("path") != "na"))
