"""Text tables of the classification engine: taxonomy dumps, id maps, accession tables, outputs, and index folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``fields`` (array) of a taxonomy dump: parted by tab-bar-tab, lines ending in tab-bar."""
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("fields"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``tax_id, parent_tax_id, rank``; id 0 is an error, node 1 is a root."""
    f = F.col("fields")
    n = read_dump(spark, path).select(f[0].cast("bigint").alias("tax_id"), f[1].cast("bigint").alias("parent_tax_id"), f[2].alias("rank"))
    tax = F.when(F.col("tax_id") == 0, F.raise_error(F.lit("taxid 0 in the nodes")).cast("bigint")).otherwise(F.col("tax_id"))
    return n.select(tax.alias("tax_id"), F.when(F.col("tax_id") != 1, F.col("parent_tax_id")).alias("parent_tax_id"), "rank")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``tax_id, name``: the scientific names."""
    f = F.col("fields")
    return read_dump(spark, path).where(f[3] == "scientific name").select(f[0].cast("bigint").alias("tax_id"), f[1].alias("name"))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("fields")
    return read_dump(spark, path).select(f[0].cast("bigint").alias("old"), f[1].cast("bigint").alias("new"))


def read_seqid_map(spark: SparkSession, path: str) -> DataFrame:
    """``seqid, taxid, line`` of lines "id taxid"; taxid 0 left out. ``line`` orders the rows of a file."""
    v = F.split(F.trim("value"), r"\s+")
    m = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return m.select(v[0].alias("seqid"), v[1].cast("bigint").alias("taxid"), "line").where("taxid <> 0")


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """``accession, accession_version, taxid, gi, line`` of a tab-separated file with a header line."""
    schema = "accession string, accession_version string, taxid bigint, gi bigint"
    return spark.read.csv(path, sep="\t", header=True, schema=schema).withColumn("line", F.monotonically_increasing_id())


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, status, taxon, length, hits`` of a per-read output; taxa may be "name (taxid N)"."""
    v = F.split("value", "\t")
    t = F.coalesce(F.nullif(F.regexp_extract(v[2], r"\(taxid (\d+)\)$", 1), F.lit("")), v[2]).cast("bigint")
    return spark.read.text(path).select(v[1].alias("read_id"), v[0].alias("status"), F.nullif(t, F.lit(0).cast("bigint")).alias("taxon"), v[3].alias("length"), v[4].alias("hits"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False, emptyValue="")


def save_database(index: DataFrame, taxonomy: DataFrame, summary: DataFrame, path: str) -> None:
    """An index folder: ``index`` (ranges of minimizers, so look-ups prune files), ``taxonomy``, ``summary``."""
    index.repartitionByRange("minimizer").sortWithinPartitions("minimizer").write.mode("overwrite").parquet(f"{path}/index")
    taxonomy.write.mode("overwrite").parquet(f"{path}/taxonomy")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def load_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("index", "taxonomy", "summary"))


def add_to_library(records: DataFrame, path: str, part: str) -> None:
    """Append records (``id, header, seq``) as one part of a library folder; adding a part again replaces it."""
    records.withColumn("seq_md5", F.md5("seq")).write.mode("overwrite").parquet(f"{path}/library/part={part}")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a library, with their manifest columns ``part`` and ``seq_md5``."""
    return spark.read.parquet(f"{path}/library")


def clean(spark: SparkSession, path: str, keep_library: bool = False) -> list[str]:
    """Remove what a finished index folder does not need; the folders removed."""
    jvm, gone = spark._jvm, []
    for name in ("staging", *([] if keep_library else ["library"])):
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True):
            gone.append(name)
    return gone


def find_database(name: str, search: str = "", default: str = "") -> str:
    """Folder of a database: a path, or a name below one of the colon-separated search folders."""
    import os

    name = name or default
    if not name:
        raise ValueError("no database named")
    for folder in [""] if "/" in name else ["", *search.split(":")]:
        path = os.path.join(folder, name) if folder else name
        if all(os.path.isdir(os.path.join(path, x)) for x in ("index", "taxonomy", "summary")):
            return path
    raise FileNotFoundError(name)
