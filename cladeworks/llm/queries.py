"""Queries pN_... of the operators for training data, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import contamination, distinct_sketch, mixing, near_dup, pieces, repetition, shared_spans
from cladeworks.llm.sql import ORACLES
from cladeworks.session import Scratch, table


def _hit_sketches(spark: SparkSession, d: str, groups: list[str]) -> DataFrame:
    return distinct_sketch.kmv_sketches(table(spark, d, "minimizer_data"), "candidate", "observed_at", groups)


def p1_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates per combination of day, sample and database, and distinct taxids per day and database."""
    hits = distinct_sketch.with_estimates(_hit_sketches(spark, d, ["sample_id", "db_name"]))
    taxa = distinct_sketch.with_estimates(distinct_sketch.kmv_sketches(table(spark, d, "seqid2taxid"), "taxid", "mapped_at", ["db_name"]))
    hits = hits.withColumn("source_table", F.lit("minimizer_data"))
    taxa = taxa.withColumn("source_table", F.lit("seqid2taxid")).withColumn("sample_id", F.lit(None).cast("string"))
    return hits.unionByName(taxa)


def p1_day_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each day against those of the day before: union, intersection and differences with bounds."""
    sketches = _hit_sketches(spark, d, []).where("grouping = 'day' AND day IS NOT NULL")
    days = Scratch(spark).write(sketches.select("day", "sketch"), "days")
    pairs = days.join(days.select(F.date_add("day", 1).alias("day"), F.col("sketch").alias("before")), "day")
    return distinct_sketch.set_operations(pairs, "sketch", "before")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.split_sequences(table(spark, d, "library"), "seq_no", "seq")
    return out.select("seq_no", "piece_no", "piece_start", "piece_end", "cut", "piece")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "library").where(F.length("seq") > pieces.LIMIT)
    return pieces.natural_boundaries(pieces.split_sequences(long, "seq_no", "seq"), "seq_no")


def _near(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    library = table(spark, d, "library")
    return [(k.name, *near_dup.near_duplicates(library, "seq_no", k.name, k)) for k in (near_dup.SEQ, near_dup.HEADER)]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [near_dup.all_pairs(links, members).select(F.lit(name).alias("field"), F.col("id_a").alias("seq_no_a"), F.col("id_b").alias("seq_no_b")) for name, links, members in _near(spark, d)]
    return parts[0].unionByName(parts[1])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    parts = [near_dup.groups(links, members).withColumn("field", F.lit(name)).withColumnRenamed("id", "seq_no") for name, links, members in _near(spark, d)]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "library"), "seq_no", "seq")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_shares(table(spark, d, "library"), "seq_no", "seq", p7_found(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_containment(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of the search: exact and estimated share of the item's shingles that stand in the mail."""
    found = contamination.contained_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each item the number of documents it leaked into, 0 included."""
    n = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return table(spark, d, "eval_items").select("item_id", "task").join(n, "item_id", "left").select("item_id", "task", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # topic: the kind of list a mail came through, the first part of the mailbox' name
    topic = F.nullif(F.regexp_extract(F.lower("mailbox"), r"^([a-z0-9]+)", 1), F.lit(""))
    return mixing.select_mix(table(spark, d, "documents"), "doc_id", "text", "source", F.col("lang"), topic, table(spark, d, "mix_targets"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(p10_repetition(spark, d), "doc_id")


def p10_rules(spark: SparkSession, d: str) -> DataFrame:
    """What expectation-maximisation holds of each rule, and whether it came to rest."""
    return repetition.rule_accuracies(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_distinct_counts, p1_day_overlap, p4_found, p4_pieces, p5_found, p5_groups, p7_found, p7_shares, p8_found, p8_containment, p8_items, p9_selection, p9_shares, p10_found, p10_repetition, p10_rules)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
