"""The minimizer index: ``minimizer, taxon``, the lowest common ancestor of all sequences that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions.columns import with_stop
from cladeworks.functions.hashing import clear_hash_threshold, unsigned_at_least, with_hash
from cladeworks.functions.kmers import Scheme
from cladeworks.operators.taxonomy import common_places, lca_by_group, resolve_ends
from cladeworks.operators.tokens import distinct_minimizers, minimizer_ends
from cladeworks.session import Scratch

SAMPLE_OF, SAMPLE = 1024, 4
SLACK, LOAD = 8192, 0.7


def sequence_taxa(library: DataFrame, seqid_map: DataFrame, taxonomy: DataFrame, key: str, header: str) -> DataFrame:
    """``key, taxon`` of the library sequences with a known taxon.

    A header may name several ids, parted by \\x01 and white space; the taxon is the lowest common ancestor
    of those that the map and the taxonomy know. Of repeated ids in the map the last row (largest ``line``)
    counts; taxid 0 is none.
    """
    return lca_by_group(_mapped(library, seqid_map, key, header), [key], "tax_id", taxonomy).withColumnRenamed("tax_id", "taxon")


def _mapped(library: DataFrame, seqid_map: DataFrame, key: str, header: str) -> DataFrame:
    """The taxa of all ids in a sequence's header."""
    last = seqid_map.where("taxid <> 0").groupBy("seqid").agg(F.max_by("taxid", "line").alias("tax_id"))
    ids = library.select(key, F.explode(F.split(header, r"[\x01\s]+")).alias("seqid")).distinct()
    return ids.join(last, "seqid")


def sequence_places(library: DataFrame, seqid_map: DataFrame, taxonomy: DataFrame, key: str, header: str) -> DataFrame:
    """``key, pre``: the taxa of ``sequence_taxa`` by their preorder numbers, without the tree on the driver."""
    m = _mapped(library, seqid_map, key, header).join(taxonomy.select("tax_id", "pre"), "tax_id")
    ends = Scratch(library.sparkSession).write(m.groupBy(key).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi")), "ends")
    return common_places(ends, [key], taxonomy)


def index_ends(library: DataFrame, places: DataFrame, scheme: Scheme, key: str = "key", seq: str = "seq") -> DataFrame:
    """``minimizer, lo, hi``: an index whose taxa are not resolved: the least and greatest preorder number of the
    sequences that hold a minimizer, whose lowest common ancestor is its taxon. ``places`` is (key, pre).
    """
    text = with_stop(F.col(seq)) if scheme.protein else F.col(seq)
    return minimizer_ends(library.join(places, key).select("pre", text.alias("_seq")), "pre", "_seq", scheme)


def build_index(library: DataFrame, taxa: DataFrame, taxonomy: DataFrame, scheme: Scheme, key: str = "key", seq: str = "seq", least_hash: int = 0) -> DataFrame:
    """``library`` (key, seq) and ``taxa`` (key, taxon) to the index; one shuffle on the minimizer.

    ``least_hash`` keeps only minimizers whose hash is not below it (a downsampled index).
    """
    known = library.join(taxa, key).join(taxonomy.select(F.col("tax_id").alias("taxon"), "pre"), "taxon")
    text = with_stop(F.col(seq)) if scheme.protein else F.col(seq)
    ends = minimizer_ends(known.select("pre", text.alias("_seq")), "pre", "_seq", scheme)
    if least_hash:
        ends = with_hash(ends, "minimizer").where(unsigned_at_least("hash", least_hash)).drop("hash")
    return resolve_ends(ends, ["minimizer"], taxonomy, "taxon")


def value_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("taxon").agg(F.count("*").alias("n"))


def estimate_keys(df: DataFrame, seq: str, scheme: Scheme, n: int = SAMPLE) -> DataFrame:
    """One row ``sampled, estimate, capacity``: distinct minimizers by those whose hash mod 1024 is below n."""
    if not 0 < n <= SAMPLE_OF:
        raise ValueError(f"n must be within 1 and {SAMPLE_OF}")
    text = with_stop(F.col(seq)) if scheme.protein else F.col(seq)
    mins = distinct_minimizers(df.select(F.lit(0).alias("k"), text.alias("_seq")), "k", "_seq", scheme)
    kept = with_hash(mins, "minimizer").where(F.col("hash").bitwiseAND(F.lit(SAMPLE_OF - 1).cast("bigint")) < n)
    est = ((F.col("sampled") + 1) * SAMPLE_OF / n).cast("bigint")
    out = kept.agg(F.count_distinct("minimizer").alias("sampled"))
    return out.select("sampled", est.alias("estimate"), F.ceil((est + SLACK) / LOAD).cast("bigint").alias("capacity"))


def threshold_for(estimated: int, max_keys: int) -> int:
    return clear_hash_threshold(estimated, max_keys)
