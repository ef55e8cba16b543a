"""Queries over the test tables, one or more per operator of the classification engine.

Taxonomy A is ``taxonomy_nodes``; taxonomy B is region - nation - customer, with orders as counts. The library
and the reads are the sequences of ``library``; their taxa come from ``seqid2taxid``. Short words (k=15,
l=11) keep SQL comparisons affordable on whole tables; defaults for genomes are k=35, l=31, 7 spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.functions.columns import assembly_accession, id_kind, id_value, rna_to_dna, tagged_header, wrapped
from cladeworks.functions.hashing import unsigned_at_least, with_hash
from cladeworks.functions.kmers import Scheme
from cladeworks.functions.translate import six_frames
from cladeworks.operators import accessions, classify as cl, dust, index as ix, lineage, merge as mg, report as rp, taxonomy as tx
from cladeworks.operators.tokens import distinct_minimizers, lookup_counts, token_runs
from cladeworks.plans.core_sql import ORACLES
from cladeworks.session import Scratch, spread, table
from cladeworks.sources.fastx import fasta_text, read_fastx
from cladeworks.streaming.classify_stream import ClassifyService, running_counts

SMALL = Scheme(k=15, l=11, spaces=2)
PROTEIN = Scheme(k=9, l=7, spaces=0, protein=True)
HALF = 1 << 63


# ---- taxonomies -------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """taxonomy_nodes as nodes: one row per external id (the smallest node_id), absent parents made roots."""
    t = table(spark, d, "taxonomy_nodes").join(F.broadcast(table(spark, d, "rank_names")), "rank_offset", "left")
    one = t.where("external_id IS NOT NULL").groupBy("external_id").agg(F.min_by(F.struct("parent_id", "rank_name", "tax_name"), "node_id").alias("r"))
    n = one.select(F.col("external_id").alias("tax_id"), F.col("r.parent_id").alias("parent_tax_id"), F.coalesce("r.rank_name", F.lit("no rank")).alias("rank"), F.col("r.tax_name").alias("name"))
    known = n.select(F.col("tax_id").alias("parent_tax_id"), F.lit(True).alias("known"))
    return n.join(known, "parent_tax_id", "left").select("tax_id", F.when(F.col("known"), F.col("parent_tax_id")).alias("parent_tax_id"), "rank", "name")


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    n = Scratch(spark).write(_nodes(spark, d), "nodes")
    return Scratch(spark).write(tx.build_taxonomy(n, n.select("tax_id", "name")), "taxonomy")


def _tpc_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Root 1, regions from 10, nations from 100, customers from 1000."""
    region, nation, customer = (table(spark, d, x) for x in ("region", "nation", "customer"))
    root = spark.createDataFrame([(1, 1, "no rank", "root")], "tax_id bigint, parent_tax_id bigint, rank string, name string")
    nodes = (
        root.unionByName(region.select((F.col("r_regionkey") + 10).cast("bigint").alias("tax_id"), F.lit(1).cast("bigint").alias("parent_tax_id"), F.lit("domain").alias("rank"), F.col("r_name").alias("name")))
        .unionByName(nation.select((F.col("n_nationkey") + 100).cast("bigint").alias("tax_id"), (F.col("n_regionkey") + 10).cast("bigint").alias("parent_tax_id"), F.lit("subfamily").alias("rank"), F.col("n_name").alias("name")))
        .unionByName(customer.select((F.col("c_custkey") + 1000).cast("bigint").alias("tax_id"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent_tax_id"), F.lit("species").alias("rank"), F.col("c_name").alias("name")))
    )
    return Scratch(spark).write(tx.build_taxonomy(nodes, nodes.select("tax_id", "name")), "taxonomy")


def tax_paths(spark: SparkSession, d: str) -> DataFrame:
    return _taxonomy(spark, d).select("tax_id", "parent_tax_id", "depth", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


def tax_bfs_ids(spark: SparkSession, d: str) -> DataFrame:
    return _taxonomy(spark, d).select("tax_id", "internal_id", "pre", "post")


def tax_lca_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every node against the two nodes that follow it in the customers' numbering (taxonomy B)."""
    t = _tpc_taxonomy(spark, d)
    pairs = t.select(F.col("tax_id").alias("a"), F.explode(F.array(F.col("tax_id") + 1, F.col("tax_id") + 7)).alias("b"))
    return tx.pair_lca(pairs, t, "a", "b").select("a", "b", "lca")


def tax_lca_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lowest common ancestor of the taxa each sequence id is mapped to."""
    m = table(spark, d, "seqid2taxid").where("seqid IS NOT NULL AND taxid <> 0").select("seqid", F.col("taxid").alias("tax_id"))
    return tx.lca_by_group(m, ["seqid"], "tax_id", _taxonomy(spark, d))


def tax_marked(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "seqid2taxid").select(F.col("taxid").alias("tax_id"))
    return tx.prune(_taxonomy(spark, d), used).select("tax_id", "depth", "internal_id")


def tax_ancestor_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether the taxon a map row names is at or under the node 1592675's kingdom: a theta test by preorder."""
    t = _taxonomy(spark, d)
    m = table(spark, d, "seqid2taxid").where("taxid <> 0").select("map_id", F.col("taxid").alias("b"))
    pairs = m.join(t.select(F.col("tax_id").alias("b"), F.element_at("path", 1).alias("a")), "b", "left")
    return tx.Taxonomy(t).is_ancestor(pairs, "a", "b").groupBy("a", "is_ancestor").agg(F.count("*").alias("n"))


def tax_children(spark: SparkSession, d: str) -> DataFrame:
    t = _tpc_taxonomy(spark, d)
    return tx.Taxonomy(t).child_count(t.select("tax_id", "name"))


def tax_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Parents by release: tax ids whose parent differs between releases."""
    t = table(spark, d, "taxonomy_nodes").where("external_id IS NOT NULL").select("tax_release", F.col("external_id").alias("tax_id"), F.col("parent_id").alias("parent_tax_id"))
    return tx.conflicting_parents([t.where("tax_release = 'r1'"), t.where("tax_release <> 'r1'")])


# ---- reports ----------------------------------------------------------------------------------------------


def _order_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy((F.col("o_custkey") + 1000).alias("tax_id")).agg(F.count("*").alias("reads"))


def rank_codes(spark: SparkSession, d: str) -> DataFrame:
    return rp.rank_codes(_taxonomy(spark, d))


def clade_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders and order lines per customer, nation, region."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    c = table(spark, d, "orders").join(lines, "o_orderkey", "left").groupBy((F.col("o_custkey") + 1000).alias("tax_id")).agg(F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return rp.clade_rollup(c, _tpc_taxonomy(spark, d), ["orders", "lines"])


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return rp.report(_order_counts(spark, d), _tpc_taxonomy(spark, d), unclassified=17).drop("position")


def report_zero(spark: SparkSession, d: str) -> DataFrame:
    return rp.report(_order_counts(spark, d), _tpc_taxonomy(spark, d), zeros=True).agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col("clade_reads") == 0, 1).otherwise(0)).alias("n_zero"))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Position of every line of the report."""
    return rp.report(_order_counts(spark, d), _tpc_taxonomy(spark, d)).select("position", "tax_id")


def report_text(spark: SparkSession, d: str) -> DataFrame:
    return rp.report_lines(rp.report(_order_counts(spark, d), _tpc_taxonomy(spark, d))).select("line")


def mpa_lines(spark: SparkSession, d: str) -> DataFrame:
    return rp.mpa_report(_order_counts(spark, d), _tpc_taxonomy(spark, d))


# ---- sequences --------------------------------------------------------------------------------------------


def _library(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "library").select("seq_no", "header", "id", "seq"))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).select(F.col("seq_no").alias("read_id"), F.lit(0).alias("mate"), "seq")


def _headers_and_map(spark: SparkSession, d: str, where: str = "true") -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "seqid2taxid").where(where).where("seqid IS NOT NULL").select(F.trim("seqid").alias("seqid"), "taxid", F.col("map_id").alias("line"))
    return table(spark, d, "library").select("seq_no", "header").where("header IS NOT NULL"), m


def _taxa(spark: SparkSession, d: str, taxonomy: DataFrame, where: str = "true") -> DataFrame:
    return ix.sequence_taxa(*_headers_and_map(spark, d, where), taxonomy, "seq_no", "header")


def _index(spark: SparkSession, d: str, taxonomy: DataFrame, scheme: Scheme = SMALL, where: str = "true", **options) -> DataFrame:
    lib = _library(spark, d).select(F.col("seq_no").alias("key"), "seq")
    taxa = _taxa(spark, d, taxonomy, where).withColumnRenamed("seq_no", "key")
    return ix.build_index(lib, taxa, taxonomy, scheme, **options)


def minimizer_tokens(spark: SparkSession, d: str) -> DataFrame:
    r = token_runs(_reads(spark, d), SMALL)
    n = F.col("n").cast("bigint")
    return r.groupBy("read_id").agg(F.sum(n).alias("n_tokens"), F.sum(F.when(F.col("minimizer").isNull(), n).otherwise(0)).alias("n_ambiguous"), F.count_distinct("minimizer").alias("n_distinct"), F.min("minimizer").alias("least"), F.max("minimizer").alias("most"), F.sum(F.pmod("minimizer", F.lit(1000003)) * n).alias("checksum"), F.sum(F.when(F.col("is_lookup"), 1).otherwise(0)).alias("n_lookups"))


def minimizer_genome(spark: SparkSession, d: str) -> DataFrame:
    """Tokens under the default scheme for genomes (k=35, l=31, 7 spaces)."""
    r = token_runs(_reads(spark, d), Scheme())
    return r.groupBy("read_id").agg(F.sum(F.col("n").cast("bigint")).alias("n_tokens"), F.count_distinct("minimizer").alias("n_distinct"))


def murmur_hash(spark: SparkSession, d: str) -> DataFrame:
    return with_hash(table(spark, d, "minimizer_data").select("candidate").distinct(), "candidate").select("candidate", "hash")


def downsample(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per database whose hash is in the upper quarter of the unsigned range."""
    h = with_hash(table(spark, d, "minimizer_data").where("candidate IS NOT NULL").select("db_name", "candidate").distinct(), "candidate")
    return h.where(unsigned_at_least("hash", HALF + HALF // 2)).groupBy("db_name").agg(F.count("*").alias("n"))


def capacity_estimate(spark: SparkSession, d: str) -> DataFrame:
    return ix.estimate_keys(_library(spark, d), "seq", SMALL, n=64)


def translate_frames(spark: SparkSession, d: str) -> DataFrame:
    """Length, stops and unknown amino acids of each of the six frames."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f, aa in enumerate(six_frames(s or "")):
                    for c, x in zip(out, (k, f, len(aa), aa.count("*"), aa.count("X"))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["seq_no", "frame", "n_aa", "n_stop", "n_unknown"])

    return _library(spark, d).select("seq_no", "seq").mapInArrow(run, "seq_no bigint, frame bigint, n_aa bigint, n_stop bigint, n_unknown bigint")


def dust_mask(spark: SparkSession, d: str) -> DataFrame:
    m = dust.mask_low_complexity(_library(spark, d).select("seq_no", "seq"))
    return m.select("seq_no", F.length("seq").alias("n"), F.length(F.regexp_replace("seq", "[^acgt]", "")).alias("n_masked"))


def quality_mask(spark: SparkSession, d: str) -> DataFrame:
    """Letters masked when qualities repeat a fixed scale along each sequence."""
    scale = "".join(chr(33 + (i * 7) % 41) for i in range(41))
    long_enough = F.repeat(F.lit(scale), F.ceil(F.length("seq") / 41).cast("int"))
    reads = _library(spark, d).select("seq_no", "seq", F.substring(long_enough, F.lit(1), F.length("seq")).alias("qual"))
    m = cl.mask_quality(reads, 10)
    return m.select("seq_no", (F.length("seq") - F.length(F.replace("seq", F.lit("x"), F.lit("")))).alias("n_masked"))


# ---- index, classification --------------------------------------------------------------------------------


def index_sequence_taxa(spark: SparkSession, d: str) -> DataFrame:
    return _taxa(spark, d, _taxonomy(spark, d))


def index_lca(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, _taxonomy(spark, d))


def index_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return ix.value_counts(_index(spark, d, _taxonomy(spark, d)))


def index_downsampled(spark: SparkSession, d: str) -> DataFrame:
    """Keys per taxon when only the upper half of the hashes is kept."""
    return ix.value_counts(_index(spark, d, _taxonomy(spark, d), least_hash=HALF))


def inspect_index(spark: SparkSession, d: str) -> DataFrame:
    t = _taxonomy(spark, d)
    return rp.inspect(_index(spark, d, t), t).select("pct", "clade_reads", "reads", "rank_code", "tax_id", "depth")


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _taxonomy(spark, d)
    return rp.index_summary(_index(spark, d, t), t, SMALL)


def _classified(spark: SparkSession, d: str, **options) -> tuple[DataFrame, DataFrame]:
    t = _taxonomy(spark, d)
    return cl.classify(_reads(spark, d), _index(spark, d, t), t, SMALL, **options), t


def classify_reads(spark: SparkSession, d: str) -> DataFrame:
    calls, _ = _classified(spark, d, confidence=0.1)
    return calls.select("read_id", "status", "taxon", "length", "n_tokens", "n_ambiguous", "hit_groups", "candidate", "clade_hits", F.md5("hits").alias("hits_md5"))


def classify_quick(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, quick=True)[0].select("read_id", "status", "taxon")


def classify_paired(spark: SparkSession, d: str) -> DataFrame:
    """First and second half of each sequence as mates."""
    lib = _library(spark, d).where("seq IS NOT NULL")
    half = F.floor(F.length("seq") / 2).cast("int")
    one = lib.select(F.col("seq_no").alias("ordinal"), F.concat(F.col("seq_no").cast("string"), F.lit("/1")).alias("id"), F.substring("seq", F.lit(1), half).alias("seq"))
    two = lib.select(F.col("seq_no").alias("ordinal"), F.concat(F.col("seq_no").cast("string"), F.lit("/2")).alias("id"), F.substring("seq", half + 1, F.length("seq")).alias("seq"))
    t = _taxonomy(spark, d)
    calls = cl.classify(cl.pair_mates(one, two), _index(spark, d, t), t, SMALL, confidence=0.1)
    return calls.select("read_id", "status", "taxon", "length", "n_tokens", "hit_groups")


def classify_translated(spark: SparkSession, d: str) -> DataFrame:
    """Six-frame search of the sequences in an index of their own first frames."""
    import pyarrow as pa

    def frame0(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([six_frames(s or "")[0] for s in b.column(1).to_pylist()])], ["key", "seq"])

    t = _taxonomy(spark, d)
    lib = _library(spark, d).select(F.col("seq_no").alias("key"), "seq").mapInArrow(frame0, "key bigint, seq string")
    index = ix.build_index(lib, _taxa(spark, d, t).withColumnRenamed("seq_no", "key"), t, PROTEIN)
    calls = cl.classify(_reads(spark, d), index, t, PROTEIN, translated=True, confidence=0.05)
    return calls.select("read_id", "status", "taxon", "length", "n_tokens", "hit_groups")


def classify_report(spark: SparkSession, d: str) -> DataFrame:
    """Report of the classified reads."""
    calls, t = _classified(spark, d, confidence=0.1)
    calls = Scratch(spark).write(calls, "calls")
    counts = calls.where("taxon IS NOT NULL").groupBy(F.col("taxon").alias("tax_id")).agg(F.count("*").alias("reads"))
    u = calls.where("taxon IS NULL").count()
    return rp.report(counts, t, unclassified=u).select("pct", "clade_reads", "reads", "rank_code", "tax_id", "depth")


def output_lines(spark: SparkSession, d: str) -> DataFrame:
    calls, t = _classified(spark, d, confidence=0.1)
    return cl.output_lines(calls, t)


def classified_headers(spark: SparkSession, d: str) -> DataFrame:
    calls, _ = _classified(spark, d, confidence=0.1)
    calls = Scratch(spark).write(calls, "calls")
    reads = _reads(spark, d)
    return cl.tagged_reads(reads, calls, True).select("read_id", "header").unionByName(cl.tagged_reads(reads, calls, False).select("read_id", "header"))


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    calls, _ = _classified(spark, d, confidence=0.1)
    return cl.run_statistics(_reads(spark, d), calls)


def _hits(spark: SparkSession, d: str, taxonomy: DataFrame) -> DataFrame:
    """``minimizer, n, lo, hi`` of the minimizers that the reads look up and the index has."""
    places = ix.sequence_places(*_headers_and_map(spark, d), taxonomy, "seq_no", "header")
    ends = ix.index_ends(_library(spark, d).select("seq_no", "seq"), places, SMALL, key="seq_no")
    # both sides lie by minimizer already; by the scan's size a planner takes either for small and builds it on the driver
    return lookup_counts(_reads(spark, d), SMALL).hint("merge").join(ends, "minimizer")


def kmer_counters(spark: SparkSession, d: str) -> DataFrame:
    t = _taxonomy(spark, d)
    return rp.hit_counts(_hits(spark, d, t), t)


def kmer_sketches(spark: SparkSession, d: str) -> DataFrame:
    t = _taxonomy(spark, d)
    return rp.hit_sketches(_hits(spark, d, t), t).select("tax_id", "estimate")


def merge_two_dbs(spark: SparkSession, d: str) -> DataFrame:
    """Classifications by the indexes of two databases, merged."""
    t = _taxonomy(spark, d)
    scratch = Scratch(spark)
    a, b = (scratch.write(cl.classify(_reads(spark, d), _index(spark, d, t, where=w), t, SMALL), "calls") for w in ("db_name = 'core'", "db_name IS NULL OR db_name <> 'core'"))
    return mg.merge(a, b, t, confidence=0.1).select("read_id", "status", "taxon", "revote", "n_tokens", F.md5("hits").alias("hits_md5"))


# ---- ids and maps -----------------------------------------------------------------------------------------


def header_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "prelim_map").where("seqid IS NOT NULL").select("prelim_id", F.trim("seqid").alias("seqid"))
    return ids.select("prelim_id", id_kind(F.col("seqid")).alias("kind"), id_value(F.col("seqid")).alias("value"))


def header_scan(spark: SparkSession, d: str) -> DataFrame:
    """The preliminary map of all library headers."""
    return accessions.scan_headers(table(spark, d, "library"), "header", lenient=True)


def header_rewrite(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "seqid2taxid").where("taxid <> 0 AND seqid IS NOT NULL")
    return m.select("map_id", tagged_header(F.col("taxid"), F.trim("seqid")).alias("header"), assembly_accession(F.concat(F.lit("x GCF_"), F.lpad(F.col("map_id").cast("string"), 9, "0"), F.lit(".2 y"))).alias("assembly"))


def sequence_text(spark: SparkSession, d: str) -> DataFrame:
    """Sequences as wrapped lines with U for T undone."""
    return _library(spark, d).select("seq_no", F.md5(wrapped(rna_to_dna(F.translate("seq", "T", "U")), 70)).alias("text_md5"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prelim_map").where("map_kind = 'ACCNUM' AND mapped_value IS NOT NULL")
    return p.select(F.col("prelim_id").alias("seqid"), F.trim("mapped_value").alias("accession"))


def _accession_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accession2taxid").where("accession IS NOT NULL AND taxid IS NOT NULL").select("accession", "taxid", "gi", F.col("acc_row").alias("line"))


def map_accessions(spark: SparkSession, d: str) -> DataFrame:
    return accessions.map_accessions(_wanted(spark, d), _accession_rows(spark, d))


def map_accessions_gi(spark: SparkSession, d: str) -> DataFrame:
    """Accessions or gi numbers."""
    a = _accession_rows(spark, d)
    ids = a.select(F.col("line").alias("seqid"), F.when(F.col("line") % 2 == 0, F.col("gi").cast("string")).otherwise(F.col("accession")).alias("accession"))
    return accessions.map_accessions(ids, a, also_gi=True)


def unmapped_accessions(spark: SparkSession, d: str) -> DataFrame:
    return accessions.unmapped(_wanted(spark, d), _accession_rows(spark, d))


def repair_taxids(spark: SparkSession, d: str) -> DataFrame:
    """The id map against the nodes, old ids remapped to a deleted node's parent."""
    nodes = table(spark, d, "taxonomy_nodes").where("deleted_at IS NULL").select(F.col("external_id").alias("tax_id"))
    merged = table(spark, d, "taxonomy_nodes").where("deleted_at IS NOT NULL AND parent_id IS NOT NULL").select(F.col("external_id").alias("old"), F.col("parent_id").alias("new"))
    m = table(spark, d, "seqid2taxid").where("taxid <> 0").select(F.col("map_id").alias("seqid"), "taxid")
    return accessions.repair_map(m, nodes, merged)


def assembly_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("taxid"), F.when(F.col("p_size") % 3 == 0, "Complete Genome").when(F.col("p_size") % 3 == 1, "Contig").otherwise("CHROMOSOME").alias("level"), F.when(F.col("p_size") % 5 == 0, "na").otherwise(F.col("p_name")).alias("path"))
    return accessions.filter_assemblies(p)


def lineage_to_tree(spark: SparkSession, d: str) -> DataFrame:
    return lineage.taxonomy_from_lineages(_lineages(spark, d), "lineage", binomial=True).select("tax_id", "parent_tax_id", "rank", "name")


def _lineages(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("c_custkey", F.concat(F.lit("d__"), "r_name", F.lit("; p__"), "n_name", F.lit("; g__"), "c_mktsegment", F.lit("; s__"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x"), (F.col("c_custkey") % 10).cast("string"))).otherwise("")).alias("lineage"))


def lineage_members(spark: SparkSession, d: str) -> DataFrame:
    rows = _lineages(spark, d)
    t = lineage.taxonomy_from_lineages(rows, "lineage")
    m = lineage.lineage_map(rows, "c_custkey", "lineage", t)
    return m.join(t.select("tax_id", "rank"), "tax_id").groupBy("rank").agg(F.count("*").alias("n"))


def lineage_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = lineage.split_groups(_lineages(spark, d), "lineage", ["FRANCE", "CHINA", "BRAZIL"])
    return rows.groupBy("part").agg(F.count("*").alias("n"))


# ---- files and streams ------------------------------------------------------------------------------------


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The library written as FASTA text and read back by the data source, in byte ranges."""
    folder = Scratch(spark).root + "/fasta"
    lib = _library(spark, d).where("seq IS NOT NULL")
    lib.select(fasta_text(F.concat_ws(" ", F.col("seq_no").cast("string"), F.lit("length"), F.length("seq").cast("string")), F.col("seq")).alias("value")).write.text(folder)
    back = read_fastx(spark, folder, splitBytes=1 << 20)
    return back.select(F.col("id").cast("bigint").alias("seq_no"), "comment", F.md5("seq").alias("seq_md5"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads per taxon of the library classified as a stream."""
    t = _taxonomy(spark, d)
    scratch = Scratch(spark)
    index = scratch.write(_index(spark, d, t), "index")
    reads = scratch.write(_reads(spark, d), "reads")
    stream = spark.readStream.schema(reads.schema).parquet(reads._cw_path)
    service = ClassifyService(index, t, SMALL, confidence=0.1)
    service.start(stream, scratch.root + "/stream", scratch.root + "/stream-checkpoint").awaitTermination()
    return running_counts(index, scratch.root + "/stream")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which taxon is each read? End to end: map, taxonomy, index, classification."""
    calls, _ = _classified(spark, d)
    return calls.select("read_id", "status", "taxon", "candidate", "clade_hits", "hit_groups")


_QUERIES = (
    tax_paths, tax_bfs_ids, tax_lca_pairs, tax_lca_groups, tax_marked, tax_ancestor_test, tax_children, tax_conflicts,
    rank_codes, clade_rollup, report_rows, report_zero, report_order, report_text, mpa_lines,
    minimizer_tokens, minimizer_genome, murmur_hash, downsample, capacity_estimate, translate_frames, dust_mask, quality_mask,
    index_sequence_taxa, index_lca, index_value_counts, index_downsampled, inspect_index, index_summary,
    classify_reads, classify_quick, classify_paired, classify_translated, classify_report, output_lines, classified_headers, run_statistics,
    kmer_counters, kmer_sketches, merge_two_dbs,
    header_ids, header_scan, header_rewrite, sequence_text, map_accessions, map_accessions_gi, unmapped_accessions, repair_taxids, assembly_filter,
    lineage_to_tree, lineage_members, lineage_parts, fasta_round_trip, stream_counts,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
