"""More queries of the classification engine over the test tables: sinks, sources, options, several databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.functions.columns import fields
from cladeworks.functions.kmers import Scheme
from cladeworks.operators import accessions, classify as cl, index as ix, lineage, merge as mg, report as rp, taxonomy as tx
from cladeworks.operators.tokens import token_runs
from cladeworks.plans.core_queries import HALF, SMALL, _classified, _index, _library, _lineages, _reads, _taxonomy
from cladeworks.plans.engine_sql import ORACLES
from cladeworks.session import Scratch, table
from cladeworks.sources import tables
from cladeworks.sources.fastx import read_fastx, write_text

GENOME = Scheme()


# ---- options of classification ----------------------------------------------------------------------------


def classify_compat_quick(spark: SparkSession, d: str) -> DataFrame:
    """Quick search that votes on the hits before the deciding one."""
    return _classified(spark, d, quick="compat", confidence=0.1)[0].select("read_id", "status", "taxon")


def classify_documented(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous tokens left out of the confidence's denominator."""
    return _classified(spark, d, confidence=0.3, denominator="documented")[0].select("read_id", "status", "taxon", "clade_hits")


def classify_downsampled(spark: SparkSession, d: str) -> DataFrame:
    """An index of the upper half of the hashes, and look-ups of that half only."""
    t = _taxonomy(spark, d)
    calls = cl.classify(_reads(spark, d), _index(spark, d, t, least_hash=HALF), t, SMALL, confidence=0.1, least_hash=HALF)
    return calls.select("read_id", "status", "taxon", "n_tokens", "n_ambiguous", "hit_groups", F.md5("hits").alias("hits_md5"))


def classify_genome(spark: SparkSession, d: str) -> DataFrame:
    """Index and calls under the default scheme for genomes (k=35, l=31, 7 spaces)."""
    t = _taxonomy(spark, d)
    calls = cl.classify(_reads(spark, d), _index(spark, d, t, GENOME), t, GENOME, confidence=0.1)
    return calls.select("read_id", "status", "taxon", "n_tokens", "n_ambiguous", "hit_groups", "candidate", "clade_hits")


def index_genome(spark: SparkSession, d: str) -> DataFrame:
    return ix.value_counts(_index(spark, d, _taxonomy(spark, d), GENOME))


def minimizer_strict(spark: SparkSession, d: str) -> DataFrame:
    """Tokens when windows must be whole after an ambiguous letter."""
    r = token_runs(_reads(spark, d), Scheme(k=15, l=11, spaces=2, strict=True))
    n = F.col("n").cast("bigint")
    return r.groupBy("read_id").agg(F.sum(n).alias("n_tokens"), F.sum(F.when(F.col("minimizer").isNull(), n).otherwise(0)).alias("n_ambiguous"), F.sum(F.pmod("minimizer", F.lit(1000003)) * n).alias("checksum"))


def index_probe(spark: SparkSession, d: str) -> DataFrame:
    """How many of each sequence's minimizers the database "core" knows."""
    t = _taxonomy(spark, d)
    return cl.probe(token_runs(_reads(spark, d), SMALL), _index(spark, d, t, where="db_name = 'core'"))


def max_keys_index(spark: SparkSession, d: str) -> DataFrame:
    """An index held to about 20,000 keys by the hash threshold that an estimate of all sequences' keys gives."""
    keys = ix.estimate_keys(_library(spark, d), "seq", SMALL, n=64).first().estimate
    least = ix.threshold_for(keys, 20_000)
    kept = _index(spark, d, _taxonomy(spark, d), least_hash=least)
    return kept.agg((F.count("*") <= 21_000).alias("small_enough"))


# ---- reports ----------------------------------------------------------------------------------------------


def _report_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    t = _taxonomy(spark, d)
    scratch = Scratch(spark)
    index = scratch.write(_index(spark, d, t), "index")
    calls = scratch.write(cl.classify(_reads(spark, d), index, t, SMALL, confidence=0.1).select("taxon"), "calls")
    reads = calls.where("taxon IS NOT NULL").groupBy(F.col("taxon").alias("tax_id")).agg(F.count("*").alias("reads"))
    found = cl.lookup(token_runs(_reads(spark, d), SMALL), index)
    own = rp.minimizer_counts(found, t).select("tax_id", "minimizers", "distinct_minimizers")
    counts = own.join(reads, "tax_id", "full").fillna(0, ["reads", "minimizers", "distinct_minimizers"])
    return counts, t, calls.where("taxon IS NULL").count()


def report_minimizers(spark: SparkSession, d: str) -> DataFrame:
    """The report of the classified reads with look-ups and distinct minimizers per clade."""
    counts, t, u = _report_counts(spark, d)
    return rp.report(counts, t, unclassified=u).select("pct", "clade_reads", "reads", "minimizers", "distinct_minimizers", "rank_code", "tax_id", "depth")


def clade_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of distinct minimizers per clade from united sketches, against the exact numbers: within 10 %?"""
    t = _taxonomy(spark, d)
    found = Scratch(spark).write(cl.lookup(token_runs(_reads(spark, d), SMALL), _index(spark, d, t)), "found")
    united = rp.clade_sketches(rp.minimizer_sketches(found), t).select("tax_id", "estimate")
    exact = rp.minimizer_counts(found, t).select("tax_id", F.col("clade_distinct_minimizers").alias("n_exact"))
    return united.join(exact, "tax_id", "full").select("tax_id", "n_exact", (F.abs(F.col("estimate") - F.col("n_exact")) <= 0.1 * F.col("n_exact") + 1).alias("within"))


def report_two_dbs(spark: SparkSession, d: str) -> DataFrame:
    """Inspection of two databases one after another, percentages of both together."""
    t = _taxonomy(spark, d)
    parts = [rp.inspect(_index(spark, d, t, where=w), t) for w in ("db_name = 'core'", "db_name IS NULL OR db_name <> 'core'")]
    return rp.renormalise(parts).select("part", "pct", "clade_reads", "reads", "tax_id")


# ---- sinks ------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Library records as reads with quality, where the sequence has an even number."""
    seq = F.coalesce("seq", F.lit(""))
    qual = F.when(F.col("seq_no") % 2 == 0, F.repeat(F.lit("I"), F.length(seq)))
    return _library(spark, d).select(F.col("seq_no").alias("read_id"), F.lit(0).alias("mate"), F.concat(F.lit("r"), F.col("seq_no").cast("string")).alias("header"), seq.alias("seq"), qual.alias("qual"))


def read_sink(spark: SparkSession, d: str) -> DataFrame:
    """Classified and unclassified records as text, written to their folders and read back."""
    calls, _ = _classified(spark, d, confidence=0.1)
    folder = Scratch(spark).root + "/records"
    cl.write_sequence_outputs(cl.sequence_outputs(_records(spark, d), calls), folder)
    back = spark.read.text(folder).where("value LIKE '>%' OR value LIKE '@r%'")
    return back.select("status", F.col("mate").cast("int").alias("mate"), F.substring("value", 2, 100).alias("header"))


def paired_sink(spark: SparkSession, d: str) -> DataFrame:
    """Both mates of classified and unclassified pairs."""
    lib = _library(spark, d).where("seq IS NOT NULL")
    half = F.floor(F.length("seq") / 2).cast("int")
    parts = ((1, F.substring("seq", F.lit(1), half)), (2, F.substring("seq", half + 1, F.length("seq"))))
    mates = F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), s.alias("seq")) for m, s in parts]))
    reads = lib.select(F.col("seq_no").alias("read_id"), mates.alias("m")).select("read_id", "m.mate", F.concat_ws("/", F.col("read_id").cast("string"), F.col("m.mate").cast("string")).alias("header"), "m.seq")
    t = _taxonomy(spark, d)
    calls = cl.classify(reads, _index(spark, d, t), t, SMALL, confidence=0.1)
    return cl.sequence_outputs(reads, calls).select("read_id", "mate", "status", F.md5("text").alias("text_md5"))


def ordered_output(spark: SparkSession, d: str) -> DataFrame:
    """Output lines written in the order of the reads: number of lines that stand before a smaller read id's."""
    calls, _ = _classified(spark, d, confidence=0.1)
    folder = Scratch(spark).root + "/lines"
    write_text(cl.output_lines(calls), folder, "line", order="read_id")
    lines = spark.read.text(folder).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.split_part("value", F.lit("\t"), F.lit(2)).cast("bigint").alias("read_id"))
    spans = lines.groupBy("file").agg(F.min("read_id").alias("lo"), F.max("read_id").alias("hi"), F.count("*").alias("n"))
    w = F.lag("hi").over(Window.orderBy("file"))  # a row per file
    return spans.select("n", F.coalesce((w > F.col("lo")).cast("int"), F.lit(0)).alias("late")).agg(F.sum("n").alias("n_lines"), F.sum("late").cast("bigint").alias("n_late"))


def database_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """An index folder written, found by its name and loaded: keys per taxon."""
    t = _taxonomy(spark, d)
    index = Scratch(spark).write(_index(spark, d, t), "index")
    root = Scratch(spark).root
    tables.save_database(index, t, rp.index_summary(index, t, SMALL), f"{root}/standard")
    loaded, _, summary = tables.load_database(spark, f"{root}/standard")
    return ix.value_counts(loaded).join(F.broadcast(summary.select("k", "l", "n_keys")))  # one row


def prelim_map_file(spark: SparkSession, d: str) -> DataFrame:
    """The preliminary map written as tab-separated text and read back."""
    folder = Scratch(spark).root + "/prelim"
    rows = accessions.scan_headers(table(spark, d, "library"), "header", lenient=True).select("map_kind", "seqid", "mapped_value")
    tables.write_tsv(rows, folder)
    return spark.read.csv(folder, sep="\t", schema="map_kind string, seqid string, mapped_value string")


# ---- sources ----------------------------------------------------------------------------------------------


def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The library written as compressed FASTQ and read back."""
    folder = Scratch(spark).root + "/fastq"
    records = _records(spark, d).where("qual IS NOT NULL AND seq <> ''")
    records.select(cl.record_text(records).alias("value")).write.option("compression", "gzip").text(folder)
    return read_fastx(spark, folder).select("id", F.md5("seq").alias("seq_md5"), F.length("qual").alias("n_qual"))


def taxonomy_dump(spark: SparkSession, d: str) -> DataFrame:
    """Taxonomy B written as dump files, read back and built: depth and parent of every node."""
    from cladeworks.plans.core_queries import _tpc_taxonomy

    t = _tpc_taxonomy(spark, d)
    root = Scratch(spark).root
    bar = "\t|\t"
    t.select(F.concat(F.concat_ws(bar, F.col("tax_id").cast("string"), F.coalesce("parent_tax_id", F.lit(1)).cast("string"), "rank", F.lit("")), F.lit("\t|")).alias("value")).write.text(f"{root}/nodes.dmp")
    t.select(F.concat(F.concat_ws(bar, F.col("tax_id").cast("string"), "name", F.lit(""), F.lit("scientific name")), F.lit("\t|")).alias("value")).write.text(f"{root}/names.dmp")
    back = tx.build_taxonomy(tables.read_nodes(spark, f"{root}/nodes.dmp"), tables.read_names(spark, f"{root}/names.dmp"))
    return back.select("tax_id", "parent_tax_id", "rank", "name", "depth")


def map_files(spark: SparkSession, d: str) -> DataFrame:
    """Two id maps written as text, read back and united: the second one's rows count."""
    root = Scratch(spark).root
    m = table(spark, d, "seqid2taxid").where(r"seqid IS NOT NULL AND NOT trim(seqid) RLIKE '\\s' AND trim(seqid) <> '' AND taxid IS NOT NULL")
    for name, part in (("a", "map_id % 2 = 0"), ("b", "map_id % 2 = 1")):
        best = m.where(part).groupBy(F.trim("seqid").alias("seqid")).agg(F.max("taxid").alias("taxid"))
        best.select(F.concat_ws("\t", "seqid", F.col("taxid").cast("string")).alias("value")).write.text(f"{root}/{name}.map")
    return accessions.union_maps(tables.read_seqid_map(spark, f"{root}/a.map"), tables.read_seqid_map(spark, f"{root}/b.map"))


def library_parts(spark: SparkSession, d: str) -> DataFrame:
    """Files added to a library, one of them twice: records and distinct sequences per part."""
    root = Scratch(spark).root
    lib = table(spark, d, "library").select("id", "header", "seq", "seq_no")
    for part, rows in (("even", "seq_no % 2 = 0"), ("odd", "seq_no % 2 = 1"), ("odd", "seq_no % 2 = 1")):
        tables.add_to_library(lib.where(rows), root, part)
    out = tables.read_library(spark, root).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("seq_md5").alias("n_distinct"))
    out = Scratch(spark).write(out, "counted")
    tables.clean(spark, root)
    return out


# ---- taxonomy helpers, lineages ---------------------------------------------------------------------------


def tax_ancestor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Is the taxon of a map row at or under the taxon of the row before it? Counts of both answers."""
    t = _taxonomy(spark, d)
    m = table(spark, d, "seqid2taxid").where("taxid <> 0").select("map_id", F.col("taxid").alias("b"))
    pairs = m.join(m.select((F.col("map_id") + 1).alias("map_id"), F.col("b").alias("a")), "map_id")
    up = t.select(F.col("tax_id").alias("a"), F.element_at("path", 1).alias("root"))
    # the row before, and its root, so that both answers occur
    both = pairs.join(up, "a", "left").select("b", F.explode(F.array_compact(F.array("a", "root"))).alias("a"))
    return tx.Taxonomy(t).is_ancestor(both, "a", "b").groupBy("is_ancestor").agg(F.count("*").alias("n"))


def tax_conflicts_planted(spark: SparkSession, d: str) -> DataFrame:
    """Taxonomy A against a copy in which every tenth node hangs under its grandparent."""
    t = _taxonomy(spark, d).select("tax_id", "parent_tax_id", "path")
    moved = F.when((F.col("tax_id") % 10 == 0) & (F.size("path") > 2), F.try_element_at("path", F.lit(-3))).otherwise(F.col("parent_tax_id"))
    return tx.conflicting_parents([t, t.withColumn("parent_tax_id", moved)])


def tax_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Taxids of the accession table that are no living nodes."""
    nodes = table(spark, d, "taxonomy_nodes").where("deleted_at IS NULL").select(F.col("external_id").alias("tax_id"))
    return lineage.unknown_taxids(table(spark, d, "accession2taxid").withColumnRenamed("taxid", "ncbi_taxid"), nodes)


def tax_remapped(spark: SparkSession, d: str) -> DataFrame:
    """Taxids of the id map, those of deleted nodes replaced by the nodes' parents."""
    nodes = table(spark, d, "taxonomy_nodes")
    alive = nodes.where("deleted_at IS NULL").select(F.col("external_id").alias("tax_id"))
    gone = nodes.where("deleted_at IS NOT NULL").select(F.col("external_id").alias("old"), F.col("parent_id").alias("new"))
    return lineage.remap_taxids(table(spark, d, "seqid2taxid").select("map_id", "taxid"), "taxid", alive, gone)


def lineage_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = _lineages(spark, d)
    names = [lineage.name_at_level(F.col("lineage"), x).alias(n) for x, n in (("d", "domain"), ("p", "phylum"), ("s", "species"))]
    return rows.select("c_custkey", *names).groupBy("domain", "phylum", "species").agg(F.count("*").alias("n"))


def size_bins(spark: SparkSession, d: str) -> DataFrame:
    """Library records packed in bins of at most 30,000 letters: bins, records, overfull bins of several records."""
    sized = table(spark, d, "library").select("seq_no", F.coalesce(F.length("seq"), F.lit(0)).alias("n"))
    bins = lineage.bin_pack(sized, "n", 30_000).groupBy("bin").agg(F.sum("n").alias("size"), F.count("*").alias("records"))
    few = F.count("*") <= F.ceil(F.sum("size") / 30_000) * 2 + 30_000
    return bins.agg(F.sum("records").alias("n_records"), F.sum(F.when((F.col("size") > 30_000) & (F.col("records") > 1), 1).otherwise(0)).cast("bigint").alias("n_overfull"), few.alias("few_bins"))


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """The first two blank-separated fields of each header; the rest is dropped."""
    return table(spark, d, "library").where("header IS NOT NULL").select("seq_no", F.array_join(fields(F.col("header"), " ", 2), "|").alias("two"))


def interleaved_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent library records as mates."""
    lib = _library(spark, d).orderBy("seq_no")
    ordered = Scratch(spark).write(lib.select("seq_no", "seq"), "ordered")
    first = ordered.agg(F.min("seq_no").alias("lo"), (F.floor(F.count("*") / 2) * 2).alias("even")).first()
    reads = ordered.select((F.col("seq_no") - first.lo).alias("ordinal"), F.col("seq_no").cast("string").alias("id"), "seq").where(F.col("ordinal") < first.even)
    out = cl.pair_interleaved(reads)
    return out.select("read_id", "mate", F.coalesce(F.length("seq"), F.lit(0)).alias("n"))


def merge_three_dbs(spark: SparkSession, d: str) -> DataFrame:
    """Classifications by three databases merged, by the lowest common ancestor of the calls."""
    t = _taxonomy(spark, d)
    scratch = Scratch(spark)
    parts = ("db_name = 'core'", "db_name <> 'core'", "db_name IS NULL")
    calls = [scratch.write(cl.classify(_reads(spark, d), _index(spark, d, t, where=w), t, SMALL, confidence=0.1), "calls") for w in parts]
    out = mg.merge_all(calls, t, policy="lca")
    return out.select("read_id", "status", "taxon", "n_tokens")


_QUERIES = (
    classify_compat_quick, classify_documented, classify_downsampled, classify_genome, index_genome, minimizer_strict, index_probe, max_keys_index,
    report_minimizers, clade_sketches, report_two_dbs,
    read_sink, paired_sink, ordered_output, database_round_trip, prelim_map_file,
    fastq_round_trip, taxonomy_dump, map_files, library_parts,
    tax_ancestor_pairs, tax_conflicts_planted, tax_unknown, tax_remapped, lineage_levels, size_bins, header_fields, interleaved_pairs, merge_three_dbs,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
