import random

import pytest
from pyspark.sql import functions as F

from cladeworks.functions.kmers import Scheme
from cladeworks.operators import classify as cl
from cladeworks.operators import index as ix
from cladeworks.operators import report as rp
from cladeworks.operators import taxonomy as tx
from cladeworks.operators import tree as tr
from cladeworks.operators.tokens import lookup_counts, token_runs
from cladeworks.plans import core_queries

SC = Scheme(k=8, l=6, spaces=0)


@pytest.fixture(scope="module")
def forest(spark):
    """Two trees of 30 nodes."""
    rng = random.Random(11)
    rows = [(root + i, root + rng.randrange(i) if i else None, "r") for root in (1, 101) for i in range(30)]
    return tx.build_taxonomy(spark.createDataFrame(rows, "tax_id bigint, parent_tax_id bigint, rank string")).cache()


@pytest.fixture(scope="module")
def tables(spark, forest):
    """Reads that share letters with the library; headers of several ids, some in both trees, unknown or of no node."""
    rng = random.Random(5)
    ids = [(f"i{i}", rng.choice([*range(1, 31), *range(101, 131), 0, 999]), i) for i in range(60)]
    ids.append(("i3", 7, 100))
    seqs = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(25)]
    library = [(i, rng.choice(" \x01").join(rng.choice(ids)[0] for _ in range(rng.randint(1, 3))), seqs[i % 20] if i % 7 else None) for i in range(40)]
    reads = [(i, i % 2, rng.choice(seqs)[:40] + rng.choice(["", "N", "NN"]) + rng.choice(seqs)[10:60]) for i in range(60)] + [(60, 0, None), (61, 0, ""), (62, 0, "ACG")]
    return (
        spark.createDataFrame(library, "key bigint, header string, seq string"),
        spark.createDataFrame(ids, "seqid string, taxid bigint, line bigint"),
        spark.createDataFrame(reads, "read_id bigint, mate int, seq string"),
    )


def _hits(tables, forest):
    library, ids, reads = tables
    places = ix.sequence_places(library, ids, forest, "key", "header")
    return lookup_counts(reads, SC).join(ix.index_ends(library, places, SC), "minimizer")


def _found(tables, forest):
    library, ids, reads = tables
    index = ix.build_index(library, ix.sequence_taxa(library, ids, forest, "key", "header"), forest, SC)
    return cl.lookup(token_runs(reads, SC), index)


def _sorted(df):
    return sorted(map(tuple, df.collect()))


def test_places_are_the_taxa_of_sequences(tables, forest):
    library, ids, _ = tables
    by_taxon = ix.sequence_taxa(library, ids, forest, "key", "header").join(forest.select(F.col("tax_id").alias("taxon"), "pre"), "taxon").select("key", "pre")
    got = _sorted(ix.sequence_places(library, ids, forest, "key", "header"))
    assert got == _sorted(by_taxon) and 0 < len(got) < 40


def test_look_ups_are_those_of_the_runs(tables):
    reads = tables[2]
    runs = token_runs(reads, SC).where("is_lookup").groupBy("minimizer").agg(F.count("*").alias("n"))
    assert _sorted(lookup_counts(reads, SC)) == _sorted(runs)
    assert lookup_counts(reads.where("false"), SC).count() == 0


def test_hit_counts_against_runs(tables, forest):
    want = _sorted(rp.minimizer_counts(_found(tables, forest), forest))
    assert _sorted(rp.hit_counts(_hits(tables, forest), forest)) == want
    assert len(want) > 10
    assert rp.hit_counts(_hits(tables, forest).where("false"), forest).count() == 0


def _no_tree(taxonomy):
    raise AssertionError("the tree came to the driver")


def test_kmer_counters_leave_the_tree_where_it_is(spark, monkeypatch):
    for module in (tr, tx, cl):
        monkeypatch.setattr(module, "small_tree", _no_tree)
    assert core_queries.kmer_counters(spark, "/root/testdata/sf0.001").count() > 0


def test_hit_sketches_against_runs(tables, forest):
    want = _sorted(rp.minimizer_sketches(_found(tables, forest)).select("tax_id", "estimate"))
    got = rp.hit_sketches(_hits(tables, forest), forest)
    assert _sorted(got.select("tax_id", "estimate")) == want and want
    own = rp.hit_counts(_hits(tables, forest), forest).where("distinct_minimizers > 0")
    assert _sorted(own.select("tax_id", "distinct_minimizers")) == want  # so few are told exactly


def test_kmer_sketches_leave_the_tree_where_it_is(spark, monkeypatch):
    for module in (tr, tx, cl):
        monkeypatch.setattr(module, "small_tree", _no_tree)
    assert core_queries.kmer_sketches(spark, "/root/testdata/sf0.001").count() > 0


def test_look_ups_are_not_broadcast(spark):
    d = "/root/testdata/sf0.001"
    plan = core_queries._hits(spark, d, core_queries._taxonomy(spark, d))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [minimizer" in plan and "BroadcastHashJoin [minimizer" not in plan
