import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.functions.kmers import Scheme
from cladeworks.operators import accessions, classify as cl, index as ix, lineage, taxonomy as tx, tokens, tree

SC = Scheme(k=8, l=6, spaces=0)


def _tree(spark, n, seed):
    rng = random.Random(seed)
    parent = {1: 1} | {i: rng.randint(1, i - 1) for i in range(2, n + 1)}
    nodes = spark.createDataFrame([(k, p, "no rank") for k, p in parent.items()], "tax_id bigint, parent_tax_id bigint, rank string")
    return tx.build_taxonomy(nodes).cache()


@pytest.fixture(scope="module")
def setup(spark):
    rng = random.Random(3)
    t = _tree(spark, 30, 1)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(80))) for i in range(1, 31)]
    seqs = [(i, s if i % 3 else seqs[i - 2][1][:50] + s[50:]) for i, s in seqs]
    lib = spark.createDataFrame(seqs, "key bigint, seq string")
    index = ix.build_index(lib, spark.createDataFrame([(i, i) for i, _ in seqs], "key bigint, taxon bigint"), t, SC).cache()
    reads = []
    for i in range(60):
        parts = [rng.choice(seqs)[1][rng.randrange(40) :][: rng.randrange(9, 40)] for _ in range(rng.randrange(1, 4))]
        reads.append((i, 0, rng.choice(["", "N", "NN"]).join(parts)))
    reads += [(100, 0, None), (101, 0, ""), (102, 0, "N" * 20), (103, 0, "ACG")]
    return t, index, spark.createDataFrame(reads, "read_id bigint, mate int, seq string")


@pytest.mark.parametrize("options", [{"confidence": 0.2}, {"confidence": 0.6, "denominator": "documented"}, {"quick": "compat", "min_hit_groups": 3}, {"quick": True}])
def test_trees_too_large_to_broadcast_give_the_same_calls(setup, monkeypatch, options):
    t, index, reads = setup
    small = {r.read_id: r for r in cl.classify(reads, index, t, SC, **options).collect()}
    monkeypatch.setattr(tree, "MOST_NODES", 3)
    large = {r.read_id: r for r in cl.classify(reads, index, t, SC, **options).collect()}
    assert small == large and len(small) == 64 and sum(r.status == "C" for r in small.values()) > 10


def test_ends_of_large_trees(spark, monkeypatch):
    t = _tree(spark, 40, 2)
    rng = random.Random(4)
    df = spark.createDataFrame([(g, rng.randint(1, 40)) for g in range(30) for _ in range(rng.randint(1, 4))], "g int, taxon bigint")
    small = {tuple(r) for r in tx.lca_by_group(df, ["g"], "taxon", t).collect()}
    monkeypatch.setattr(tree, "MOST_NODES", 3)
    assert {tuple(r) for r in tx.lca_by_group(df, ["g"], "taxon", t).collect()} == small and len(small) == 30


def test_forests_have_no_common_ancestor(spark):
    t = tx.build_taxonomy(spark.createDataFrame([(1, 1, "r"), (2, 2, "r"), (3, 1, "r")], "tax_id bigint, parent_tax_id bigint, rank string"))
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "g int, taxon bigint")
    assert {tuple(r) for r in tx.lca_by_group(df, ["g"], "taxon", t).collect()} == {(1, None), (2, 1)}


def test_a_repeated_node_keeps_one_rows_values(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "genus"), (3, 1, "genus"), (5, 2, "species"), (5, 3, "family")], "tax_id bigint, parent_tax_id bigint, rank string")
    assert {(r.parent_tax_id, r.rank) for r in tx.build_taxonomy(nodes).where("tax_id = 5").collect()} == {(2, "species")}


@pytest.mark.parametrize("scheme", [SC, Scheme(k=8, l=8, spaces=2), Scheme(k=12, l=5, spaces=0, strict=True), Scheme()])
def test_long_sequences_in_pieces_have_the_same_runs(monkeypatch, scheme):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in (0, 5, 700, 1300, 41)] + ["A" * 500, "N" * 300]
    whole = tokens.sequence_runs(seqs, scheme)
    for limit in (37, 64, 200):
        monkeypatch.setattr(tokens, "PIECE", limit)
        assert all((a == b).all() for a, b in zip(whole, tokens.sequence_runs(seqs, scheme)))


def test_mates_in_any_order(setup, spark):
    t, index, reads = setup
    pairs = reads.where("read_id < 30").select("read_id", F.lit(1).alias("mate"), "seq").union(reads.where("read_id >= 30 AND read_id < 60").select(F.col("read_id") - 30, F.lit(2), "seq"))
    got = {r.read_id: r for r in cl.classify(pairs.repartition(7), index, t, SC).collect()}
    one = {r.read_id: r for r in cl.classify(reads, index, t, SC).collect()}
    for i, r in got.items():
        assert r.length == one[i].length + "|" + one[i + 30].length and r.n_tokens == one[i].n_tokens + one[i + 30].n_tokens
        assert r.hits == (one[i].hits.strip() + " |:| " + one[i + 30].hits if one[i].n_tokens and one[i + 30].n_tokens else r.hits)


def test_bins_hold_their_capacity(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([0, 1, 3, 10, 40, 99, 100, 250])) for i in range(500)]
    rows = lineage.bin_pack(spark.createDataFrame(sizes, "id int, n int"), "n", 100).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r.n)
    assert len(rows) == 500 and all(sum(b) <= 100 or len(b) == 1 for b in bins.values())
    assert len(bins) <= 2 * sum(n for _, n in sizes if n <= 100) / 100 + sum(n > 100 for _, n in sizes) + 8


def test_maps_united_and_repaired(spark):
    a = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 0, 3), (None, 4, 4)], "seqid string, taxid bigint, line bigint")
    b = spark.createDataFrame([("y", 7), ("z", 8)], "seqid string, taxid bigint")
    assert {tuple(r) for r in accessions.union_maps(a, b).collect()} == {("x", 2), ("y", 7), ("z", 8)}
    nodes, old = spark.createDataFrame([(1,), (2,)], "tax_id bigint"), spark.createDataFrame([(9, 2), (9, 5)], "old bigint, new bigint")
    df = spark.createDataFrame([(1, 1), (2, 9), (3, 77), (4, None)], "k int, taxid bigint")
    assert {(r.k, r.taxid) for r in lineage.remap_taxids(df, "taxid", nodes, old).collect()} == {(1, 1), (2, 2), (3, None), (4, None)}
    names = spark.createDataFrame([("d__A;p__B b;s__",), (None,)], "l string").select(lineage.name_at_level(F.col("l"), "p").alias("p"), lineage.name_at_level(F.col("l"), "s").alias("s")).collect()
    assert [tuple(r) for r in names] == [("B b", None), (None, None)]
