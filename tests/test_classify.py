import random

import pytest
from pyspark.sql import functions as F

from cladeworks.functions.kmers import Scheme
from cladeworks.operators import classify as cl
from cladeworks.operators import index as ix
from cladeworks.operators import merge as mg
from cladeworks.operators import report as rp
from cladeworks.operators import taxonomy as tx

SC = Scheme(k=8, l=6, spaces=0)
PARENT = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4, 7: 4, 8: 3}


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame([(k, p or k, {2: "phylum", 6: "species", 7: "species"}.get(k, "no rank")) for k, p in PARENT.items()], "tax_id bigint, parent_tax_id bigint, rank string")
    names = spark.createDataFrame([(k, f"n{k}") for k in PARENT], "tax_id bigint, name string")
    return tx.build_taxonomy(nodes, names).cache()


def path(t):
    return [] if t is None else path(PARENT[t]) + [t]


def lca(a, b):
    if a is None or b is None:
        return a or b
    both = [x for x in path(a) if x in path(b)]
    return both[-1]


def test_taxonomy_shape(tree):
    rows = {r.tax_id: r for r in tree.collect()}
    assert {k: list(r.path) for k, r in rows.items()} == {k: path(k) for k in PARENT}
    assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1].internal_id)] == [1, 2, 3, 4, 5, 8, 6, 7]
    for a in PARENT:
        for b in PARENT:
            assert (rows[a].pre <= rows[b].pre <= rows[a].post) == (a in path(b))


def test_taxonomy_without_end(spark):
    nodes = spark.createDataFrame([(1, 1, "r"), (2, 3, "r"), (3, 2, "r"), (4, 99, "r"), (5, 4, "r"), (1, 1, "r"), (None, 1, "r")], "tax_id bigint, parent_tax_id bigint, rank string")
    assert [r.tax_id for r in tx.build_taxonomy(nodes).collect()] == [1]
    assert tx.build_taxonomy(nodes.where("false")).count() == 0


def test_lca_group(spark, tree):
    random.seed(3)
    groups = {g: [random.choice(list(PARENT)) for _ in range(random.randint(1, 4))] for g in range(40)}
    df = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g int, taxon bigint")
    got = {r.g: r.taxon for r in tx.lca_by_group(df, ["g"], "taxon", tree).collect()}
    for g, ts in groups.items():
        want = ts[0]
        for t in ts[1:]:
            want = lca(want, t)
        assert got[g] == want


def test_prune_and_api(spark, tree):
    kept = tx.prune(tree, spark.createDataFrame([(6,), (6,), (77,)], "tax_id bigint"))
    assert sorted(r.tax_id for r in kept.collect()) == [1, 2, 4, 6]
    api = tx.Taxonomy(tree)
    ids = spark.createDataFrame([(2,), (8,)], "tax_id bigint")
    assert {r.tax_id: r.n_children for r in api.child_count(ids).collect()} == {2: 2, 8: 0}
    pairs = spark.createDataFrame([(2, 6), (6, 2), (3, 6), (2, None)], "a bigint, b bigint")
    assert sorted((r.a, r.b or 0, r.is_ancestor) for r in api.is_ancestor(pairs, "a", "b").collect()) == [(2, 0, False), (2, 6, True), (3, 6, False), (6, 2, False)]


def _vote(tokens, conf, groups):
    """Token taxa of a read (0 none, None ambiguous) to the call, by direct loops."""
    hits = {}
    for t in tokens:
        if t:
            hits[t] = hits.get(t, 0) + 1
    best, call = 0, None
    for t in hits:
        s = sum(n for x, n in hits.items() if x in path(t))
        if s > best:
            best, call = s, t
        elif s == best:
            call = lca(call, t)
    need = -(-len(tokens) * conf // 1)
    while call and sum(n for t, n in hits.items() if call in path(t)) < need:
        call = PARENT[call]
    return call if groups >= 2 else None


@pytest.fixture(scope="module")
def data(spark, tree):
    random.seed(11)
    seqs = {t: "".join(random.choice("ACGT") for _ in range(60)) for t in (5, 6, 7, 8)}
    seqs[7] = seqs[6][:30] + seqs[7][30:]
    lib = spark.createDataFrame([(t, s) for t, s in seqs.items()], "key bigint, seq string")
    taxa = spark.createDataFrame([(t, t) for t in seqs], "key bigint, taxon bigint")
    index = ix.build_index(lib, taxa, tree, SC).cache()
    reads = [(1, seqs[6]), (2, seqs[6][:25]), (3, seqs[8][:20] + "N" + seqs[5][:20]), (4, ""), (5, None), (6, "ACG"), (7, "N" * 30), (8, seqs[7][20:50] + seqs[5][:12]), (9, "".join(random.choice("ACGT") for _ in range(50)))]
    df = spark.createDataFrame([(i, 0, s) for i, s in reads], "read_id bigint, mate int, seq string")
    return seqs, index, df, dict(reads)


def _index_by_hand(seqs):
    out = {}
    for t, s in seqs.items():
        _, m, amb = SC.tokens([s])
        for x in {int(v) for v, a in zip(m, amb) if not a}:
            out[x] = lca(out[x], t) if x in out else t
    return out


def test_index(data):
    seqs, index, _, _ = data
    assert {r.minimizer: r.taxon for r in index.collect()} == _index_by_hand(seqs)


@pytest.mark.parametrize("conf", [0.0, 0.3, 0.8])
def test_classify_against_loops(data, tree, conf):
    seqs, index, df, reads = data
    known = _index_by_hand(seqs)
    got = {r.read_id: r for r in cl.classify(df, index, tree, SC, confidence=conf).collect()}
    assert set(got) == set(reads)
    for i, s in reads.items():
        _, m, amb = SC.tokens([s or ""])
        taxa = [None if a else known.get(int(x), 0) for x, a in zip(m, amb)]
        last, groups = None, 0
        for x, a, t in zip(m.tolist(), amb, taxa):
            if not a and x != last:
                last = x
                groups += bool(t)
        assert got[i].taxon == _vote(taxa, conf, groups) and got[i].n_tokens == len(taxa) and got[i].hit_groups == groups
        runs = []
        for t in taxa:
            c = "A" if t is None else str(t)
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        text = " ".join(f"{c}:{n}" for c, n in runs) + (" " if runs and runs[-1][0] == "A" else "") if runs else "0:0"
        assert got[i].hits == text and got[i].length == str(len(s or ""))


def test_classify_options(data, tree, spark):
    _, index, df, _ = data
    quick = {r.read_id: r for r in cl.classify(df, index, tree, SC, quick=True).collect()}
    assert quick[1].status == "C" and quick[1].hits.endswith(":Q") and quick[4].status == "U"
    none = cl.classify(df, index.where("false"), tree, SC)
    assert {r.status for r in none.collect()} == {"U"}
    assert cl.classify(df.where("false"), index, tree, SC).count() == 0
    for bad in ({"confidence": 1.5}, {"min_hit_groups": -1}, {"denominator": "x"}):
        with pytest.raises(ValueError):
            cl.classify(df, index, tree, SC, **bad)
    part = ix.build_index(df.select(F.col("read_id").alias("key"), "seq"), spark.createDataFrame([(1, 6)], "key bigint, taxon bigint"), tree, SC, least_hash=1 << 63)
    assert 0 < part.count() < 53


def test_pairs_and_quality(spark, data, tree):
    seqs, index, _, _ = data
    one = spark.createDataFrame([(0, "r/1", seqs[6][:30]), (1, "q/1", "ACGT")], "ordinal bigint, id string, seq string")
    two = spark.createDataFrame([(0, "r/2", seqs[6][30:]), (1, "q/2", None)], "ordinal bigint, id string, seq string")
    calls = {r.read_id: r for r in cl.classify(cl.pair_mates(one, two), index, tree, SC).collect()}
    assert calls["r"].taxon == 6 and " |:| " in calls["r"].hits and calls["r"].length == "30|30" and calls["q"].length == "4|0"
    with pytest.raises(Exception, match="no mate"):
        cl.pair_mates(one, two.where("ordinal = 0")).collect()
    q = spark.createDataFrame([("ACGT", "I!I#"), ("", ""), (None, None), ("AC", None)], "seq string, qual string")
    assert [r.seq for r in cl.mask_quality(q, 10).collect()] == ["AxGx", "", None, "AC"]


def test_merge_against_loops(spark, data, tree):
    seqs, index, df, _ = data
    a = cl.classify(df, index.where("taxon IN (6, 4, 5)"), tree, SC)
    b = cl.classify(df, index.where("taxon NOT IN (6, 5)"), tree, SC)
    x, y = ({r.read_id: r for r in c.collect()} for c in (a, b))

    def expand(text):
        out = []
        for item in text.split():
            c, n = item.split(":")
            out += [c] * int(n)
        return out

    for r in mg.merge(a, b, tree).collect():
        p, q = expand(x[r.read_id].hits), expand(y[r.read_id].hits)
        codes = [c if c == "A" else lca(int(c) or None, int(d) or None) or 0 for c, d in zip(p, q)]
        hits = [None if c == "A" else c for c in codes]
        call = _vote(hits, 0.0, 2)
        either = "C" in (x[r.read_id].status, y[r.read_id].status)
        assert (r.status == "C") == either and r.revote == call and r.taxon == (call if either else None)
        assert expand(r.hits) == [str(c) for c in codes] and r.n_tokens == len(codes)
    assert {r.read_id: r.taxon for r in mg.merge(a, b, tree, policy="first").collect()}[1] == (x[1].taxon or y[1].taxon)
    with pytest.raises(ValueError):
        mg.merge(a, b, tree, policy="best")


def test_report(spark, tree):
    counts = spark.createDataFrame([(6, 3), (7, 3), (8, 1), (2, 1), (99, 5)], "tax_id bigint, reads bigint")
    rows = rp.report(counts, tree, total=16, unclassified=8).orderBy("position").collect()
    assert [(r.tax_id, r.clade_reads, r.reads, r.rank_code) for r in rows] == [(0, 8, 8, "U"), (1, 8, 0, "R"), (2, 7, 1, "P"), (4, 6, 0, "P1"), (6, 3, 3, "S"), (7, 3, 3, "S"), (3, 1, 0, "R1"), (8, 1, 1, "R2")]
    lines = [r.line for r in rp.report_lines(rp.report(counts, tree, total=16)).orderBy("position").collect()]
    assert lines[1] == " 43.75\t7\t1\tP\t2\t  n2"
    assert sorted(r.lineage for r in rp.mpa_report(counts, tree).collect()) == ["p__n2", "p__n2|s__n6", "p__n2|s__n7"]
    assert rp.report(counts, tree, zeros=True).count() == len(PARENT) + 1
    assert rp.report(counts.where("false"), tree).count() == 0


def test_sequence_taxa_last_row_wins(spark, tree):
    lib = spark.createDataFrame([(1, "a x\x01b y"), (2, "b"), (3, "zz"), (4, None)], "key bigint, header string")
    m = spark.createDataFrame([("a", 8, 1), ("a", 6, 2), ("b", 7, 3), ("zz", 0, 4), ("zz", 55, 5)], "seqid string, taxid bigint, line bigint")
    assert {r.key: r.taxon for r in ix.sequence_taxa(lib, m, tree, "key", "header").collect()} == {1: 4, 2: 7}
