import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeworks.operators import hierarchy as H
from cladeworks.operators import orphans as O
from cladeworks.operators import packed_fields as P


def day(n):
    return datetime(2023, 1 + n // 28, 1 + n % 28)


REF, TGT = "field string, key string, t timestamp, row_id bigint", "field string, key string, born timestamp, died timestamp"


def _orphans(refs, targets):
    return sorted(r[3] for r in refs if r[1] is not None and r[2] is not None and not any(x[0] == r[0] and x[1] == r[1] and x[2] is not None and x[2] <= r[2] and (x[3] is None or x[3] > r[2]) for x in targets))


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_against_loops(spark, seed):
    random.seed(seed)
    keys = [None, "", "a", "b", "c", "d"]
    refs = [(random.choice("xy"), random.choice([*keys, "a", "a", "a", "zz"]), random.choice([None, *[day(random.randrange(100))] * 9]), i) for i in range(400)]
    targets = [(random.choice("xy"), random.choice(keys), random.choice([None, *[day(s := random.randrange(100))] * 9]), random.choice([None, day(min(110, s + random.randrange(30)))])) for _ in range(40)]
    r, t = spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TGT)
    assert sorted(x.row_id for x in O.orphan_references(r, t).collect()) == _orphans(refs, targets)
    counts = O.orphan_counts(r, t).collect()
    assert sum(c.n_orphans for c in counts) == len(_orphans(refs, targets)) and sum(c.n_refs for c in counts) == sum(r[1] is not None and r[2] is not None for r in refs)


def test_orphans_hot_key_and_empty(spark):
    refs = [("x", "hot", day(i % 60), i) for i in range(3000)] + [("x", f"k{i}", day(5), 10_000 + i) for i in range(3000)]
    targets = [("x", "hot", day(10), day(40)), ("x", "hot", day(20), day(50))] + [("x", f"k{i}", day(1), None) for i in range(0, 3000, 2)]
    r, t = spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TGT)
    assert sorted(x.row_id for x in O.orphan_references(r, t).collect()) == [i for i in range(3000) if not 10 <= i % 60 < 50] + [10_000 + i for i in range(1, 3000, 2)]
    assert O.orphan_references(r.where("false"), t).count() == 0
    assert O.orphan_references(r, t.where("false")).count() == 6000


def test_dates_touching_at_a_point(spark):
    r = spark.createDataFrame([("x", "a", day(3), 1), ("x", "a", day(5), 2), ("x", "a", day(7), 3)], REF)
    t = spark.createDataFrame([("x", "a", day(3), day(5)), ("x", "a", day(5), day(7)), ("x", "a", day(9), day(9)), ("x", "a", day(2), day(1))], TGT)
    assert [x.row_id for x in O.orphan_references(r, t).collect()] == [3]


BITS = {("head", "id"): 0.1, ("head", "quoted_id"): 5.4, ("head", "word"): 4.7, ("body", "word"): 0.13, ("body", "id"): 6.0, ("body", "mark"): 7.4, ("body", "mark_id"): 5.8, ("body", "quoted"): 6.0, ("body", "quoted_id"): 9.6, ("body", "half_quote"): 4.9}


@pytest.mark.parametrize("text,ids", [
    ("AB_1.1 x", ["AB_1.1"]), ("AB_1.1 x\x01CD2.3 y", ["AB_1.1", "CD2.3"]), ("AB_1.1 x;;  kraken:taxid|7|CD2.3", ["AB_1.1", "CD2.3"]),
    ('AB_1.1 "see >ZZ9.9 t" || AB_1.1', ["AB_1.1", "AB_1.1"]), ('"AB_1.1 u, v","CD2.3 ""w; XX1.1"""', ["AB_1.1", "CD2.3"]),
    ("AB_1.1 a; b c\tCD2.3 d^AEF4.5 >GH6.7", ["AB_1.1", "CD2.3", "EF4.5", "GH6.7"]), ("words only; more", []), ('AB_1.1 5" long;CD2.3 z', ["AB_1.1", "CD2.3"]),
    (" ;AB_1.1 x;", ["AB_1.1"]), ("AB_1.1 x AB_2.2 y", ["AB_1.1"]), ("", []), ("A" * 5000, []),
])
def test_packed_texts(text, ids):
    _, fields = P.cheapest(text, BITS)
    assert [i for f in fields if (i := P.entry_id(f))] == ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[A-Z]{2}_?[0-9]{3}\.[1-9]", fullmatch=True), st.lists(st.sampled_from(["red", "blue,", "x;", "plasmid"]), max_size=4)), min_size=1, max_size=5), st.sampled_from(["\x01", "^A", "\t", " || ", ";", "; ", " >"]))
def test_packed_round_trip(entries, delimiter):
    text = delimiter.join(" ".join([i, *[w.rstrip(";") for w in words]]) for i, words in entries)
    _, fields = P.cheapest(text, BITS)
    assert [P.entry_id(f) for f in fields] == [i for i, _ in entries]


def test_packed_table(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "AA1.1 x\x01BB2.2 y", 9), (3, "AA1.1 x\x01BB2.2 y", 9), (4, "plain", 9)], "k bigint, header string, entry_pos int")
    rows = sorted((r.k, r.entry_pos, r.entry_id) for r in P.split_packed(df, "k", "header").collect())
    assert rows == [(3, 1, "AA1.1"), (3, 1, "AA1.1"), (3, 2, "BB2.2"), (3, 2, "BB2.2")]
    assert P.split_packed(df.where("false"), "k", "header").count() == 0


EDGES = "id bigint, parent bigint, o bigint, label string"


def _loop(edges):
    """path of each node from its root, or the least id of the cycle it reaches."""
    parent = {}
    for i, p, o, _ in sorted(edges, key=lambda e: e[2], reverse=True):
        if i is not None:
            parent[i] = p
    paths, cycles = {}, {}
    for i in parent:
        way, x = [i], i
        while (p := parent[x]) not in (None, 0, x) and p in parent:
            if p in way:
                cycles[i] = min(way[way.index(p) :])
                break
            way.append(p)
            x = p
        else:
            paths[i] = way[::-1]
    return paths, cycles


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_against_loops(spark, monkeypatch, seed):
    random.seed(seed)
    n = 60
    edges = [(i, random.choice([None, 0, i, i - 1, i - 1, i - 1, random.randint(1, n), 999]), i, "r") for i in range(1, n + 1)]
    edges += [(e[0], e[1], 1000 + e[2], None) for e in edges[:5]] + [(None, 1, 5000, "r")]
    paths, cycles = _loop(edges)
    df = spark.createDataFrame(edges, EDGES)
    assert {r.id: r.cycle_id for r in H.endless_nodes(df, "id", "parent", "o").collect()} == cycles
    rows = {r.id: r for r in H.build_hierarchy(df, "id", "parent", "o", "label").collect()}
    assert set(rows) == set(paths) | set(cycles)
    for i, r in rows.items():
        if i in cycles:
            assert (r.depth, r.root_id, r.pre) == (None, None, None)
            continue
        below = [j for j, p in paths.items() if i in p and j != i]
        assert r.path_ids == ",".join(map(str, paths[i])) and r.depth == len(paths[i]) - 1 and r.root_id == paths[i][0]
        assert r.n_descendants == len(below) and r.path.split("/")[-1] == f"r:{i}"
        inside = [j for j, s in rows.items() if s.root_id == r.root_id and r.pre < s.pre <= r.pre + r.n_descendants]
        assert sorted(inside) == sorted(below)
    pairs = {(a, i, len(p) - 1 - p.index(a)) for i, p in paths.items() for a in p[:-1]}
    tree = H.build_hierarchy(df, "id", "parent", "o")
    got = H.descendants(tree).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
    monkeypatch.setattr(H, "LEVELS", 2)
    assert {(a, i, x) for i, a, x in map(tuple, H.ancestors(tree).collect())} == pairs
    for root in {r.root_id for r in rows.values() if r.root_id}:
        members = [r.pre for r in rows.values() if r.root_id == root]
        assert sorted(members) == list(range(len(members)))


def test_hierarchy_chain_and_empty(spark):
    df = spark.createDataFrame([(i, i - 1, i, None) for i in range(1, 301)], EDGES)
    tree = H.build_hierarchy(df, "id", "parent", "o").cache()
    assert tree.selectExpr("max(depth)", "sum(n_descendants)").first() == (299, 299 * 150)
    assert H.ancestors(tree).where("id = 300").count() == 299
    assert H.descendants(tree, spark.createDataFrame([(290,)], "id bigint")).count() == 10
    assert H.build_hierarchy(df.where("false"), "id", "parent", "o").count() == 0 and H.endless_nodes(df.where("false"), "id", "parent", "o").count() == 0
