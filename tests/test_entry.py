import importlib
import os

import pytest

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_named_once():
    e = importlib.import_module("__spark_entry__")
    q, s = e.queries(), e.oracle_sql()
    assert len(q) > 50 and set(s) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["tax_marked", "report_rows", "index_value_counts", "classify_reads", "p2_found", "fasta_round_trip"])
def test_against_sql(spark, name):
    import duckdb

    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = e.queries()[name](spark, SMALL).select(*names)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
