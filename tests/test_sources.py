import bz2
import gzip
import lzma
import struct

import pytest

from cladeworks.operators import accessions, lineage
from cladeworks.sources import blastdb
from cladeworks.sources import tables as T
from cladeworks.sources.fastx import read_fastx

FASTQ = "@a one two\nACGT\nAC\n+\n@@@@\nII\n@b\nAC\n+b\n>I\n"


def test_fastq_and_compression(spark, tmp_path):
    for name, opener in (("a.fq", open), ("b.fq.gz", gzip.open), ("c.fq.bz2", bz2.open), ("d.xz", lzma.open)):
        with opener(tmp_path / name, "wt") as f:
            f.write(FASTQ)
    rows = read_fastx(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and {(r.ordinal, r.format, r.id, r.comment, r.seq, r.qual) for r in rows} == {(0, "fastq", "a", "one two", "ACGTAC", "@@@@II"), (1, "fastq", "b", "", "AC", ">I")}


def test_fasta_ranges(spark, tmp_path):
    text = ""
    for i in range(50):
        text += f">s{i} c{i}\n" + "ACGTN" * (i % 7) + "\n" + "GG\n" * (i % 3)
    (tmp_path / "x.fa").write_text(text)
    whole = read_fastx(spark, str(tmp_path / "x.fa")).orderBy("ordinal").collect()
    for size in (7, 64, 333):
        parts = read_fastx(spark, str(tmp_path / "x.fa"), splitBytes=size).orderBy("ordinal").collect()
        assert [(r.id, r.comment, r.seq) for r in parts] == [(r.id, r.comment, r.seq) for r in whole]
    assert len(whole) == 50 and whole[8].seq == "ACGTN" + "GG" * 2


def test_bad_quality(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nACGT\n+\nIII\n@b\nA\n+\nI\n")
    with pytest.raises(Exception, match="qualities"):
        read_fastx(spark, str(tmp_path / "x.fq")).collect()
    assert read_fastx(spark, str(tmp_path / "x.fq"), permissive="true").count() <= 1


def test_dumps_and_maps(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\tx\t|\n2\t|\t1\t|\tspecies\t|\t\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tB\t|\t\t|\tsynonym\t|\n2\t|\tC d\t|\t\t|\tscientific name\t|\n")
    assert [tuple(r) for r in T.read_nodes(spark, str(tmp_path / "nodes.dmp")).collect()] == [(1, None, "no rank"), (2, 1, "species")]
    assert [tuple(r) for r in T.read_names(spark, str(tmp_path / "names.dmp")).collect()] == [(1, "root"), (2, "C d")]
    (tmp_path / "map").write_text("a 5\nb\t0\n\nc  7 \n")
    assert [(r.seqid, r.taxid) for r in T.read_seqid_map(spark, str(tmp_path / "map")).collect()] == [("a", 5), ("c", 7)]
    (tmp_path / "calls").write_text("C\tr1\tX y (taxid 9)\t10\t9:3\nU\tr2\t0\t5\t0:1\n")
    assert [(r.read_id, r.taxon) for r in T.read_calls(spark, str(tmp_path / "calls")).collect()] == [("r1", 9), ("r2", None)]


def _ber(tag, *parts):
    body = b"".join(parts)
    return bytes([tag, 0x80]) + body + b"\0\0" if tag & 0x20 else bytes([tag, len(body)]) + body


def test_blast_volume(spark, tmp_path):
    line = _ber(0x30, _ber(0xA0, _ber(0x1A, b"a title")), _ber(0xA1, _ber(0x30, _ber(0xA5, _ber(0x30, _ber(0xA1, _ber(0x1A, b"NC_1")), _ber(0xA3, _ber(0x02, b"\x02")))))), _ber(0xA2, _ber(0x02, b"\x05")))
    header = _ber(0x30, line, line)
    packed = bytes([0b00011011, 0b11100100, 0b01000001])  # ACGT TGCA C
    amb = struct.pack(">II", 1, (15 << 28) | (1 << 24) | 3)
    wide = struct.pack(">I", (1 << 31) | 2) + struct.pack(">Q", (1 << 60) | (2 << 48) | 0)
    (tmp_path / "v.nhr").write_bytes(header * 3)
    (tmp_path / "v.nsq").write_bytes(packed + packed + amb + packed + wide)
    seqs, ambs = [0, 3, 14, 29], [3, 6, 17, 29]
    text = lambda b: struct.pack(">I", len(b)) + b
    index = struct.pack(">III", 5, 0, 0) + text(b"t") + text(b"l") + text(b"d") + struct.pack(">I", 3) + struct.pack("<Q", 27) + struct.pack(">I", 9)
    index += struct.pack(">4I", *[len(header) * i for i in range(4)]) + struct.pack(">4I", *seqs) + struct.pack(">4I", *ambs)
    (tmp_path / "v.nin").write_bytes(index)
    spark.dataSource.register(blastdb.BlastSource)
    rows = spark.read.format("blastdb").option("taxid", "true").option("rows", 2).load(str(tmp_path / "v")).orderBy("oid").collect()
    assert [r.seq for r in rows] == ["ACGTTGCAC", "ACGNNGCAC", "AAATTGCAC"]
    assert rows[0].header == "kraken:taxid|5|NC_1.2 a title\x01kraken:taxid|5|NC_1.2 a title" and rows[0].taxid == 5
    assert spark.read.format("blastdb").option("split", "true").load(str(tmp_path / "v")).count() == 6


def test_accessions(spark):
    h = spark.createDataFrame([("kraken:taxid|9|NC_1.1 big one\x01NC_2.3  two",), ("77 x",), (None,), ("",)], "header string")
    rows = sorted(tuple(r) for r in accessions.scan_headers(h, "header").collect())
    assert rows == [("ACCNUM", "NC_2.3", "NC_2", "two"), ("TAXID", "77", "77", "x"), ("TAXID", "kraken:taxid|9|NC_1.1", "9", "big one")]
    bad = spark.createDataFrame([("??",)], "header string")
    with pytest.raises(Exception, match="no taxid"):
        accessions.scan_headers(bad, "header").collect()
    assert accessions.scan_headers(bad, "header", lenient=True).count() == 0
    acc = spark.createDataFrame([("A", 1, 5, 2), ("A", 2, 6, 1), ("B", 3, None, 3)], "accession string, taxid bigint, gi bigint, line bigint")
    ids = spark.createDataFrame([("s", "A"), ("t", "A"), ("u", "5"), ("v", "Z")], "seqid string, accession string")
    assert sorted((r.seqid, r.taxid) for r in accessions.map_accessions(ids, acc, also_gi=True).collect()) == [("s", 2), ("t", 2), ("u", 1)]
    assert sorted(r.seqid for r in accessions.unmapped(ids, acc).collect()) == ["u", "v"]


def test_lineages(spark):
    df = spark.createDataFrame([(1, "d__A; p__B; g__C; s__d"), (2, "d__A; p__B; g__"), (3, None), (4, "")], "k int, l string")
    t = lineage.taxonomy_from_lineages(df, "l", binomial=True)
    assert sorted((r.tax_id, r.parent_tax_id, r.rank, r.name) for r in t.collect()) == [(1, 1, "no rank", "root"), (2, 1, "domain", "A"), (3, 2, "phylum", "B"), (4, 3, "genus", "C"), (5, 4, "species", "C d")]
    assert {r.k: r.tax_id for r in lineage.lineage_map(df, "k", "l", t).collect()} == {1: 5, 2: 3, 4: 1}  # no names: the root
    s = spark.createDataFrame([("A;", 2, "domain"), ("A;B;", 3, "phylum")], "path string, tax_id bigint, rank string")
    assert sorted(tuple(r) for r in lineage.ranked_path_taxonomy(s).collect()) == [(2, 1, "superkingdom", "A"), (3, 2, "phylum", "B")]
    with pytest.raises(Exception, match="no parent"):
        lineage.ranked_path_taxonomy(s.where("tax_id = 3")).collect()
    r = spark.createDataFrame([("Root;rootrank;A;domain;",), ("Root;rootrank;B;domain;",)], "l string")
    assert sorted((x.tax_id, x.parent_tax_id, x.rank, x.name) for x in lineage.name_rank_pairs_taxonomy(r, "l").collect()) == [(1, 1, "rootrank", "Root"), (2, 1, "domain", "A"), (3, 1, "domain", "B")]
