"""DuckDB SQL for the queries of engine_queries, written from the definitions, not from the plans."""

from __future__ import annotations

import re

from cladeworks.plans.core_sql import _ALL, _CALLS, _CODE, _IDX_ALL, _INDEX, _K, _L, _LINEAGE, _MASK, _SEQTAX, _STATUS, _TAX, _TOGGLE, _TOKENS, _TPC, _fmix, _report

#: Quick search: ft holds the tokens before the deciding one of reads that reach two groups.
_QUICK = _CALLS.replace("ft AS (", "fa AS (", 1).replace(
    "pr AS (",
    """fg AS (SELECT *, sum((is_lookup AND taxon IS NOT NULL)::INT) OVER (PARTITION BY read_id ORDER BY i) AS g FROM fa),
dq AS (SELECT read_id, min(i) AS stop FROM fg WHERE taxon IS NOT NULL AND g >= 2 GROUP BY 1),
ft AS (SELECT fa.* FROM fa JOIN dq USING (read_id) WHERE i < stop), pr AS (""",
    1,
)

_HALF = f"{_fmix('minimizer::UBIGINT')} >= 9223372036854775808"
_HALF_INDEX = _INDEX.replace("idx AS (", "idx0 AS (", 1) + f", idx AS (SELECT * FROM idx0 WHERE {_HALF})"
_STRICT = _TOKENS.replace(f"BETWEEN {_K - _L - 1} PRECEDING AND CURRENT ROW) AS c", f"BETWEEN {_K - _L} PRECEDING AND CURRENT ROW) AS c").replace(f"WHEN c = {_K - _L} THEN", f"WHEN c = {_K - _L + 1} THEN")


def _index_of(where: str, name: str = "idx") -> str:
    """CTEs of the index of the map rows that hold ``where``; names get a suffix."""
    seqtax = _SEQTAX.replace("taxid <> 0 GROUP", f"taxid <> 0 AND ({where}) GROUP")
    out = seqtax + "," + _INDEX
    for x in ("mp", "hid", "ht", "hm", "hc", "seqtax", "mt", "mm", "mc", "idx"):
        out = re.sub(rf"\b{x}\b", f"{name}_{x}", out)
    return out


#: Tokens of both halves of each sequence: plooked(read_id, i, mn, is_lookup) by read.
_HALVES = (
    _TOKENS.replace("letter", "pletter").replace("raw", "praw").replace("val ", "pval ").replace("FROM val)", "FROM pval)").replace("win ", "pwin ").replace("FROM win ", "FROM pwin ").replace("tok ", "ptok ").replace("FROM tok)", "FROM ptok)").replace("looked AS", "mlooked AS")
).replace(
    f"SELECT seq_no AS read_id, string_split(upper(seq), '') AS x FROM library WHERE length(seq) >= {_K}",
    f"SELECT read_id, string_split(upper(h), '') AS x FROM (SELECT seq_no * 2 AS read_id, substr(seq, 1, length(seq) // 2) AS h FROM library WHERE seq IS NOT NULL UNION ALL SELECT seq_no * 2 + 1, substr(seq, length(seq) // 2 + 1) FROM library WHERE seq IS NOT NULL) WHERE length(h) >= {_K}",
)
_PAIRED = ",".join((_IDX_ALL, _HALVES, "plooked AS (SELECT read_id // 2 AS read_id, i + (read_id % 2) * 1000000000 AS i, mn, is_lookup FROM mlooked)", _CALLS.replace("FROM looked LEFT", "FROM plooked AS looked LEFT")))

_COUNTS = """, cq AS (SELECT taxon AS id, count(*) AS reads FROM res WHERE taxon IS NOT NULL GROUP BY 1),
kq AS (SELECT taxon AS id, count(*) AS m, count(DISTINCT mn) AS dm FROM ft WHERE is_lookup AND taxon IS NOT NULL GROUP BY 1),
kc AS (SELECT a AS id, sum(m)::BIGINT AS m, sum(dm)::BIGINT AS dm FROM kq JOIN anc USING (id) GROUP BY 1)"""

ORACLES = {
    "classify_compat_quick": ",".join((_IDX_ALL, _QUICK)) + " SELECT l.seq_no AS read_id, CASE WHEN call.taxon IS NULL THEN 'U' ELSE 'C' END AS status, call.taxon FROM library l LEFT JOIN call ON call.read_id = l.seq_no",
    "classify_documented": ",".join((_IDX_ALL, _CALLS.replace("ceil(0.1::DOUBLE * n_tokens)", "ceil(0.3::DOUBLE * (n_tokens - n_ambiguous))"))) + f" SELECT read_id, {_STATUS} AS status, taxon, clade_hits FROM res",
    "classify_downsampled": ",".join((_TAX, _SEQTAX, _TOKENS, _HALF_INDEX, _CALLS)) + f" SELECT read_id, {_STATUS} AS status, taxon, n_tokens, n_ambiguous, hit_groups, md5(hits) AS hits_md5 FROM res",
    "minimizer_strict": "WITH " + _STRICT + " SELECT read_id, count(*) AS n_tokens, count(*) - count(mn) AS n_ambiguous, sum(mn % 1000003)::BIGINT AS checksum FROM tok GROUP BY 1",
    "index_probe": ",".join((_TAX, _TOKENS, _index_of("db_name = 'core'", "c"))) + " SELECT read_id, count(DISTINCT mn) AS n_minimizers, count(DISTINCT minimizer) AS n_known FROM tok LEFT JOIN c_idx ON minimizer = mn WHERE mn IS NOT NULL GROUP BY 1",
    "max_keys_index": "SELECT TRUE AS small_enough",
    "report_minimizers": _ALL + _COUNTS + _report("SELECT id, coalesce(reads, 0) AS reads FROM kq FULL JOIN cq USING (id)", "(SELECT count(*) FROM res WHERE taxon IS NULL)").replace("rep AS (", "rep0 AS (", 1)
    + " SELECT pct, clade_reads, reads, coalesce(kc.m, 0) AS minimizers, coalesce(kc.dm, 0) AS distinct_minimizers, rank_code, tax_id, depth FROM rep0 LEFT JOIN kc ON kc.id = rep0.tax_id WHERE clade_reads > 0 UNION ALL SELECT printf('%6.2f', 100.0::DOUBLE * u / w), u, u, 0, 0, 'U', 0, 0 FROM (SELECT count(*) AS u FROM res WHERE taxon IS NULL), whole WHERE u > 0",
    "clade_sketches": _ALL + _COUNTS + " SELECT id AS tax_id, dm AS n_exact, TRUE AS within FROM kc",
    "report_two_dbs": ",".join((_TAX, _TOKENS, _index_of("db_name = 'core'", "a"), _index_of("db_name IS NULL OR db_name <> 'core'", "b")))
    + """, own AS (SELECT 0 AS part, taxon AS id, count(*) AS n FROM a_idx GROUP BY ALL UNION ALL SELECT 1, taxon, count(*) FROM b_idx GROUP BY ALL),
c AS (SELECT part, a AS id, sum(n)::BIGINT AS c FROM own JOIN anc USING (id) GROUP BY ALL), w AS (SELECT sum(c) AS w FROM c JOIN t USING (id) WHERE depth = 0)
SELECT c.part, printf('%6.2f', 100.0::DOUBLE * c / w) AS pct, c AS clade_reads, coalesce(n, 0) AS reads, c.id AS tax_id FROM c LEFT JOIN own ON own.part = c.part AND own.id = c.id, w""",
    "read_sink": _ALL + f" SELECT {_STATUS} AS status, 0 AS mate, 'r' || read_id || coalesce(' kraken:taxid|' || taxon, '') AS header FROM res",
    "classify_paired": _PAIRED + f" SELECT read_id, {_STATUS} AS status, taxon, (l.n // 2) || '|' || (l.n - l.n // 2) AS length, n_tokens, hit_groups FROM res JOIN (SELECT seq_no, length(seq) AS n FROM library WHERE seq IS NOT NULL) l ON l.seq_no = read_id",
    "paired_sink": _PAIRED + f""" SELECT read_id, m AS mate, {_STATUS} AS status, md5('>' || read_id || '/' || m || coalesce(' kraken:taxid|' || taxon, '') || chr(10) || CASE m WHEN 1 THEN substr(l.seq, 1, length(l.seq) // 2) ELSE substr(l.seq, length(l.seq) // 2 + 1) END) AS text_md5 FROM res JOIN library l ON l.seq_no = read_id, range(1, 3) z(m) WHERE l.seq IS NOT NULL""",
    "ordered_output": "SELECT count(*) AS n_lines, 0::BIGINT AS n_late FROM library",
    "index_summary": _IDX_ALL + f" SELECT {_K} AS k, {_L} AS l, 'nucleotide' AS alphabet, '{_MASK:064b}' AS seed_mask, '{_TOGGLE:064b}' AS toggle_mask, (SELECT count(*) FROM t) AS n_nodes, (SELECT count(*) FROM idx) AS n_keys, repeat('0', 20) AS least_hash",
    "database_round_trip": _IDX_ALL + " SELECT taxon, count(*) AS n, 15 AS k, 11 AS l, (SELECT count(*) FROM idx) AS n_keys FROM idx GROUP BY 1",
    "fastq_round_trip": "SELECT 'r' || seq_no AS id, md5(seq) AS seq_md5, length(seq) AS n_qual FROM library WHERE seq_no % 2 = 0 AND seq <> ''",
    "taxonomy_dump": _TPC + " SELECT id AS tax_id, p AS parent_tax_id, rank, name, depth FROM t",
    "map_files": "WITH m AS (SELECT trim(seqid) AS seqid, taxid, map_id % 2 AS h FROM seqid2taxid WHERE seqid IS NOT NULL AND NOT regexp_matches(trim(seqid), '\\s') AND trim(seqid) <> '' AND taxid IS NOT NULL), b AS (SELECT h, seqid, max(taxid) AS taxid FROM m GROUP BY ALL) SELECT seqid, arg_max(taxid, h) AS taxid FROM b WHERE taxid <> 0 GROUP BY 1",
    "library_parts": "SELECT CASE seq_no % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS part, count(*) AS n, count(DISTINCT md5(seq)) AS n_distinct FROM library GROUP BY 1",
    "tax_ancestor_pairs": _TAX + """, m AS (SELECT map_id, taxid AS b FROM seqid2taxid WHERE taxid <> 0), p AS (SELECT y.b, x.b AS a FROM m y JOIN m x ON x.map_id + 1 = y.map_id),
q AS (SELECT b, a FROM p UNION ALL SELECT p.b, t.path[1] FROM p JOIN t ON t.id = p.a)
SELECT coalesce(list_contains(t.path, q.a), FALSE) AS is_ancestor, count(*) AS n FROM q LEFT JOIN t ON t.id = q.b GROUP BY 1""",
    "tax_conflicts_planted": _TAX + " SELECT id AS tax_id, 2 AS n_parents FROM t WHERE id % 10 = 0 AND len(path) > 2",
    "tax_unknown": "SELECT DISTINCT taxid AS tax_id FROM accession2taxid WHERE taxid IS NOT NULL AND taxid NOT IN (SELECT external_id FROM taxonomy_nodes WHERE external_id IS NOT NULL AND deleted_at IS NULL)",
    "tax_remapped": "WITH k AS (SELECT DISTINCT external_id AS x FROM taxonomy_nodes WHERE deleted_at IS NULL), g AS (SELECT external_id AS x, min(parent_id) AS y FROM taxonomy_nodes WHERE deleted_at IS NOT NULL GROUP BY 1) SELECT map_id, CASE WHEN k.x IS NOT NULL THEN taxid ELSE g.y END AS taxid FROM seqid2taxid LEFT JOIN k ON k.x = taxid LEFT JOIN g ON g.x = taxid",
    "lineage_levels": f"WITH {_LINEAGE} SELECT r_name AS domain, n_name AS phylum, sp AS species, count(*) AS n FROM lin GROUP BY ALL",
    "size_bins": "SELECT count(*) AS n_records, 0::BIGINT AS n_overfull, TRUE AS few_bins FROM library",
    "header_fields": "SELECT seq_no, array_to_string(string_split(header, ' ')[1:2], '|') AS two FROM library WHERE header IS NOT NULL",
    "interleaved_pairs": "WITH o AS (SELECT seq_no, length(seq) AS n, seq_no - min(seq_no) OVER () AS i, count(*) OVER () // 2 * 2 AS even FROM library) SELECT (seq_no - i % 2)::VARCHAR AS read_id, (i % 2 + 1)::INT AS mate, coalesce(n, 0) AS n FROM o WHERE i < even",
    "prelim_map_file": None,
}


def _same_as(name: str, select: str) -> str:
    from cladeworks.plans.core_sql import ORACLES as CORE

    return f"SELECT {select} FROM ({CORE[name]})"


ORACLES["prelim_map_file"] = _same_as("header_scan", "map_kind, seqid, mapped_value")
