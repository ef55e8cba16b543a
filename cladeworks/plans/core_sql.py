"""DuckDB SQL for the queries of core_queries, written from the definitions, not from the plans."""

from __future__ import annotations

_K, _L, _MASK, _TOGGLE = 15, 11, int("".join("11" if c == "1" else "00" for c in "1111111" + "01" * 2), 2), 0xE37E28C4271B5A2D & ((1 << 22) - 1)

_LETTERS = "CASE rank WHEN 'superkingdom' THEN 'D' WHEN 'domain' THEN 'D' WHEN 'kingdom' THEN 'K' WHEN 'phylum' THEN 'P' WHEN 'class' THEN 'C' WHEN 'order' THEN 'O' WHEN 'family' THEN 'F' WHEN 'genus' THEN 'G' WHEN 'species' THEN 'S' END"

#: Walks a node table n(id, p, rank, name) down: t(id, p, rank, name, depth, path, letter, steps) and anc(id, a, adepth).
_WALK = f"""
t AS (SELECT id, p, rank, name, 0 AS depth, [id] AS path, coalesce({_LETTERS}, 'R') AS letter, 0 AS steps FROM n WHERE p IS NULL
  UNION ALL SELECT n.id, n.p, n.rank, n.name, t.depth + 1, list_append(t.path, n.id), coalesce({_LETTERS.replace("rank", "n.rank", 1)}, t.letter), CASE WHEN {_LETTERS.replace("rank", "n.rank", 1)} IS NULL THEN t.steps + 1 ELSE 0 END FROM t JOIN n ON n.p = t.id),
anc AS (SELECT id, unnest(path) AS a, unnest(range(len(path))) AS adepth FROM t)"""

_TAX = (
    """WITH RECURSIVE n0 AS (SELECT external_id AS id, parent_id AS p, rank_offset, tax_name, row_number() OVER (PARTITION BY external_id ORDER BY node_id) AS rn FROM taxonomy_nodes WHERE external_id IS NOT NULL),
n1 AS (SELECT n0.id, n0.p, coalesce(r.rank_name, 'no rank') AS rank, tax_name AS name FROM n0 LEFT JOIN rank_names r USING (rank_offset) WHERE rn = 1),
n AS (SELECT a.id, CASE WHEN a.p = 0 OR a.p = a.id OR b.id IS NULL THEN NULL ELSE a.p END AS p, a.rank, a.name FROM n1 a LEFT JOIN n1 b ON b.id = a.p),"""
    + _WALK
)

_TPC = (
    """WITH RECURSIVE n AS (SELECT 1 AS id, NULL::BIGINT AS p, 'no rank' AS rank, 'root' AS name
  UNION ALL SELECT r_regionkey + 10, 1, 'domain', r_name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'subfamily', n_name FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'species', c_name FROM customer),"""
    + _WALK
)

_CODE = "letter || CASE WHEN steps > 0 THEN steps::VARCHAR ELSE '' END"


def _report(counts: str, unclassified: str = "0") -> str:
    """CTEs cnt(id, reads) -> rep(pct, clade_reads, reads, rank_code, tax_id, name, depth, path)."""
    return f""", cnt AS ({counts}), clade AS (SELECT anc.a AS id, sum(reads)::BIGINT AS c FROM cnt JOIN anc USING (id) GROUP BY 1),
whole AS (SELECT coalesce(sum(reads), 0) + {unclassified} AS w FROM cnt),
rep AS (SELECT printf('%6.2f', 100.0::DOUBLE * c / w) AS pct, c AS clade_reads, coalesce(reads, 0) AS reads, {_CODE} AS rank_code, t.id AS tax_id, name, depth, path FROM t JOIN clade USING (id) LEFT JOIN cnt USING (id), whole)"""


_ORDERS = "SELECT o_custkey + 1000 AS id, count(*) AS reads FROM orders GROUP BY 1"
_ORDERED = """, keyed AS (SELECT rep.*, (SELECT list([-x.clade_reads, b.internal] ORDER BY a.adepth) FROM anc a JOIN rep x ON x.tax_id = a.a JOIN (SELECT id, row_number() OVER (ORDER BY depth, path) AS internal FROM t) b ON b.id = a.a WHERE a.id = rep.tax_id) AS k FROM rep)"""


def _number(complement: bool) -> str:
    """Code of the letters from a position, or of their reverse complement, by the letters that follow."""
    letter = "(3 - lead(c, {j}) OVER w)" if complement else "lead(c, {j}) OVER w"
    return " + ".join(f"{letter.format(j=j)} * {4 ** (j if complement else _L - 1 - j)}" for j in range(_L))


#: tok(read_id, i, mn): tokens with null for ambiguous ones; looked(read_id, i, mn, is_lookup).
_TOKENS = f"""
letter AS (SELECT read_id, unnest(range(1, len(x) + 1)) AS i, instr('ACGT', unnest(x)) - 1 AS c FROM (SELECT seq_no AS read_id, string_split(upper(seq), '') AS x FROM library WHERE length(seq) >= {_K})),
raw AS (SELECT read_id, i, min(c) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_L - 1} FOLLOWING) AS worst, {_number(False)} AS f, {_number(True)} AS r FROM letter WINDOW w AS (PARTITION BY read_id ORDER BY i)),
val AS (SELECT read_id, i, CASE WHEN worst >= 0 THEN xor((least(f, r)::BIGINT & {_MASK})::BIGINT, {_TOGGLE}::BIGINT) END AS v FROM raw WHERE f IS NOT NULL),
win AS (SELECT read_id, i, min(v) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN {_K - _L} PRECEDING AND CURRENT ROW) AS m, count(v) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN {_K - _L - 1} PRECEDING AND CURRENT ROW) AS c FROM val),
tok AS (SELECT read_id, i, CASE WHEN c = {_K - _L} THEN xor(m, {_TOGGLE}::BIGINT) END AS mn FROM win WHERE i > {_K - _L}),
looked AS (SELECT read_id, i, mn, mn IS NOT NULL AND mn IS DISTINCT FROM lag(mn IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY i) AS is_lookup FROM tok)"""

#: seqtax(seq_no, taxon): lowest common ancestor of the mapped ids of each header.
_SEQTAX = """
mp AS (SELECT trim(seqid) AS seqid, arg_max(taxid, map_id) AS taxid FROM seqid2taxid WHERE seqid IS NOT NULL AND taxid <> 0 GROUP BY 1),
hid AS (SELECT DISTINCT seq_no, unnest(regexp_split_to_array(header, '[\x01\\s]+')) AS seqid FROM library WHERE header IS NOT NULL),
ht AS (SELECT DISTINCT seq_no, t.id FROM hid JOIN mp USING (seqid) JOIN t ON t.id = mp.taxid),
hm AS (SELECT seq_no, count(*) AS m FROM ht GROUP BY 1),
hc AS (SELECT seq_no, a, adepth, count(*) AS c FROM ht JOIN anc USING (id) GROUP BY ALL),
seqtax AS (SELECT hm.seq_no, arg_max(hc.a, hc.adepth) AS taxon FROM hm LEFT JOIN hc ON hc.seq_no = hm.seq_no AND hc.c = hm.m GROUP BY 1)"""

#: idx(minimizer, taxon).
_INDEX = """
mt AS (SELECT DISTINCT mn AS minimizer, t.id FROM tok JOIN seqtax ON seqtax.seq_no = tok.read_id JOIN t ON t.id = seqtax.taxon WHERE mn IS NOT NULL),
mm AS (SELECT minimizer, count(*) AS m FROM mt GROUP BY 1),
mc AS (SELECT minimizer, a, adepth, count(*) AS c FROM mt JOIN anc USING (id) GROUP BY ALL),
idx AS (SELECT mm.minimizer, arg_max(mc.a, mc.adepth) AS taxon FROM mm LEFT JOIN mc ON mc.minimizer = mm.minimizer AND mc.c = mm.m GROUP BY 1)"""

#: res(read_id, status, taxon, length, n_tokens, n_ambiguous, hit_groups, candidate, clade_hits, hits).
_CALLS = """
ft AS (SELECT looked.*, idx.taxon, CASE WHEN mn IS NULL THEN 'A' ELSE coalesce(idx.taxon::VARCHAR, '0') END AS code FROM looked LEFT JOIN idx ON idx.minimizer = looked.mn),
pr AS (SELECT read_id, count(*) AS n_tokens, count(*) FILTER (WHERE mn IS NULL) AS n_ambiguous, count(*) FILTER (WHERE is_lookup AND taxon IS NOT NULL) AS hit_groups FROM ft GROUP BY 1),
h AS (SELECT read_id, taxon, count(*) AS n FROM ft WHERE taxon IS NOT NULL GROUP BY ALL),
sc AS (SELECT x.read_id, x.taxon, sum(y.n) AS s FROM h x JOIN anc ON anc.id = x.taxon JOIN h y ON y.read_id = x.read_id AND y.taxon = anc.a GROUP BY ALL),
be AS (SELECT read_id, taxon FROM (SELECT *, max(s) OVER (PARTITION BY read_id) AS b FROM sc) WHERE s = b),
bn AS (SELECT read_id, count(*) AS m FROM be GROUP BY 1),
ca AS (SELECT be.read_id, anc.a, anc.adepth FROM be JOIN anc ON anc.id = be.taxon JOIN bn ON bn.read_id = be.read_id GROUP BY be.read_id, anc.a, anc.adepth, bn.m HAVING count(*) = bn.m),
cand AS (SELECT read_id, arg_max(a, adepth) AS candidate FROM ca GROUP BY 1),
cl AS (SELECT ca.read_id, ca.a, ca.adepth, sum(h.n) AS n FROM ca JOIN h ON h.read_id = ca.read_id JOIN anc ON anc.id = h.taxon AND anc.a = ca.a GROUP BY ALL),
call AS (SELECT cl.read_id, arg_max(a, adepth) AS taxon, arg_max(n, adepth)::BIGINT AS clade_hits FROM cl JOIN pr USING (read_id) WHERE n >= ceil(0.1::DOUBLE * n_tokens) GROUP BY 1),
rl AS (SELECT read_id, i, code, i - row_number() OVER (PARTITION BY read_id, code ORDER BY i) AS g FROM ft),
ri AS (SELECT read_id, min(i) AS i, code, count(*) AS n FROM rl GROUP BY read_id, code, g),
ht2 AS (SELECT read_id, string_agg(code || ':' || n, ' ' ORDER BY i) || CASE WHEN arg_max(code, i) = 'A' THEN ' ' ELSE '' END AS hits FROM ri GROUP BY 1),
res AS (SELECT l.seq_no AS read_id, CASE WHEN pr.hit_groups >= 2 THEN call.taxon END AS taxon, coalesce(length(l.seq), 0)::VARCHAR AS length, coalesce(pr.n_tokens, 0) AS n_tokens, coalesce(pr.n_ambiguous, 0) AS n_ambiguous, coalesce(pr.hit_groups, 0) AS hit_groups, candidate, clade_hits, coalesce(hits, '0:0') AS hits
  FROM library l LEFT JOIN pr ON pr.read_id = l.seq_no LEFT JOIN cand ON cand.read_id = l.seq_no LEFT JOIN call ON call.read_id = l.seq_no LEFT JOIN ht2 ON ht2.read_id = l.seq_no)"""

_IDX_ALL = ",".join((_TAX, _SEQTAX, _TOKENS, _INDEX))
_ALL = ",".join((_IDX_ALL, _CALLS))
_STATUS = "CASE WHEN taxon IS NULL THEN 'U' ELSE 'C' END"


def _fmix(x: str) -> str:
    def shift(e: str) -> str:
        return f"list_transform([{e}], lambda v: xor(v, v >> 33))[1]"

    def times(e: str, c: int) -> str:
        return f"(({e}::UHUGEINT * {c}::UHUGEINT) & 18446744073709551615::UHUGEINT)::UBIGINT"

    return shift(times(shift(times(shift(x), 0xFF51AFD7ED558CCD)), 0xC4CEB9FE1A85EC53))


def _unsigned(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN {c}::HUGEINT + 18446744073709551616 ELSE {c}::HUGEINT END)::UBIGINT"


_TAXID, _NUM, _ACC = r"(?:^|\|)kraken:taxid\|(\d+)", r"^(\d+)$", r"(?:^|\|)([A-Z]+_?[A-Z0-9]+)(?:\||\b|\.)"


def _kind(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_TAXID}') OR regexp_matches({c}, '{_NUM}') THEN 'TAXID' WHEN regexp_matches({c}, '{_ACC}') THEN 'ACCNUM' END"


def _value(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, '{_TAXID}', 1), ''), nullif(regexp_extract({c}, '{_NUM}', 1), ''), nullif(regexp_extract({c}, '{_ACC}', 1), ''))"


_LINEAGE = "lin AS (SELECT c_custkey, [('d', r_name), ('p', n_name), ('g', c_mktsegment)] AS three, CASE WHEN c_custkey % 2 = 0 THEN 'x' || (c_custkey % 10)::VARCHAR END AS sp, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"

ORACLES = {
    "tax_paths": _TAX + " SELECT id AS tax_id, p AS parent_tax_id, depth, array_to_string(path, ',') AS path FROM t",
    "tax_bfs_ids": _TAX + ", size AS (SELECT a AS id, count(*) AS c FROM anc GROUP BY 1), o AS (SELECT id, row_number() OVER (ORDER BY depth, path) AS internal_id, row_number() OVER (ORDER BY path) AS pre FROM t) SELECT id AS tax_id, internal_id, pre, pre + c - 1 AS post FROM o JOIN size USING (id)",
    "tax_lca_pairs": _TPC + " , pr AS (SELECT id AS a, id + d AS b FROM t, (VALUES (1), (7)) x(d)) SELECT pr.a, pr.b, coalesce(max_by(x.a, x.adepth), pr.a) AS lca FROM pr LEFT JOIN anc y ON y.id = pr.b LEFT JOIN anc x ON x.id = pr.a AND x.a = y.a GROUP BY pr.a, pr.b",
    "tax_lca_groups": _TAX + ", g AS (SELECT DISTINCT seqid, t.id FROM seqid2taxid JOIN t ON t.id = taxid WHERE seqid IS NOT NULL AND taxid <> 0), m AS (SELECT seqid, count(*) AS m FROM g GROUP BY 1), c AS (SELECT seqid, a, adepth, count(*) AS c FROM g JOIN anc USING (id) GROUP BY ALL) SELECT m.seqid, max_by(c.a, c.adepth) AS tax_id FROM m LEFT JOIN c ON c.seqid = m.seqid AND c.c = m.m GROUP BY 1",
    "tax_marked": _TAX + ", used AS (SELECT DISTINCT a AS id FROM anc WHERE id IN (SELECT taxid FROM seqid2taxid) UNION SELECT id FROM t WHERE depth = 0) SELECT id AS tax_id, depth, row_number() OVER (ORDER BY depth, path) AS internal_id FROM t SEMI JOIN used USING (id)",
    "tax_ancestor_test": _TAX + " SELECT path[1] AS a, path IS NOT NULL AS is_ancestor, count(*) AS n FROM seqid2taxid LEFT JOIN t ON t.id = taxid WHERE taxid <> 0 GROUP BY 1, 2",
    "tax_children": _TPC + " SELECT t.id AS tax_id, t.name, count(k.id) AS n_children FROM t LEFT JOIN n k ON k.p = t.id GROUP BY 1, 2",
    "tax_conflicts": "SELECT external_id AS tax_id, count(DISTINCT coalesce(parent_id, 0)) AS n_parents FROM taxonomy_nodes WHERE external_id IS NOT NULL AND tax_release IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(parent_id, 0)) > 1",
    "rank_codes": _TAX + f" SELECT id AS tax_id, {_CODE} AS rank_code FROM t",
    "clade_rollup": _TPC + ", c AS (SELECT o_custkey + 1000 AS id, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT a AS tax_id, sum(orders)::BIGINT AS clade_orders, sum(lines)::BIGINT AS clade_lines FROM c JOIN anc USING (id) GROUP BY 1",
    "report_rows": _TPC + _report(_ORDERS, "17") + " SELECT pct, clade_reads, reads, rank_code, tax_id, name, depth FROM rep UNION ALL SELECT printf('%6.2f', 100.0::DOUBLE * 17 / w), 17, 17, 'U', 0, 'unclassified', 0 FROM whole",
    "report_zero": "SELECT 2 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n_rows, 1 + (SELECT count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)) + (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)) AS n_zero",
    "report_order": _TPC + _report(_ORDERS) + _ORDERED + " SELECT row_number() OVER (ORDER BY k) AS position, tax_id FROM keyed",
    "report_text": _TPC + _report(_ORDERS) + " SELECT concat_ws(chr(9), pct, clade_reads, reads, rank_code, tax_id, repeat('  ', depth) || name) AS line FROM rep",
    "mpa_lines": _TPC + _report(_ORDERS) + " SELECT CASE rep.depth WHEN 1 THEN 'd__' || rep.name ELSE 'd__' || r.name || '|s__' || rep.name END AS lineage, rep.clade_reads FROM rep LEFT JOIN t r ON r.id = rep.path[2] WHERE rep.depth IN (1, 3)",
    "minimizer_tokens": "WITH " + _TOKENS + " SELECT read_id, count(*) AS n_tokens, count(*) - count(mn) AS n_ambiguous, count(DISTINCT mn) AS n_distinct, min(mn) AS least, max(mn) AS most, sum(mn % 1000003)::BIGINT AS checksum, count(*) FILTER (WHERE is_lookup) AS n_lookups FROM looked GROUP BY 1",
    "murmur_hash": f"WITH c AS (SELECT DISTINCT candidate FROM minimizer_data), x AS (SELECT candidate, {_fmix(_unsigned('candidate'))} AS u FROM c) SELECT candidate, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS hash FROM x",
    "downsample": f"WITH c AS (SELECT DISTINCT db_name, candidate FROM minimizer_data WHERE candidate IS NOT NULL), x AS (SELECT db_name, {_fmix(_unsigned('candidate'))} AS u FROM c) SELECT db_name, count(*) AS n FROM x WHERE u >= 13835058055282163712 GROUP BY 1",
    "capacity_estimate": "WITH " + _TOKENS + f", d AS (SELECT DISTINCT mn FROM tok WHERE mn IS NOT NULL), x AS (SELECT {_fmix('mn::UBIGINT')} AS u FROM d), s AS (SELECT count(*) AS sampled FROM x WHERE (u & 1023) < 64) SELECT sampled, (sampled + 1) * 16 AS estimate, ceil(((sampled + 1) * 16 + 8192) / 0.7::DOUBLE)::BIGINT AS capacity FROM s",
    "index_sequence_taxa": ",".join((_TAX, _SEQTAX)) + " SELECT seq_no, taxon FROM seqtax",
    "index_lca": _IDX_ALL + " SELECT minimizer, taxon FROM idx",
    "index_value_counts": _IDX_ALL + " SELECT taxon, count(*) AS n FROM idx GROUP BY 1",
    "inspect_index": _IDX_ALL + _report("SELECT taxon AS id, count(*) AS reads FROM idx GROUP BY 1") + " SELECT pct, clade_reads, reads, rank_code, tax_id, depth FROM rep",
    "classify_reads": _ALL + f" SELECT read_id, {_STATUS} AS status, taxon, length, n_tokens, n_ambiguous, hit_groups, candidate, clade_hits, md5(hits) AS hits_md5 FROM res",
    "classify_quick": _ALL + f", q AS (SELECT read_id, i, taxon, row_number() OVER (PARTITION BY read_id ORDER BY i) AS g FROM ft WHERE is_lookup AND taxon IS NOT NULL), x AS (SELECT l.seq_no AS read_id, q.taxon FROM library l LEFT JOIN q ON q.read_id = l.seq_no AND q.g = 2) SELECT read_id, {_STATUS} AS status, taxon FROM x",
    "classify_report": _ALL + _report("SELECT taxon AS id, count(*) AS reads FROM res WHERE taxon IS NOT NULL GROUP BY 1", "(SELECT count(*) FROM res WHERE taxon IS NULL)") + " SELECT pct, clade_reads, reads, rank_code, tax_id, depth FROM rep UNION ALL SELECT printf('%6.2f', 100.0::DOUBLE * u / w), u, u, 'U', 0, 0 FROM (SELECT count(*) AS u FROM res WHERE taxon IS NULL), whole WHERE u > 0",
    "output_lines": _ALL + f" SELECT read_id, concat_ws(chr(9), {_STATUS}, read_id, coalesce(t.name, 'unclassified') || ' (taxid ' || coalesce(taxon, 0) || ')', length, hits) AS line FROM res LEFT JOIN t ON t.id = taxon",
    "classified_headers": _ALL + " SELECT read_id, read_id::VARCHAR || coalesce(' kraken:taxid|' || taxon, '') AS header FROM res",
    "run_statistics": _ALL + " SELECT count(*) AS n_reads, sum(length::BIGINT)::BIGINT AS n_letters, count(taxon) AS n_classified, round(100.0::DOUBLE * count(taxon) / count(*), 2) AS pct_classified FROM res",
    "kmer_counters": _ALL + ", own AS (SELECT taxon AS id, count(*) AS n, count(DISTINCT mn) AS d FROM ft WHERE is_lookup AND taxon IS NOT NULL GROUP BY 1), up AS (SELECT a AS id, sum(n)::BIGINT AS cn, sum(d)::BIGINT AS cd FROM own JOIN anc USING (id) GROUP BY 1) SELECT up.id AS tax_id, coalesce(n, 0) AS minimizers, coalesce(d, 0) AS distinct_minimizers, cn AS clade_minimizers, cd AS clade_distinct_minimizers FROM up LEFT JOIN own USING (id)",
    "translate_frames": """WITH s AS (SELECT seq_no, coalesce(upper(seq), '') AS s FROM library), r AS (SELECT seq_no, s, reverse(translate(s, 'ACGT', 'TGCA')) AS c FROM s),
f AS (SELECT seq_no, f AS frame, CASE WHEN f < 3 THEN substr(s, f + 1) ELSE substr(c, f - 2) END AS x, length(s) AS n FROM r, range(6) q(f)),
c AS (SELECT seq_no, frame, CASE WHEN n >= 3 THEN length(x) // 3 ELSE 0 END AS n_aa, CASE WHEN length(x) >= 3 THEN list_transform(range(0, length(x) // 3), lambda i: substr(x, i * 3 + 1, 3)) ELSE [] END AS codons FROM f)
SELECT seq_no, frame, n_aa, len(list_filter(codons, lambda z: z IN ('TAA', 'TAG', 'TGA'))) AS n_stop, len(list_filter(codons, lambda z: NOT regexp_full_match(z, '[ACGT]{3}'))) AS n_unknown FROM c""",
    "quality_mask": "SELECT seq_no, len(list_filter(range(length(seq)), lambda i: (i * 7) % 41 < 10 OR substr(seq, (i + 1)::BIGINT, 1) = 'x')) AS n_masked FROM library",
    "header_ids": f"SELECT prelim_id, {_kind('s')} AS kind, {_value('s')} AS value FROM (SELECT prelim_id, trim(seqid) AS s FROM prelim_map WHERE seqid IS NOT NULL)",
    "header_scan": f"WITH e AS (SELECT unnest(string_split(header, chr(1))) AS h FROM library WHERE header IS NOT NULL), i AS (SELECT split_part(regexp_replace(h, '\\s+', ' ', 'g'), ' ', 1) AS seqid, nullif(trim(regexp_replace(h, '^\\S+\\s*', '')), '') AS header_comment FROM e WHERE h <> '') SELECT {_kind('seqid')} AS map_kind, seqid, {_value('seqid')} AS mapped_value, header_comment FROM i WHERE {_kind('seqid')} IS NOT NULL",
    "header_rewrite": "SELECT map_id, 'kraken:taxid|' || taxid || '|' || trim(seqid) AS header, 'GCF_' || lpad(map_id::VARCHAR, 9, '0') || '.2' AS assembly FROM seqid2taxid WHERE taxid <> 0 AND seqid IS NOT NULL",
    "sequence_text": "WITH s AS (SELECT seq_no, translate(translate(seq, 'T', 'U'), 'Uu', 'Tt') AS s FROM library) SELECT seq_no, md5(array_to_string(list_transform(range(0, (length(s) + 69) // 70), lambda i: substr(s, i * 70 + 1, 70)), chr(10))) AS text_md5 FROM s",
    "map_accessions": "WITH a AS (SELECT accession, arg_min(taxid, acc_row) AS taxid FROM accession2taxid WHERE accession IS NOT NULL AND taxid IS NOT NULL GROUP BY 1) SELECT prelim_id AS seqid, trim(mapped_value) AS accession, taxid FROM prelim_map JOIN a ON a.accession = trim(mapped_value) WHERE map_kind = 'ACCNUM'",
    "map_accessions_gi": "WITH r AS (SELECT accession, taxid, gi, acc_row FROM accession2taxid WHERE accession IS NOT NULL AND taxid IS NOT NULL), a AS (SELECT accession, arg_min(taxid, acc_row) AS taxid FROM r GROUP BY 1), g AS (SELECT gi::VARCHAR AS gi, arg_min(taxid, acc_row) AS taxid FROM r WHERE gi <> 0 GROUP BY 1), i AS (SELECT acc_row AS seqid, CASE WHEN acc_row % 2 = 0 THEN gi::VARCHAR ELSE accession END AS accession FROM r) SELECT seqid, i.accession, coalesce(a.taxid, g.taxid) AS taxid FROM i LEFT JOIN a ON a.accession = i.accession LEFT JOIN g ON g.gi = i.accession WHERE coalesce(a.taxid, g.taxid) IS NOT NULL",
    "unmapped_accessions": "SELECT prelim_id AS seqid, trim(mapped_value) AS accession FROM prelim_map WHERE map_kind = 'ACCNUM' AND mapped_value IS NOT NULL AND trim(mapped_value) NOT IN (SELECT accession FROM accession2taxid WHERE accession IS NOT NULL AND taxid IS NOT NULL)",
    "repair_taxids": "WITH k AS (SELECT DISTINCT external_id AS taxid FROM taxonomy_nodes WHERE deleted_at IS NULL AND external_id IS NOT NULL), m AS (SELECT external_id AS taxid, min(parent_id) AS new FROM taxonomy_nodes WHERE deleted_at IS NOT NULL AND parent_id IS NOT NULL GROUP BY 1) SELECT map_id AS seqid, CASE WHEN k.taxid IS NOT NULL THEN s.taxid ELSE new END AS taxid, CASE WHEN k.taxid IS NOT NULL THEN 'kept' WHEN new IS NOT NULL THEN 'remapped' ELSE 'dropped' END AS outcome FROM seqid2taxid s LEFT JOIN k ON k.taxid = s.taxid LEFT JOIN m ON m.taxid = s.taxid WHERE s.taxid <> 0",
    "assembly_filter": "SELECT p_partkey AS taxid, CASE p_size % 3 WHEN 0 THEN 'Complete Genome' ELSE 'CHROMOSOME' END AS level, p_name AS path FROM part WHERE p_size % 3 <> 1 AND p_size % 5 <> 0",
    "lineage_members": f"WITH {_LINEAGE} SELECT CASE WHEN sp IS NULL THEN 'genus' ELSE 'species' END AS rank, count(*) AS n FROM lin GROUP BY 1",
    "lineage_parts": f"WITH {_LINEAGE} SELECT CASE WHEN n_name IN ('FRANCE', 'CHINA', 'BRAZIL') THEN n_name ELSE 'others' END AS part, count(*) AS n FROM lin GROUP BY 1",
    "fasta_round_trip": "SELECT seq_no, 'length ' || length(seq) AS comment, md5(seq) AS seq_md5 FROM library WHERE seq IS NOT NULL",
    "stream_counts": _ALL + " SELECT taxon, count(*) AS reads FROM res GROUP BY 1",
    "index_downsampled": _IDX_ALL + f", x AS (SELECT taxon, {_fmix('minimizer::UBIGINT')} AS u FROM idx) SELECT taxon, count(*) AS n FROM x WHERE u >= 9223372036854775808 GROUP BY 1",
    "lineage_to_tree": f"""WITH {_LINEAGE}, nm AS (SELECT DISTINCT ['d__' || r_name, 'p__' || n_name, 'g__' || c_mktsegment] || CASE WHEN sp IS NULL THEN [] ELSE ['s__' || sp] END AS l FROM lin),
p AS (SELECT DISTINCT k, l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l) + 1)) AS k FROM nm)),
q AS (SELECT k, l, array_to_string(l, ';') AS path, row_number() OVER (ORDER BY k, array_to_string(l, ';')) + 1 AS tax_id FROM p)
SELECT q.tax_id, coalesce(u.tax_id, 1) AS parent_tax_id, CASE q.k WHEN 1 THEN 'domain' WHEN 2 THEN 'phylum' WHEN 3 THEN 'genus' ELSE 'species' END AS rank, CASE WHEN q.k = 4 THEN substr(q.l[3], 4) || ' ' || substr(q.l[4], 4) ELSE substr(q.l[q.k], 4) END AS name FROM q LEFT JOIN q u ON u.k = q.k - 1 AND u.l = q.l[1:q.k - 1]
UNION ALL SELECT 1, 1, 'no rank', 'root'""",
}
