"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from itertools import combinations

_MASK = "18446744073709551615::UHUGEINT"


def _mix(x: str) -> str:
    """Murmur3's finaliser on a UBIGINT expression, in nested steps."""

    def shift(e: str) -> str:
        return f"list_transform([{e}], lambda v: xor(v, v >> 33))[1]"

    def times(e: str, c: int) -> str:
        return f"(({e}::UHUGEINT * {c}::UHUGEINT) & {_MASK})::UBIGINT"

    return shift(times(shift(times(shift(x), 0xFF51AFD7ED558CCD)), 0xC4CEB9FE1A85EC53))


def _distinct_counts(k: int = 1024) -> str:
    def source(name: str, ident: str, day: str, dims: list[str]) -> str:
        out = []
        for n in range(len(dims), -1, -1):
            for c in combinations(dims, n):
                cols = ", ".join(d if d in c else f"NULL AS {d}" for d in ("day", "sample_id", "db_name"))
                out.append(f"SELECT '{name}' AS source_table, '{','.join(c) or 'all'}' AS \"grouping\", {cols}, h FROM {name}_h")
        return " UNION ALL ".join(out)

    def hashed(name: str, ident: str, day: str, sample: str) -> str:
        x = f"(CASE WHEN {ident} < 0 THEN {ident}::HUGEINT + 18446744073709551616 ELSE {ident}::HUGEINT END)::UBIGINT"
        return f"{name}_h AS (SELECT CAST({day} AS DATE) AS day, {sample} AS sample_id, db_name, {_mix(x)} AS h FROM {name})"

    rel = 1.96 / (k - 2) ** 0.5
    return f"""
WITH {hashed("minimizer_data", "candidate", "observed_at", "sample_id")}, {hashed("seqid2taxid", "taxid", "mapped_at", "NULL::VARCHAR")},
e AS ({source("minimizer_data", "candidate", "observed_at", ["day", "sample_id", "db_name"])} UNION ALL {source("seqid2taxid", "taxid", "mapped_at", ["day", "db_name"])}),
n AS (SELECT source_table, "grouping", day, sample_id, db_name, count(*) AS n_rows FROM e GROUP BY ALL),
d AS (SELECT DISTINCT source_table, "grouping", day, sample_id, db_name, h FROM e WHERE h IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_table, "grouping", day, sample_id, db_name ORDER BY h) AS i FROM d),
s AS (SELECT source_table, "grouping", day, sample_id, db_name, max(i) AS m, max(h)::DOUBLE AS kth FROM r WHERE i <= {k} GROUP BY ALL),
v AS (SELECT n.*, coalesce(s.m, 0) AS m, {k - 1}.0::DOUBLE * 18446744073709551616.0::DOUBLE / kth AS est
  FROM n LEFT JOIN s ON n.source_table = s.source_table AND n."grouping" = s."grouping" AND n.day IS NOT DISTINCT FROM s.day AND n.sample_id IS NOT DISTINCT FROM s.sample_id AND n.db_name IS NOT DISTINCT FROM s.db_name)
SELECT source_table, "grouping", day, sample_id, db_name, n_rows,
  CASE WHEN m < {k} THEN m ELSE round(est)::BIGINT END AS n_distinct,
  CASE WHEN m < {k} THEN m ELSE round(greatest({k}.0, est * {1.0 - rel!r}::DOUBLE))::BIGINT END AS lower_bound,
  CASE WHEN m < {k} THEN m ELSE round(est * {1.0 + rel!r}::DOUBLE)::BIGINT END AS upper_bound,
  m < {k} AS is_exact FROM v"""


_GAPS = """
WITH long AS (SELECT seq_no, seq, unnest(regexp_extract_all(seq, '[^ACGTacgt]{10,}')) AS g FROM library WHERE length(seq) > 6000),
any_gap AS (SELECT seq_no, regexp_split_to_array(seq, '[^ACGTacgt]{10,}') AS between, regexp_extract_all(seq, '[^ACGTacgt]{10,}') AS gaps FROM library WHERE length(seq) > 6000),
i AS (SELECT seq_no, between, gaps, unnest(range(1, len(gaps) + 1)) AS k FROM any_gap)
SELECT seq_no, (list_sum(list_transform(between[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(gaps[1:k - 1], lambda x: length(x))), 0))::BIGINT AS gap_start, length(gaps[k]) AS gap_len FROM i
UNION ALL SELECT seq_no, -1, 0 FROM any_gap WHERE len(gaps) = 0"""

_WORDS = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 4)) AS i, w FROM d),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + 5], ' ') AS s FROM p),
hot AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 6)) AS pos FROM g JOIN hot USING (doc_id, s))
SELECT doc_id FROM c GROUP BY doc_id, n HAVING count(*) >= 0.25 * n"""

_SPANS = """
WITH w AS (SELECT seq_no, i, substr(s, i + 1, 80) AS w FROM (SELECT seq_no, upper(seq) AS s, unnest(range(0, length(seq) - 79)) AS i FROM library WHERE length(seq) >= 80)),
shared AS (SELECT w FROM w WHERE regexp_full_match(w, '[ACGT]{80}') GROUP BY w HAVING min(seq_no) <> max(seq_no)),
hit AS (SELECT seq_no, i, CASE WHEN i <= lag(i) OVER (PARTITION BY seq_no ORDER BY i) + 80 THEN 0 ELSE 1 END AS new FROM w JOIN shared USING (w)),
isl AS (SELECT seq_no, i, sum(new) OVER (PARTITION BY seq_no ORDER BY i) AS g FROM hit),
spans AS (SELECT seq_no, min(i) AS span_start, max(i) + 80 - min(i) AS span_len FROM isl GROUP BY seq_no, g)"""

_NEAR = """
WITH g AS (
  SELECT DISTINCT 'seq' AS field, seq_no, substr(s, i, 16) AS g FROM (SELECT seq_no, upper(seq) AS s, unnest(range(1, length(seq) - 14)) AS i FROM library WHERE length(seq) >= 16) WHERE regexp_full_match(substr(s, i, 16), '[ACGT]{16}')
  UNION ALL SELECT DISTINCT 'header', seq_no, substr(s, i, 5) FROM (SELECT seq_no, lower(header) AS s, unnest(range(1, length(header) - 3)) AS i FROM library WHERE length(header) >= 5)),
n AS (SELECT field, seq_no, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.field, a.seq_no AS x, b.seq_no AS y, count(*) AS c FROM g a JOIN g b ON a.field = b.field AND a.g = b.g AND a.seq_no < b.seq_no GROUP BY ALL)
SELECT p.field, x AS seq_no_a, y AS seq_no_b FROM p JOIN n a ON a.field = p.field AND a.seq_no = x JOIN n b ON b.field = p.field AND b.seq_no = y WHERE c >= 0.6 * (a.n + b.n - c)"""

_PIECES = """
WITH RECURSIVE t AS (SELECT seq_no, seq, length(seq) AS n, CASE WHEN length(seq) > 6000 THEN regexp_extract_all(seq, '[^ACGTacgt]{10,}') ELSE [] END AS gaps, regexp_split_to_array(seq, '[^ACGTacgt]{10,}') AS between FROM library WHERE seq IS NOT NULL),
g AS (SELECT seq_no, n, list_transform(range(1, len(gaps) + 1), lambda k: list_sum(list_transform(between[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(gaps[1:k - 1], lambda x: length(x))), 0)) AS s,
  list_transform(range(1, len(gaps) + 1), lambda k: list_sum(list_transform(between[1:k], lambda x: length(x))) + list_sum(list_transform(gaps[1:k], lambda x: length(x)))) AS e FROM t),
p AS (
  SELECT seq_no, 0 AS piece_no, 0::BIGINT AS a, 0::BIGINT AS b, '' AS cut, 0::BIGINT AS nxt FROM g
  UNION ALL
  SELECT seq_no, piece_no + 1, a, b, cut, greatest(a + 1, b - 200) FROM (
    SELECT seq_no, piece_no, a, CASE WHEN a + 6000 >= n THEN n WHEN inside THEN a + 6000 WHEN last - 200 > a THEN last ELSE a + 6000 END::BIGINT AS b,
      CASE WHEN a + 6000 >= n THEN 'end' WHEN inside OR last - 200 > a THEN 'natural' ELSE 'hard' END AS cut
    FROM (SELECT p.seq_no, p.piece_no, p.nxt AS a, g.n, len(list_filter(g.s, lambda x: x <= p.nxt + 6000)) > len(list_filter(g.e, lambda x: x <= p.nxt + 6000)) AS inside, list_max(list_filter(g.e, lambda x: x <= p.nxt + 6000)) AS last FROM p JOIN g USING (seq_no) WHERE p.cut <> 'end')))
SELECT p.seq_no, piece_no, a AS piece_start, b AS piece_end, cut, substr(seq, a + 1, b - a) AS piece FROM p JOIN library USING (seq_no) WHERE piece_no > 0"""

_GROUPS = f"""
WITH RECURSIVE near AS ({_NEAR}),
m AS (SELECT 'seq' AS field, seq_no, upper(seq) AS k FROM library WHERE seq IS NOT NULL UNION ALL SELECT 'header', seq_no, lower(header) FROM library WHERE header IS NOT NULL),
c AS (SELECT field, seq_no, min(seq_no) OVER (PARTITION BY field, k) AS c FROM m),
l AS (SELECT DISTINCT n.field, a.c AS u, b.c AS v FROM (SELECT field, seq_no_a AS x, seq_no_b AS y FROM near UNION ALL SELECT field, seq_no_b, seq_no_a FROM near) n JOIN c a ON a.field = n.field AND a.seq_no = x JOIN c b ON b.field = n.field AND b.seq_no = y WHERE a.c <> b.c),
r AS (SELECT field, u, v FROM l UNION SELECT r.field, r.u, l.v FROM r JOIN l ON l.field = r.field AND l.u = r.v),
k AS (SELECT field, u, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT field, u, min(v) AS v FROM r GROUP BY ALL)
SELECT c.field, c.seq_no, c.c AS class_id, least(c.c, coalesce(f.v, c.c)) AS group_id, coalesce(k.n, 0) AS n_links FROM c LEFT JOIN k ON k.field = c.field AND k.u = c.c LEFT JOIN f ON f.field = c.field AND f.u = c.c"""

ORACLES = {
    "p1_distinct_counts": _distinct_counts(),
    "p4_found": _GAPS,
    "p4_pieces": _PIECES,
    "p5_groups": _GROUPS,
    "p5_found": _NEAR,
    "p7_found": _SPANS + " SELECT seq_no, span_start, span_len FROM spans",
    "p7_shares": _SPANS + ", t AS (SELECT seq_no, sum(span_len)::BIGINT AS n, count(*) AS k FROM spans GROUP BY 1) SELECT l.seq_no, coalesce(length(seq), 0) AS n_letters, coalesce(n, 0) AS n_shared, coalesce(k, 0) AS n_spans, round(CASE WHEN length(seq) > 0 THEN coalesce(n, 0) / length(seq) ELSE 0 END, 6) AS shared_share FROM library l LEFT JOIN t ON t.seq_no = l.seq_no",
    "p10_found": _WORDS,
}
