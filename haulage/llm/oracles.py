"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_MATCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_MATCH_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_MATCH_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
       FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       coalesce(it.sha, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') AS sh
  FROM d, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents
          UNION SELECT reach.node, e.y FROM reach JOIN e ON e.x = reach.other)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE)
         / CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0::DOUBLE
                ELSE greatest(0.25::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS DOUBLE)
                              / length(text)) END AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS rate
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, min(CASE WHEN rate * weight <= cap THEN nth END) OVER () AS free FROM r),
u AS (SELECT *, max(CASE WHEN nth = free THEN rate END) OVER () AS common FROM c),
t AS (SELECT source, source_size, CASE WHEN free IS NULL OR nth < free THEN cap ELSE least(cap, common * weight) END AS target FROM u),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
o AS (SELECT d.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before < budget AND 2 * (budget - before) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keeper AS dropped FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, array_to_string(list_transform(range(1, 41), lambda i: substr(
           '0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS b FROM p),
f AS (SELECT hex, min(page_id) AS keeper FROM p GROUP BY hex)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
         + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = f.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.keeper THEN f.keeper END AS refers_to
FROM p JOIN f ON p.hex = f.hex JOIN bits ON bits.page_id = p.page_id"""

OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM d, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS r(i)),
f AS MATERIALIZED (SELECT md5(g) AS k, min(doc_id) AS first FROM g GROUP BY md5(g) HAVING count(DISTINCT doc_id) > 1),
c AS MATERIALIZED (SELECT g.doc_id, g.i FROM g JOIN f ON md5(g.g) = f.k WHERE g.doc_id > f.first),
x AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM c),
y AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
z AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM y GROUP BY doc_id, run),
o AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM z),
k AS (SELECT o.doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last_e,
             string_agg(substr(d.h, 2 * prev + 1, 2 * (s - prev)), '' ORDER BY s) AS kept
      FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.h ELSE k.kept || substr(d.h, 2 * k.last_e + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

# CRC-32 by a table of 256 entries made from its polynomial
OP12 = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || CAST(range(8) AS BIGINT[]),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hits AS (SELECT raw.*, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)]))) % 20 AS hit FROM raw, tab),
rows AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
                CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
         FROM hits, unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS c(copy)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                    left(role, 1) AS ini, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM rows),
f AS MATERIALIZED (
  SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate,
         bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
               coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered)),
stats AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
                 count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                 count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
step(st, turn, nxt) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
d AS (  -- st: 0 nothing yet, 1 system, 2 user, 3 assistant; before every row, and at the end, one turn may be inserted
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit FROM stats
  UNION ALL
  SELECT conv_id, i, st, v.cost, v.audit FROM (
    SELECT x.conv_id, x.i + 1 AS i, e.st AS st, min({'cost': x.cost + e.cost, 'audit': x.audit || e.op}) AS v
    FROM (SELECT d.conv_id, d.i, d.st, d.cost, d.audit FROM d
          UNION ALL SELECT d.conv_id, d.i, step.nxt, d.cost + 5, d.audit || 'I' FROM d JOIN step ON step.st = d.st) x
    JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1
    JOIN step ON step.st = x.st,
    unnest([{'ok': true, 'st': x.st, 'cost': 2, 'op': 'D'},
            {'ok': NOT (f.blank OR f.duplicate), 'st': step.nxt, 'cost': 1 + 5 * CAST(f.truncated AS INTEGER), 'op': 'R'},
            {'ok': NOT (f.blank OR f.duplicate) AND (f.ini = step.turn OR (f.ini = 's' AND x.st = 0)),
             'st': CASE f.ini WHEN 's' THEN 1 ELSE step.nxt END, 'cost': 5 * CAST(f.truncated AS INTEGER), 'op': 'K'}]) AS u(e)
    WHERE e.ok GROUP BY x.conv_id, x.i, e.st)),
ends AS (SELECT d.conv_id, d.st, d.cost, d.audit FROM d JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = s.n),
best AS (SELECT conv_id, min({'cost': cost, 'audit': audit}) AS v FROM (
           SELECT conv_id, st, cost, audit FROM ends UNION ALL SELECT conv_id, nxt, cost + 5, audit || 'I' FROM ends JOIN step USING (st))
         WHERE st IN (0, 3) GROUP BY conv_id),
edits AS (SELECT conv_id, p, substr(v.audit, p, 1) AS op, len(replace(left(v.audit, p), 'I', '')) AS i
          FROM best, unnest(range(1, len(v.audit) + 1)) AS r(p)),
-- the turns that stay, numbered: they alternate behind a system turn
stay AS (SELECT e.*, f.role, f.text, f.ini, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS k,
                first_value(CASE WHEN op = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id ORDER BY p) AS sys
         FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.op <> 'I' WHERE op <> 'D'),
done AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                           || ':' || CASE op WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM stay GROUP BY conv_id)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(coalesce(b.v.cost, 0) AS BIGINT) AS cost,
       coalesce(b.v.audit, '') AS audit, coalesce(done.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _op13() -> str:
    """Rounds of assigning every part to every entry; inner products of integers are exact as doubles."""
    rounds = []
    for r in range(5):
        rounds.append(f"""
a{r} AS MATERIALIZED (
  SELECT id, p, min(struct_pack(d := CAST(x.xx + b.bb - 2 * list_inner_product(x.v, b.v) AS BIGINT), e := b.e)) AS m
  FROM parts x JOIN (SELECT *, list_inner_product(v, v) AS bb FROM b{r}) b USING (p) GROUP BY id, p)""")
        if r < 4:
            rounds.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT p, e, list(w ORDER BY j) AS v FROM (
      SELECT p, a.m.e AS e, j, floor(sum(x.v[j]) / count(*)) AS w
      FROM parts x JOIN a{r} a USING (id, p), unnest(range(1, len(x.v) + 1)) AS u(j) GROUP BY p, a.m.e, j) GROUP BY p, e) n
  USING (p, e))""")
    return f"""
WITH good AS (
  SELECT vec_id, label, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 4 = 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS id, vec_id, label,
         list_transform(x, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x
  FROM (SELECT *, first_value(len(x)) OVER (ORDER BY vec_id NULLS LAST, x) AS w FROM good) WHERE len(x) = w),
parts AS MATERIALIZED (
  SELECT *, list_inner_product(v, v) AS xx FROM (
    SELECT id, p, list_slice(x, CAST(p * len(x) / 4 AS BIGINT) + 1, CAST((p + 1) * len(x) / 4 AS BIGINT)) AS v
    FROM kept, unnest(range(4)) AS r(p))),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM parts WHERE id <= 256),
{",".join(rounds)},
codes AS (SELECT id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY id),
digest AS (SELECT sha256(string_agg(CAST(CAST(v[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS sha
           FROM b4, unnest(range(1, len(v) + 1)) AS u(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM kept JOIN codes USING (id), digest"""


ORACLE = {"op2_suffix_decontamination": OP2, "op4_ngram_jaccard_join": OP4, "op5_source_mix": OP5, "op6_line_dedup": OP6,
          "op9_warc": OP9, "op10_lpf_dedup": OP10, "op12_conversation_repair": OP12, "op13_pivot_codes": _op13()}
