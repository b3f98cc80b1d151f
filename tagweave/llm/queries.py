"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tagweave.llm.conversation_repair import op12_conversation_repair
from tagweave.llm.decontaminate import op10_decontaminate
from tagweave.llm.edit_counts import op5_edit_counts
from tagweave.llm.exact_dedup import op9_exact_dedup
from tagweave.llm.hard_negatives import op13_hard_negatives
from tagweave.llm.hmm import op2_hmm_score
from tagweave.llm.jaccard_join import op7_jaccard_join
from tagweave.llm.line_dedup import op3_line_dedup
from tagweave.llm.packing import op8_packing
from tagweave.llm.setsketch_dedup import op11_setsketch_dedup
from tagweave.llm.substring_dedup import op6_substring_dedup
from tagweave.llm.token_files import op4_token_files
from tagweave.llm.toxicity import op1_toxicity


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_hmm_score": op2_hmm_score,
        "op3_line_dedup": op3_line_dedup,
        "op4_token_files": op4_token_files,
        "op5_edit_counts": op5_edit_counts,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_packing": op8_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_setsketch_dedup": op11_setsketch_dedup,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents),
l AS (SELECT doc_id, i, arr[i] AS line FROM (SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i FROM a)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.least AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

OP10 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0), (SELECT DISTINCT n FROM bw) s
       WHERE i + n - 1 <= len(w)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

#: Pairs that can link share one of the rarest shingles of each, as many as may be missing and one more.
OP11 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS k, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, k, hash(w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS x FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, list(DISTINCT x) AS s FROM g WHERE i <= greatest(k - 4, 1) GROUP BY doc_id),
n AS (SELECT w.doc_id, coalesce(s.s, []) AS s, coalesce(len(s.s), 0) AS n FROM w LEFT JOIN s USING (doc_id)),
u AS (SELECT doc_id, n, unnest(s) AS x FROM n),
o AS (SELECT doc_id, x FROM u JOIN (SELECT x, count(*) AS f FROM u GROUP BY x) USING (x)
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY f, x) <= n - (85 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM o a JOIN o b ON a.x = b.x AND a.doc_id < b.doc_id),
p AS (SELECT q.a, q.b, a.n AS n, b.n AS m, len(list_intersect(a.s, b.s)) AS hits FROM q JOIN n a ON a.doc_id = q.a JOIN n b ON b.doc_id = q.b),
l AS (SELECT a, b FROM p WHERE 100 * hits >= 85 * (n + m - hits)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""

#: States of a repair: 0 no turn yet, 1 after system, 2 after user, 3 after assistant. Two inserted turns at most are of use at a place.
OP12 = """
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b
      FROM conversations),
h AS (SELECT k.*, xor(4294967295, list_reduce(b, lambda c, x: xor(t.t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM h WHERE kind <> 0),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS prior FROM d),
r AS (SELECT conv_id, i, turn, role, text, role[1] AS initial, prior, said = '' AS blank, said <> '' AND seen AS duplicate, said = '' OR seen AS gone,
             NOT (said = '' OR seen) AND right(said, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
             count(*) FILTER (WHERE prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations),
ins(q, q1, letters, extra, lines) AS (VALUES (0, 0, '', 0, CAST([] AS VARCHAR[])), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
  (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']), (3, 2, 'I', 3, ['user:']),
  (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])),
act(q1, initial, q2, letter, cost, role) AS (VALUES (0, NULL, 0, 'D', 4, NULL), (1, NULL, 1, 'D', 4, NULL), (2, NULL, 2, 'D', 4, NULL), (3, NULL, 3, 'D', 4, NULL),
  (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL),
  (0, NULL, 2, 'R', 3, 'user'), (1, NULL, 2, 'R', 3, 'user'), (2, NULL, 3, 'R', 3, 'assistant'), (3, NULL, 2, 'R', 3, 'user')),
s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM c
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT s.conv_id, r.i, act.q2 AS q, s.cost + ins.extra + act.cost + CASE WHEN r.truncated AND letter <> 'D' THEN 3 ELSE 0 END AS cost,
           s.audit || ins.letters || act.letter AS audit,
           s.lines || ins.lines || CASE WHEN letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(act.role, r.role) || ':' || r.text] END AS lines,
    FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN ins ON ins.q = s.q
      JOIN act ON act.q1 = ins.q1 AND (act.initial IS NULL OR act.initial = r.initial) AND (letter = 'D' OR NOT r.gone))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
e AS (SELECT s.conv_id, s.cost + ins.extra AS cost, s.audit || ins.letters AS audit, s.lines || ins.lines AS lines
      FROM s LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id JOIN ins ON ins.q = s.q AND ins.q1 IN (0, 3)
      WHERE s.i = coalesce(g.n, 0)
      QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + ins.extra, s.audit || ins.letters) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, e.cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.b, s.score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.ps <= 100 * s.score AND 100 * s.score <= 90 * p.ps)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3, "op9_exact_dedup": OP9, "op10_decontaminate": OP10, "op11_setsketch_dedup": OP11, "op12_conversation_repair": OP12, "op13_hard_negatives": OP13}
