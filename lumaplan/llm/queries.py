"""The queries of this subpackage, and SQL for those that SQL can express."""

from lumaplan.llm.block_max import op13_block_max
from lumaplan.llm.bpe import op11_bpe
from lumaplan.llm.chunk_dedup import op10_chunk_dedup
from lumaplan.llm.decontaminate import op5_decontaminate
from lumaplan.llm.language_id import op8_language_id
from lumaplan.llm.line_winnow import op7_line_winnow
from lumaplan.llm.media_tiff import op2_tiff_pages
from lumaplan.llm.minhash_dart import op4_minhash_dart
from lumaplan.llm.mixing import op6_mixing
from lumaplan.llm.prefix_trie import op12_prefix_trie
from lumaplan.llm.suffix_dedup import op1_suffix_dedup
from lumaplan.llm.token_arrow import op3_token_arrow
from lumaplan.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_tiff_pages, op3_token_arrow, op4_minhash_dart, op5_decontaminate, op6_mixing, op7_line_winnow, op8_language_id, op9_toxicity, op10_chunk_dedup, op11_bpe, op12_prefix_trie, op13_block_max)}

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Every window of 100 bytes, written as hex digits; doc_id is unique in the tables that SQL is run on.
_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN length(h) // 2 - i >= 100 THEN hash(substr(h, 2 * i + 1, 200)) END AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM d)),
f AS (SELECT doc_id, i, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT doc_id, i, b, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 100, false) AS gone FROM f),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

#: All pairs that share a shingle, their weighted Jaccard similarity, and the closure of links.
_OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
node AS (SELECT ws, min(doc_id) AS node, count(*) AS n FROM w GROUP BY ws),
s AS (SELECT node, array_to_string(ws[i : i + 4], ' ') AS s, count(*) AS c FROM (SELECT node, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM node WHERE len(ws) > 0) GROUP BY ALL),
t AS (SELECT node, sum(c) AS t FROM s GROUP BY node),
link AS (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.s = b.s AND a.node <> b.node JOIN t ta ON ta.node = a.node JOIN t tb ON tb.node = b.node GROUP BY a.node, b.node, ta.t, tb.t HAVING sum(least(a.c, b.c)) >= 0.8 * (ta.t + tb.t - sum(least(a.c, b.c)))),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
class AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a),
member AS (SELECT w.doc_id, class_id FROM w JOIN node USING (ws) JOIN class USING (node))
SELECT doc_id, class_id, CAST(count(*) OVER (PARTITION BY class_id) AS BIGINT) AS class_size FROM member
"""

#: Every window of three lines, every line of 50 words, every text of one or two lines.
_OP7 = f"""
WITH l AS (SELECT doc_id, unnest(CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END) AS line, unnest(CASE WHEN coalesce(text, '') = '' THEN [] ELSE range(len(string_split(text, chr(10)))) END) AS i, CASE WHEN len(string_split(text, chr(10))) < 3 THEN text END AS whole FROM documents),
t AS (SELECT *, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, c IS NOT NULL AND row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) > 1 AS again,
 len(regexp_extract_all(line, {_WORD})) >= 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 OR whole IS NOT NULL AND row_number() OVER (PARTITION BY whole, i ORDER BY doc_id) > 1 AS lone FROM t),
g AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) OR lone AS gone FROM f),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM g),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_runs, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256 FROM (SELECT doc_id FROM documents) LEFT JOIN r USING (doc_id)
"""

#: Targets by filling the sources in order of their cap over their weight; then the queue of all copies by finish time.
_OP6 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size, CAST('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
b AS (SELECT CAST(1.5 AS DOUBLE) * CAST(sum(size) AS DOUBLE) AS budget FROM s),
o AS (SELECT *, CAST(2 AS DOUBLE) * size AS cap FROM s WHERE size > 0),
e AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
k AS (SELECT *, (budget - caps) * w / ws >= cap AS full_ FROM e, b),
r AS (SELECT max(budget) - coalesce(sum(cap) FILTER (full_), 0) AS rest, sum(w) FILTER (NOT full_) AS ws FROM k),
t AS (SELECT k.source, CASE WHEN full_ THEN cap ELSE rest * w / r.ws END AS target FROM k, r),
q AS (SELECT doc_id, d.size, s.size AS source_size, coalesce(t.target, 0) AS target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, CAST(words + copy * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) AS v(copy) WHERE target > 0 AND size > 0),
m AS (SELECT doc_id, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) <= budget AS inside FROM c, b),
n AS (SELECT doc_id, count(*) FILTER (inside) AS copies FROM m GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM q LEFT JOIN n USING (doc_id)
"""

#: Nodes are lists of turns; crc32 bit by bit; sums over all ancestors of each node.
_OP12 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
seq AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) AS turns FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: CAST(ascii(c) >> k & 1 AS BIGINT)))) AS bits FROM seq),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bits), lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits),
r AS (SELECT conv_id, list_concat(coalesce(b.turns[1:h], []), own.turns[h + 1:]) AS path FROM h JOIN seq own USING (conv_id) LEFT JOIN seq b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(path) AS size, depth, path[1:depth] AS node FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM r)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends FROM p GROUP BY node, depth),
c AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].t, {_WORD})) END AS saved FROM n LEFT JOIN c USING (node)),
s AS (SELECT node[1:k] AS node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256 FROM v JOIN s USING (node) LEFT JOIN n up ON v.depth > 0 AND up.depth = v.depth - 1 AND up.node = v.node[1:v.depth - 1]
"""

#: Every document that shares a term with an item, scored in full.
_OP13 = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM a WHERE len(ts) > 0),
z AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM a WHERE len(ts) > 0),
p AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM d GROUP BY doc_id, t),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, z WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN p USING (t), z GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": _OP1, "op6_mixing": _OP6, "op4_minhash_dart": _OP4, "op7_line_winnow": _OP7, "op12_prefix_trie": _OP12, "op13_block_max": _OP13}
