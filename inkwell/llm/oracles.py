"""DuckDB SQL with the same results as the queries that SQL can express.

Each is a brute-force statement of the contract, with none of the operator's
method in it."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win
         FROM (SELECT item, w, n, UNNEST(range(1, len(w) - n + 2)) AS k FROM i)),
runs AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
         FROM (SELECT doc_id, w, n, UNNEST(range(1, len(w) - n + 2)) AS k
               FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT runs.doc_id, runs.k, runs.n, wins.item FROM runs JOIN wins ON runs.win = wins.win AND runs.n = wins.n),
marked AS (SELECT doc_id, CAST(COUNT(DISTINCT p) AS BIGINT) AS n_hit
           FROM (SELECT doc_id, UNNEST(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h
      FROM (SELECT doc_id, b, UNNEST(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
often AS (SELECT h FROM s GROUP BY h HAVING COUNT(*) > 1),
c AS (SELECT doc_id, i AS a, i + 400 AS z FROM s WHERE h IN (SELECT h FROM often)),
edge AS (SELECT *, CASE WHEN a <= lag(z) OVER (PARTITION BY doc_id ORDER BY a) THEN 0 ELSE 1 END AS new FROM c),
runs AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM edge),
gone AS (SELECT doc_id, run, MIN(a) AS a, MAX(z) AS z FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a - 1 AS z FROM gone
         UNION ALL SELECT doc_id, MAX(z), 1000000000000 FROM gone GROUP BY doc_id),
kept AS (SELECT cuts.doc_id, string_agg(CASE WHEN cuts.z >= cuts.a THEN hex(b[cuts.a:cuts.z]) ELSE '' END, '' ORDER BY cuts.a, cuts.z) AS k
         FROM cuts JOIN d ON d.doc_id = cuts.doc_id GROUP BY cuts.doc_id),
n AS (SELECT doc_id, SUM(z - a) AS removed, COUNT(*) AS spans FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN k IS NULL THEN sha256(b) ELSE sha256(unhex(k)) END AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, shared, na.n AS na, nb.n AS nb FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 5 * shared >= 4 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, (SELECT MIN(b) FROM reach WHERE reach.a = d.doc_id) AS class_id,
       least(d.doc_id, coalesce((SELECT MIN(b) FROM l WHERE l.a = d.doc_id AND shared = na AND shared = nb), d.doc_id)) AS set_id,
       (SELECT COUNT(*) FROM l WHERE l.a = d.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

_ESC = r"regexp_replace({}, '[\\<\[]', '..', 'g')"
OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(SUM(9 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM c GROUP BY conv_id"""

# The given pages mark their article as such; references are decoded in an
# order that decodes each once.
OP9 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(?:p|h1|br|ul|li)(?:\s[^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
r AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                                           '&#x27;', chr(39)), '&amp;', '&') AS t FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM r)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM s"""

_BYTES = ("list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), "
          "lambda x: CASE WHEN x = '' THEN -1 ELSE CAST('0x' || x AS BIGINT) END)")


def _shard(n: int) -> str:
    """The shard of the largest uniform: equal weights."""
    u = "CAST('0x' || substr(md5(k || ':' || {i}), 1, 13) AS BIGINT)"
    best = "greatest(" + ", ".join(u.format(i=i) for i in range(n)) + ")"
    return f"CASE {best} " + " ".join(f"WHEN {u.format(i=i)} THEN {i}" for i in range(n)) + " END"


OP7 = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (
       SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
       FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
             CAST(xor(list_reduce([4294967295] || {_BYTES}, lambda c, x:
               CASE WHEN x < 0 THEN c ELSE xor(c >> 8, tab[(xor(c, x) & 255) + 1]) END), 4294967295) AS BIGINT) AS text_crc32
      FROM documents, tab),
s AS (SELECT *, {_shard(8)} AS shard, {_shard(9)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       ROW_NUMBER() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32) - 1 AS slot, grown_shard FROM s"""

ORACLES = {"op2_winnowing": OP2, "op3_lyndon_grouping": OP3, "op4_minhash_forest": OP4, "op5_prefix_rendering": OP5,
           "op7_rendezvous_shards": OP7, "op9_tag_path_ratios": OP9}
