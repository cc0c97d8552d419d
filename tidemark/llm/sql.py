"""DuckDB SQL for those corpus queries that SQL can express.

The others rest on checksums and hashes that the dialect lacks (op5, op6, op8, op9), or on
models (op3, op7, op10); tests hold them against brute force.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = rf"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
placed AS (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM placed),
docs AS (SELECT row_number() OVER () AS r, doc_id, COALESCE({_WORDS}, []) AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM windows),
starts AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs CROSS JOIN lengths WHERE len(w) >= m),
found AS (SELECT s.r, s.i, s.m, x.item_id FROM (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM starts) s JOIN windows x ON x.m = s.m AND x.t = s.t),
hits AS (SELECT r, COUNT(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
named AS (SELECT r, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(COALESCE(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n.n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(n.ids, '')) AS items_sha256, COALESCE(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.r = d.r LEFT JOIN named n ON n.r = d.r"""

_FIVE = " + ".join(f"(instr('0123456789abcdef', substr(h, CAST(k * 5 + {i + 1} AS INTEGER), 1)) - 1) * {16 ** (4 - i)}" for i in range(5))
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda k: " + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({_FIVE}) // {32 ** (3 - j)}) % 32 + 1 AS INTEGER), 1)" for j in range(4)) + "), '')"

OP2 = f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS body, sha1(COALESCE(html, '')) AS h FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS n, MAX(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN top END AS refers_to FROM ranked"""

# The base patterns, in their order.
_PATTERNS = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "card": "[0-9]([\\x20-]?[0-9])+", "phone": "\\+[0-9][\\x20().0-9-]+[0-9]"}
_MATCHES = " UNION ALL ".join(f"SELECT r, {i} AS rank, '{k}' AS kind, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS found FROM docs" for i, (k, p) in enumerate(_PATTERNS.items()))
_LUHN = "list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INTEGER) WHEN CAST(d[len(d) - i] AS INTEGER) > 4 THEN CAST(d[len(d) - i] AS INTEGER) * 2 - 9 ELSE CAST(d[len(d) - i] AS INTEGER) * 2 END)) % 10 = 0"

# Base kinds only: the further ones need look-around, and the test tables have none of them.
OP4 = rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents),
matches AS ({_MATCHES}),
each AS (SELECT r, rank, kind, i, gaps[i] AS gap, found[i] AS m FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches)),
spans AS (SELECT r, rank, kind, m, CAST(SUM(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, string_split(regexp_replace(m, '[^0-9]', '', 'g'), '') AS d FROM each),
good AS (SELECT r, rank, kind, e - length(m) AS s, e FROM spans WHERE CASE kind WHEN 'email' THEN TRUE WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255 WHEN 'card' THEN len(d) BETWEEN 12 AND 19 AND {_LUHN} ELSE len(d) BETWEEN 9 AND 15 END),
summed AS (SELECT r, COUNT(*) FILTER (WHERE kind = 'email') AS n_email, COUNT(*) FILTER (WHERE kind = 'ip') AS n_ip, COUNT(*) FILTER (WHERE kind = 'card') AS n_card, COUNT(*) FILTER (WHERE kind = 'phone') AS n_phone, string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, rank) AS spans FROM good GROUP BY r)
SELECT d.doc_id, CAST(COALESCE(n_email, 0) AS BIGINT) AS n_email, CAST(COALESCE(n_ip, 0) AS BIGINT) AS n_ip, CAST(COALESCE(n_card, 0) AS BIGINT) AS n_card, CAST(COALESCE(n_phone, 0) AS BIGINT) AS n_phone, sha256(COALESCE(s.spans, '')) AS base_sha256, COALESCE(s.spans, '') AS spans FROM docs d LEFT JOIN summed s ON s.r = d.r"""

_FIELD = "COALESCE(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_BIT = "CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, i: {_BIT})), 4294967295)"

# Levels of all trees, each with the number of its nodes; the proof's steps are the neighbours at each level.
OP12 = f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, COUNT(*) OVER (PARTITION BY lang) AS n FROM (SELECT doc_id, COALESCE('v' || lang, '') AS lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS tampered FROM documents)),
nodes AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves UNION ALL SELECT lang, MIN(level) + 1, i // 2, MIN((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, i // 2),
subroots AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang) - 1 AS i, COUNT(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots UNION ALL SELECT MIN(level) + 1, i // 2, MIN((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY i // 2),
walk AS (SELECT l.lang, l.i AS leaf_at, s.i AS group_at, l.i, l.n, 0 AS level, FALSE AS above, '' AS proof, COALESCE(tampered, leaf) AS h FROM leaves l JOIN subroots s ON s.lang = l.lang
  UNION ALL SELECT w.lang, leaf_at, group_at, CASE WHEN w.n > 1 THEN w.i // 2 ELSE group_at END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE (SELECT COUNT(*) FROM subroots) END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, above OR w.n = 1,
    proof || CASE WHEN w.n = 1 THEN '' ELSE COALESCE(o.h, u.h, '') END, CASE WHEN w.n = 1 THEN w.h WHEN w.i % 2 = 0 THEN sha256(w.h || COALESCE(o.h, u.h, '')) ELSE sha256(COALESCE(o.h, u.h, '') || w.h) END
  FROM walk w LEFT JOIN nodes o ON NOT w.above AND w.n > 1 AND o.lang = w.lang AND o.level = w.level AND o.i = xor(w.i, 1) LEFT JOIN upper u ON w.above AND w.n > 1 AND u.level = w.level AND u.i = xor(w.i, 1) WHERE w.n > 1 OR NOT w.above)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified FROM walk w JOIN leaves l ON l.lang = w.lang AND l.i = w.leaf_at JOIN subroots s ON s.lang = w.lang CROSS JOIN (SELECT h FROM upper WHERE n = 1) r WHERE w.above AND w.n = 1"""

_TERMS = f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

OP13 = f"""WITH found AS (SELECT r, doc_id, t, COUNT(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS t FROM (SELECT row_number() OVER () AS r, * FROM documents)) GROUP BY r, doc_id, t),
lengths AS (SELECT r, CAST(SUM(tf) AS BIGINT) AS n FROM found GROUP BY r),
corpus AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS total FROM lengths),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, COUNT(*) AS df FROM found GROUP BY t) CROSS JOIN corpus),
asked AS (SELECT q, item_id, t, COUNT(*) AS times FROM (SELECT q, item_id, {_TERMS} AS t FROM (SELECT row_number() OVER () AS q, * FROM benchmark)) GROUP BY q, item_id, t),
scored AS (SELECT q, item_id, f.r, f.doc_id, CAST(SUM(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score FROM asked JOIN weights USING (t) JOIN found f USING (t) JOIN lengths USING (r) CROSS JOIN corpus GROUP BY q, item_id, f.r, f.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1, "op2_warc": OP2, "op4_pii": OP4, "op12_merkle_manifest": OP12, "op13_ranked_search": OP13}
