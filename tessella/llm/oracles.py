"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP7 = f"""WITH it AS (SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
 iw AS (SELECT DISTINCT r, item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT *, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT size FROM iw), d AS (SELECT row_number() OVER () AS k, doc_id, {_words("text")} AS w FROM documents),
 dw AS (SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN sizes ON len(w) >= size)),
 m AS (SELECT k, i, size, r, item FROM dw JOIN iw USING (size, win)),
 hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM m) GROUP BY k),
 met AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT k, r, item FROM m) GROUP BY k)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN hit USING (k) LEFT JOIN met USING (k)"""


def _escaped(x: str) -> str:
    """Length of an escaped string: one sign more for every control string."""
    counts = " + ".join(f"len(regexp_extract_all({x}, '{p}'))" for p in (r"<\\*\|", r"<\\*/?s>", r"\[\\*/?INST\]", r"\|\\*>"))
    return f"(length({x}) + {counts})"


def op1(forged: str, budget: int = 1024, history: int = 128, system: int = 128, overhead: int = 4, segment: int = 256) -> str:
    order = "ORDER BY turn NULLS FIRST, role, text"
    part = "PARTITION BY conv_id, seg"
    by = f"{part} ORDER BY kind DESC, turn NULLS FIRST, role, text"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    same = "IS NOT DISTINCT FROM"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{forged}' UNION ALL SELECT -1, 1, 'assistant', '{forged}')),
 b AS (SELECT *, CAST(floor(coalesce(turn, -4611686018427387904) / {segment}) AS BIGINT) AS seg, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^ \\t\\n\\x0B\\f\\r\\p{{L}}\\p{{N}}]')) + {overhead} AS cost, 10 + {_escaped("role")} + {_escaped("text")} AS chars FROM c),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id {order}) AS n FROM b) WHERE n = 1),
 later AS (SELECT DISTINCT b.conv_id, b.seg, f.turn, f.role, f.text, f.cost, f.chars FROM b JOIN f ON b.conv_id {same} f.conv_id WHERE b.seg > f.seg),
 k AS (SELECT conv_id, seg, turn, role, text, cost, chars, 0 AS kind FROM b
 UNION ALL SELECT b.conv_id, b.seg + 1, b.turn, b.role, b.text, b.cost, b.chars, 1 FROM b JOIN f ON b.conv_id {same} f.conv_id WHERE (b.turn % {segment} + {segment}) % {segment} >= {segment} - {min(segment, history // overhead)} AND NOT (f.role = 'system' AND b.turn {same} f.turn AND b.role = f.role AND b.text = f.text)
 UNION ALL SELECT conv_id, seg, turn, CASE WHEN role = 'system' THEN role END, CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN cost ELSE 0 END, chars, CASE WHEN role = 'system' THEN 2 ELSE 3 END FROM later),
 p AS (SELECT *, row_number() OVER ({by}) AS n, sum(CASE WHEN kind <= 1 THEN cost ELSE 0 END) OVER ({by} {upto}) - cost - sum(CASE WHEN kind = 1 THEN cost ELSE 0 END) OVER ({part}) AS start,
 first_value(kind) OVER ({by}) AS kind1, first_value(role) OVER ({by}) AS role1, first_value(cost) OVER ({by}) AS cost1, first_value(chars) OVER ({by}) AS chars1 FROM k),
 h AS (SELECT *, kind1 = 2 OR (kind1 = 0 AND role1 = 'system') AS has FROM p),
 u AS (SELECT *, {budget - history} - CASE WHEN has THEN least(cost1, {system}) ELSE 0 END AS room FROM h),
 g AS (SELECT *, CAST(floor(start / (room * 7 // 8)) AS BIGINT) AS cell FROM u WHERE kind <= 1),
 l AS (SELECT *, floor((start + cost - 1) / (room * 7 // 8)) > cell AND start + cost - min(start) OVER (PARTITION BY conv_id, seg, cell) > room AS alone FROM g),
 w AS (SELECT conv_id, seg, 2 * cell + CASE WHEN alone THEN 2 ELSE 1 END AS win, min(start) AS f, sum(chars) AS chars, any_value(has) AS has, any_value(kind1) AS kind1, any_value(chars1) AS chars1 FROM l WHERE kind = 0 GROUP BY ALL),
 v AS (SELECT *, row_number() OVER ({part} ORDER BY win) AS at FROM w),
 past AS (SELECT v.conv_id, v.seg, v.win, sum(l.chars) AS chars FROM v JOIN l ON l.conv_id {same} v.conv_id AND l.seg = v.seg AND l.start < v.f AND l.start >= v.f - {history} AND NOT (l.has AND l.n = 1) GROUP BY ALL),
 o AS (SELECT v.conv_id, count(*) AS n_windows, sum(v.chars + coalesce(past.chars, 0) + CASE WHEN v.has AND (v.kind1 = 2 OR v.at > 1) THEN v.chars1 ELSE 0 END) AS formatted_chars FROM v LEFT JOIN past ON past.conv_id {same} v.conv_id AND past.seg = v.seg AND past.win = v.win GROUP BY v.conv_id),
 t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS targets FROM c GROUP BY conv_id)
 SELECT t.conv_id, n_turns, turns_sha256, length(targets) AS loss_chars, sha256(targets) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, n_windows FROM t JOIN o ON o.conv_id {same} t.conv_id"""
