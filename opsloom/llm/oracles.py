"""SQL of the manifest, the conversation repair and the main text, built from their definitions (run by DuckDB in checks)."""
from __future__ import annotations

import zlib

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The CRC-32 of each byte alone, from which its table follows.
_START = 0xFFFFFFFF
_TABLE = [zlib.crc32(bytes([b ^ 0xFF])) ^ _START ^ 0x00FFFFFF for b in range(256)]


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string."""
    step = f"lambda c, b: xor(c >> 8, list_extract({_TABLE}::BIGINT[], (xor(c, b) & 255) + 1))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), {step}, {_START}::BIGINT), {_START}::BIGINT)"


def manifest_sql(levels: int = 8, upper: int = 2, fanout: int = 8) -> str:
    """Trees of up to ``fanout ** levels`` leaves and ``fanout ** upper`` groups, level by level."""
    def enc(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return f"sha256({enc('doc_id')} || {enc('source')} || {enc('lang')} || {enc('n_chars')} || {enc(text)})"

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
 count(*) OVER (PARTITION BY g) AS n FROM (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf,
 CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS claim FROM documents))""",
             "n0 AS (SELECT g, pos, leaf AS h, n FROM d)", "p0 AS (SELECT g, pos, claim AS f, '' AS sib, leaf, doc_id, pos AS k FROM d)"]

    def climb(prefix: str, first: int, count: int):
        for i in range(first, first + count):
            parts.append(f"""{prefix}{i + 1} AS (SELECT g, pos // {fanout} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value((n + {fanout - 1}) // {fanout}) AS n
 FROM {prefix}{i} WHERE n > 1 GROUP BY g, pos // {fanout} UNION ALL SELECT * FROM {prefix}{i} WHERE n = 1)""")

    def prove(nodes: str, first: int, count: int, offset: int):
        for i in range(first, first + count):
            n = f"{nodes}{i - offset}"
            parts.append(f"""p{i + 1} AS (SELECT p.g, p.pos, p.leaf, p.doc_id, p.k // {fanout} AS k, r.f, p.sib || r.s AS sib FROM p{i} p JOIN (
 SELECT p.g, p.pos, CASE WHEN any_value(n.n) = 1 THEN any_value(p.f) ELSE sha256(string_agg(CASE WHEN n.pos = p.k THEN p.f ELSE n.h END, '' ORDER BY n.pos)) END AS f,
 coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> p.k), '') AS s FROM p{i} p JOIN {n} n ON n.g = p.g AND n.pos // {fanout} = p.k // {fanout} GROUP BY p.g, p.pos) r
 ON r.g = p.g AND r.pos = p.pos)""")

    climb("n", 0, levels)
    prove("n", 0, levels, 0)
    parts.append(f"u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS part FROM n{levels})")
    parts.append("v0 AS (SELECT g, pos, h, n FROM u0)")
    climb("v", 0, upper)
    # From here on a node's place is that of its group among the subroots; the rows keep their own keys.
    parts.append(f"q0 AS (SELECT p.g, p.pos, p.leaf, p.doc_id, p.f, p.sib, u.pos AS k FROM p{levels} p JOIN u0 u ON u.part = p.g)")
    for i in range(upper):
        parts.append(f"""q{i + 1} AS (SELECT q.g, q.pos, q.leaf, q.doc_id, q.k // {fanout} AS k, r.f, q.sib || r.s AS sib FROM q{i} q JOIN (
 SELECT q.g, q.pos, CASE WHEN any_value(n.n) = 1 THEN any_value(q.f) ELSE sha256(string_agg(CASE WHEN n.pos = q.k THEN q.f ELSE n.h END, '' ORDER BY n.pos)) END AS f,
 coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> q.k), '') AS s FROM q{i} q JOIN v{i} n ON n.pos // {fanout} = q.k // {fanout} GROUP BY q.g, q.pos) r
 ON r.g = q.g AND r.pos = q.pos)""")
    return "WITH " + ",\n ".join(parts) + f"""
SELECT q.doc_id, q.leaf, n.h AS subroot, v.h AS root, sha256(q.sib) AS proof_sha256, q.f AS folded_root, q.f = v.h AS verified
FROM q{upper} q JOIN n{levels} n ON n.g = q.g, v{upper} v"""


def repair_sql() -> str:
    """Damage, faults and the cheapest edits from the last row of each conversation to its first."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    blanks = r"\x20\x09-\x0D"

    def then(letters, cost, state):
        return f"{{'c': {cost} + {state}.c, 't': '{letters}' || {state}.t}}"

    def edits(state, keeps, to):
        found = [then("D", 4, state), f"CASE WHEN NOT gone THEN {then('R', '3 + x', to)} END"]
        return "least(" + ", ".join(found + [f"CASE WHEN NOT gone AND ini = '{r}' THEN {then('K', 'x', n)} END" for r, n in keeps]) + ")"

    return f"""WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(f"({key})")} % 20 AS kind FROM conversations),
 r AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM b WHERE kind <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, substr(role, 1, 1) AS ini,
   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM r),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{blanks}]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][{blanks}]*\\z') THEN 3 ELSE 0 END AS fault,
   lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS nxt FROM o),
 g AS (SELECT conv_id, i, ini, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN 3 ELSE 0 END AS x FROM f),
 z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
   count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (nxt IS NOT NULL AND ini || nxt NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
 w AS (SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 't': ''}} AS e, {{'c': 6::BIGINT, 't': 'II'}} AS s, {{'c': 3::BIGINT, 't': 'I'}} AS u, {{'c': 0::BIGINT, 't': ''}} AS a FROM z
   UNION ALL SELECT conv_id, i, least(e0, {then('I', 3, 'u0')}, {then('II', 6, 'a0')}), least(s0, {then('I', 3, 'u0')}, {then('II', 6, 'a0')}), least(u0, {then('I', 3, 'a0')}),
     least(a0, {then('I', 3, 'u0')}) FROM (SELECT g.conv_id, g.i, {edits('e', (('s', 's'), ('u', 'u')), 'u')} AS e0, {edits('s', (('u', 'u'),), 'u')} AS s0,
       {edits('u', (('a', 'a'),), 'a')} AS u0, {edits('a', (('u', 'u'),), 'u')} AS a0 FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1)),
 t AS (SELECT conv_id, e.c AS cost, e.t AS audit FROM w WHERE i = 1),
 c AS (SELECT conv_id, unnest(string_split(audit, '')) AS ch, generate_subscripts(string_split(audit, ''), 1) AS j FROM t WHERE audit <> ''),
 p AS (SELECT *, count(*) FILTER (ch <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (ch <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS k FROM c),
 m AS (SELECT p.conv_id, p.ch, p.j, p.k, f.role, f.text, max(CASE WHEN p.k = 1 AND p.ch = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS sys
   FROM p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.ch <> 'I'),
 h AS (SELECT conv_id, sha256(string_agg(CASE ch WHEN 'K' THEN role ELSE CASE WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY j)
   FILTER (ch <> 'D')) AS h FROM m GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
 coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
 LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM d.conv_id"""


def main_text_sql() -> str:
    """The ``article`` element of the given pages, cut at its paragraphs and heading, without tags and with the references that occur there decoded."""
    decoded = "t"
    # The semicolon of these may be missing, as HTML reads them.
    for name, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;?", "''"), ("&#39;?", "''"), ("&amp;?", "&")):
        decoded = f"regexp_replace({decoded}, '{name}', '{char}', 'g')"
    return f"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
 b AS (SELECT page_id, unnest(regexp_split_to_array(h, '</?(?:p|h1)>')) AS t, generate_subscripts(regexp_split_to_array(h, '</?(?:p|h1)>'), 1) AS i FROM a),
 c AS (SELECT page_id, i, regexp_replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g') AS t FROM b),
 d AS (SELECT page_id, i, {decoded} AS t FROM (SELECT page_id, i, trim(t) AS t FROM c) WHERE t <> ''),
 e AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM d GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM a LEFT JOIN e USING (page_id)"""
