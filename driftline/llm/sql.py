"""SQL for another engine that gives the rows of some queries on the shared tables, by plain means."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def similarity_components(size: int, percent: int) -> str:
    """Components of links between documents by word shingles: all pairs that share one, then closure."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x)
SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id FROM r JOIN n ON n.doc_id = r.node GROUP BY ALL"""


def articles() -> str:
    """Text of the ``article`` element of pages of the shared tables' template."""
    block = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
    return rf"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(a, '</?(?:p|h1)[^>]*>'), lambda x: {block}), lambda x: x <> '') AS b FROM a),
t AS (SELECT page_id, url, array_to_string(b, chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""


#: Base patterns of personal data (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_data() -> str:
    """Base spans of documents. The shared tables hold no context that discovers more, so all spans are these."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INT) WHEN CAST({digits}[i] AS INT) > 4 THEN 2 * CAST({digits}[i] AS INT) - 9 ELSE 2 * CAST({digits}[i] AS INT) END)) % 10 = 0"
    checks = {
        "email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || substring(ltrim(p, '0'), 1, 3) AS INT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    parts = [
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(range(1, len(vs) + 1)) AS i, vs, gs FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS vs, string_split_regex(text, '{p}') AS gs FROM d)"""
        for k, (kind, p) in enumerate(PATTERNS.items())
    ]
    good = " OR ".join(f"(kind = '{kind}' AND {check})" for kind, check in checks.items())
    count = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in PATTERNS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, k, kind, vs[i] AS v, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM m),
g AS (SELECT doc_id, k, kind, a, a + length(v) AS b FROM p WHERE {good}),
s AS (SELECT doc_id, {count}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans FROM g GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""
