"""DuckDB twins of the queries that SQL can express; small tables only, as pairs are joined in full."""

from __future__ import annotations

from sablevec.llm.secrets import ACCESS, ASSIGN, GENERIC, HEX

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    rx = _q(pattern)
    return f"""SELECT rid, '{kind}' kind, {rank} r, s, s + len(x) e, val FROM (
        SELECT rid, m[i] x, v[i] val, (list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0))::BIGINT s
        FROM (SELECT rid, string_split_regex(t, {rx}) g, regexp_extract_all(t, {rx}, 0) m, regexp_extract_all(t, {rx}, {group}) v FROM docs WHERE regexp_matches(t, {rx})), unnest(range(1, len(m) + 1)) AS u(i)) WHERE {keep}"""


SECRETS = f"""WITH docs AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents),
base AS ({_matches("assign", 0, ASSIGN, 2, "len(val) >= 6")} UNION ALL {_matches("access", 1, ACCESS, 0, "true")} UNION ALL {_matches("hex", 2, HEX, 0, "true")}),
wide AS ({_matches("live", 3, GENERIC, 0, "regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]')")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM wide w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
owned AS (SELECT val, count(DISTINCT source) owners, count(DISTINCT source || '/' || doc_id::VARCHAR) repos FROM every JOIN docs USING (rid) GROUP BY val),
found AS (SELECT rid, kind, r, s, kind || ':' || s || ':' || e span, owners <= 2 AND repos <= 20 live FROM every JOIN owned USING (val))
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') n_assign, count(*) FILTER (WHERE kind = 'access') n_access, count(*) FILTER (WHERE kind = 'hex') n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY s, r) FILTER (WHERE kind <> 'live'), '')) base_sha256,
    coalesce(string_agg(span, ',' ORDER BY s, r) FILTER (WHERE kind <> 'live' OR live), '') spans,
    count(*) FILTER (WHERE kind = 'live' AND live) n_live, count(*) FILTER (WHERE NOT live) n_example
FROM docs LEFT JOIN found USING (rid) GROUP BY rid, doc_id"""

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') g FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) n FROM grams GROUP BY doc_id),
links AS (SELECT a.doc_id a, b.doc_id b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) component_id, coalesce(any_value(l.n), 0)::BIGINT n_links
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id LEFT JOIN (SELECT a, count(*) n FROM links GROUP BY a) l ON l.a = w.doc_id GROUP BY w.doc_id, s.n"""

_RX = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
BENCHMARK = f"""WITH words AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({_LOWER}, {_RX}) w FROM documents),
items AS (SELECT row_number() OVER () ir, i, w FROM (SELECT DISTINCT item_id::VARCHAR i, text, regexp_extract_all({_LOWER}, {_RX}) w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
windows AS (SELECT DISTINCT i, array_to_string(w[k:k + 9], ' ') g, least(len(w), 10) n FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0),
places AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') g FROM words, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS u(k)),
hits AS (SELECT DISTINCT rid, k, places.n, i FROM places JOIN windows ON windows.g = places.g AND windows.n = places.n),
covered AS (SELECT rid, count(DISTINCT p) n_hit FROM hits, unnest(range(k, k + n)) AS u(p) GROUP BY rid),
suffixes AS (SELECT ir, o, array_to_string(w[o:o + 9], ' ') g, least(len(w), 10) n FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(o) WHERE len(w) > 0),
diagonals AS (SELECT rid, ir, k - o diagonal, n, k - row_number() OVER (PARTITION BY rid, ir, k - o ORDER BY k) island FROM places JOIN suffixes USING (g, n)),
matches AS (SELECT rid, any_value(n) + count(*) - 1 n_words FROM diagonals GROUP BY rid, ir, diagonal, island),
longest AS (SELECT rid, count(*) n_matches, max(n_words) n_longest FROM matches GROUP BY rid),
named AS (SELECT rid, count(*) n_items, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT rid, i FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
    coalesce(n_matches, 0)::BIGINT n_matches, coalesce(n_longest, 0)::BIGINT n_longest
FROM words LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid) LEFT JOIN longest USING (rid)"""
