"""The queries that SQL can express, in SQL."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, {_WORDS} AS a FROM documents),
win AS (SELECT doc_id, i, array_to_string(a[i:i + 34], ' ') AS k FROM w, unnest(generate_series(1, len(a) - 34)) AS t(i)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM win WHERE k IN (SELECT k FROM rep)),
words AS (SELECT doc_id, j, a[j] AS word FROM w, unnest(generate_series(1, len(a))) AS t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
SUFFIX_DEDUP = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS k FROM b, unnest(generate_series(1, n - 49)) AS t(i)),
first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM hit),
spans AS (SELECT doc_id, count(*) AS removed, sum(CASE WHEN p IS NULL OR p < j - 1 THEN 1 ELSE 0 END) AS spans FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * j - 1, 2), '' ORDER BY j) AS t FROM (SELECT doc_id, h, j FROM b, unnest(generate_series(1, n)) AS t(j)) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM b LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS s FROM p),
bits AS (SELECT *, array_to_string(list_transform(generate_series(1, 40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(s, i, 1)) - 1) * 4 + 1, 4)), '') AS b FROM d),
e AS (SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT, 1)), '') AS digest,
  min(page_id) OVER (PARTITION BY s) AS low FROM bits)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN low <> page_id THEN low END AS refers_to FROM e"""


def _level(name: str, keys: str, above: str) -> str:
    """A level of the reputation: groups, prior means, strength by moments, posteriors."""
    return f"""{name}_g AS (SELECT {keys}, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY {keys}), {name}_m AS (SELECT g.*, m FROM {name}_g g {above}),
{name}_s AS (SELECT sum(n * (k::DOUBLE / n - m) * (k::DOUBLE / n - m)) AS s, sum(m * (1 - m)) AS v, sum(m * (1 - m) * (n - 1)) AS w FROM {name}_m),
{name}_r AS (SELECT CASE WHEN w > 0 THEN (s - v) / w ELSE 0.0 END AS rho FROM {name}_s), {name}_t AS (SELECT round(coalesce(CASE WHEN rho > 0 THEN greatest(1.0, least(1000.0, 1 / rho - 1)) ELSE 1000.0 END, 1000.0), 6) AS t FROM {name}_r),
{name} AS (SELECT {keys}, k + m * t AS a, n - k + (1 - m) * t AS b FROM {name}_m, {name}_t)"""


_SECOND = "(ac|co|com|edu|go|gob|gov|govt|ltd|ne|net|nom|or|org|plc|sch)"
_ADDRESS = "regexp_matches(bare, '^(\\[.*\\]|[0-9]+(\\.[0-9]+){3})$')"
_DOMAIN = f"CASE WHEN {_ADDRESS} THEN bare WHEN regexp_matches(bare, '(^|\\.){_SECOND}\\.[a-z][a-z]$') THEN regexp_extract(bare, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(bare, '([^.]*\\.)?[^.]*$') END"
_SUFFIX = f"CASE WHEN {_ADDRESS} THEN '(address)' WHEN regexp_matches(bare, '(^|\\.){_SECOND}\\.[a-z][a-z]$') THEN regexp_extract(bare, '[^.]*\\.[^.]*$') ELSE regexp_extract(bare, '[^.]*$') END"
URL_FILTERS = f"""WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
pb AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS bare FROM p),
known AS (SELECT bare, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad FROM labels JOIN pb ON doc_id = page_id WHERE toxic = 1 OR quality = 0 OR (toxic IS NOT NULL AND quality IS NOT NULL)),
hosts AS (SELECT bare AS host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, count(*) AS n, sum(bad) AS k FROM known GROUP BY bare),
corpus AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE AS a, (coalesce(sum(n - k), 0) + 1)::DOUBLE AS b FROM hosts),
{_level('sfx', 'suffix', ', (SELECT a / (a + b) AS m FROM corpus)')},
{_level('dom', 'domain, suffix', 'JOIN (SELECT suffix AS ks, a / (a + b) AS m FROM sfx) ON ks = suffix')},
{_level('hst', 'host, domain', 'JOIN (SELECT domain AS ks, a / (a + b) AS m FROM dom) ON ks = domain')},
h AS (SELECT DISTINCT bare, {_DOMAIN} AS domain, {_SUFFIX} AS suffix FROM pb),
ab AS (SELECT h.bare, coalesce(x.a, y.a, z.a, c.a) AS a, coalesce(x.b, y.b, z.b, c.b) AS b FROM h LEFT JOIN hst x ON h.bare = x.host LEFT JOIN dom y ON h.domain = y.domain LEFT JOIN sfx z ON h.suffix = z.suffix, corpus c),
s AS (SELECT DISTINCT a, b, 0.25 < (a + 1) / (a + b + 2) AS lft FROM ab),
o AS (SELECT a, b, lft, CASE WHEN lft THEN a ELSE b END AS p, CASE WHEN lft THEN b ELSE a END AS q, CASE WHEN lft THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS x FROM s),
cf AS (SELECT a, b, p, q, x, 0 AS m, 1 / (1 - (p + q) * x / (p + 1)) AS h, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * x / (p + 1)) AS d FROM o
  UNION ALL SELECT a, b, p, q, x, m + 1, h * d1 * c1 * d2 * (1 + f2 / c1), 1 + f2 / c1, d2 FROM (SELECT *, 1 / (1 + f2 * d1) AS d2 FROM (SELECT *, 1 / (1 + f1 * d) AS d1, 1 + f1 / c AS c1 FROM
    (SELECT *, (m + 1) * (q - m - 1) * x / ((p + 2 * m + 1) * (p + 2 * m + 2)) AS f1, -(p + m + 1) * (p + q + m + 1) * x / ((p + 2 * m + 2) * (p + 2 * m + 3)) AS f2 FROM cf WHERE m < 200)))),
bt AS (SELECT o.a, o.b, exp(lgamma(o.a + o.b) - lgamma(o.a) - lgamma(o.b) + o.a * ln(0.25) + o.b * ln(0.75)) * cf.h / o.p AS part, lft FROM o JOIN cf ON o.a = cf.a AND o.b = cf.b AND cf.m = 200),
w AS (SELECT a, b, CASE WHEN lft THEN part ELSE 1 - part END AS chance FROM bt),
f AS (SELECT pb.*, chance, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM pb JOIN ab USING (bare) JOIN w ON w.a = ab.a AND w.b = ab.b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN chance <= 0.05 THEN 'block' ELSE 'allow' END AS verdict FROM f"""
