"""DuckDB's SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import math

from tarnwick.llm import mixing, quality
from tarnwick.llm.chat import CONTROL

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '{CONTROL}', '\1\2~\3\4', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
 ELSE 24 + length(regexp_replace(role, '{CONTROL}', '\1\2~\3\4', 'g')) END AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS o FROM p GROUP BY h),
d AS (SELECT page_id, o, strlen(p.h) AS n, sha1(p.h) AS x FROM p JOIN m ON p.h = m.h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN o IS NULL OR page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o OR (page_id IS NULL AND o IS NOT NULL) THEN o END AS refers_to FROM d"""

# Ranks as power series: the mass that is k links away from the seeds counts 0.15 * 0.85 ** k; side 1 goes against the links.
URLS = rf"""WITH RECURSIVE p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS good, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS bad FROM r GROUP BY 1),
w AS (SELECT sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM h),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a[\s\x0B][^>]*?href[\s\x0B]*=[\s\x0B]*["'']?((?:https?:)?//[^"''\s\x0B>]+)', 1)) AS link FROM p),
e AS (SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{_UP}', '{_LOW}') AS dst, count(*) AS n FROM l GROUP BY 1, 2 HAVING src <> dst AND src <> '' AND dst <> ''),
g AS (SELECT 0 AS side, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
a AS (SELECT side, dst AS host FROM g UNION SELECT 0, host FROM h UNION SELECT 1, host FROM h),
m AS (SELECT side, src, dst, n / sum(n) OVER (PARTITION BY side, src) AS share FROM g
  UNION ALL SELECT side, host, host, 1.0 FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.side = a.side AND g.src = a.host)),
s AS (SELECT 0 AS side, host, good / (SELECT good FROM w) AS v FROM h WHERE good > 0 UNION ALL SELECT 1, host, bad / (SELECT bad FROM w) FROM h WHERE bad > 0),
x AS (SELECT side, 0 AS k, host, CAST(v AS DOUBLE) AS v FROM s UNION ALL SELECT x.side, x.k + 1, m.dst, sum(x.v * m.share) FROM x JOIN m ON m.side = x.side AND m.src = x.host WHERE x.k < 150 GROUP BY ALL),
y AS (SELECT host, sum(v * pow(0.85, k) * CASE WHEN k < 150 THEN 0.15 ELSE 1 END * (2 * side - 1)) AS excess FROM x GROUP BY 1)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR excess > h.n / (SELECT n FROM w) THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN h USING (host) LEFT JOIN y USING (host)"""


def _quality() -> str:
    parts, lims, outs = [], [], []
    for m, (least, low) in quality.MEASURES.items():
        x = {"symbols": "CASE WHEN n_words > 0 THEN n_symbols / n_words END", "dup_lines": "CASE WHEN n_lines > 1 THEN n_dup_lines / n_lines END", "word_chars": f"CASE WHEN n_words >= {quality.LEAST_WORDS} THEN word_chars / n_words END"}[m]
        parts.append(f"SELECT doc_id, lang, source, '{m}' AS m, {x} AS x FROM b")
        spread = f"{quality.FENCE} * greatest(q3 - q1, {least})"
        lims.append(f"max(q3 + {spread}) FILTER (m = '{m}') AS hi_{m}, max(q1 - {spread}) FILTER (m = '{m}') AS lo_{m}")
        outs.append(f"coalesce({x} > hi_{m}, false)" + (f" OR coalesce({x} < lo_{m}, false)" if low else ""))
    value = f"CASE WHEN bucket = -1073741824 THEN 0.0 ELSE 2 * pow({quality.GAMMA}, bucket) / (1 + {quality.GAMMA}) END"
    return rf"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT k, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1) GROUP BY 1),
b AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN r USING (k)),
x AS ({" UNION ALL ".join(parts)}),
s AS (SELECT lang, source, m, CAST(CASE WHEN x > 1e-9 THEN ceil(ln(x) / {math.log(quality.GAMMA)!r}) ELSE -1073741824 END AS INT) AS bucket, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, m ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, m) AS total, {value} AS v FROM s),
q AS (SELECT lang, source, m, min(v) FILTER (upto >= 0.25 * (total - 1) + 1) AS q1, min(v) FILTER (upto >= 0.75 * (total - 1) + 1) AS q3 FROM c GROUP BY ALL),
l AS (SELECT lang, source, {", ".join(lims)} FROM q GROUP BY ALL),
o AS (SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {" OR ".join(outs)} AS out FROM b LEFT JOIN l USING (lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT out AS kept FROM o"""


JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS g FROM s), f AS (SELECT g FROM u GROUP BY g HAVING count(*) > 1), v AS (SELECT u.* FROM u JOIN f USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM v a JOIN v b USING (g) WHERE a.doc_id > b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), c AS (SELECT doc_id AS node, doc_id AS head FROM n UNION SELECT e.y, c.head FROM c JOIN e ON c.node = e.x)
SELECT n.doc_id, n AS n_shingles, m AS component_id FROM n JOIN (SELECT node, min(head) AS m FROM c GROUP BY 1) ON node = n.doc_id"""


def _mixing(share: float = 1.0, epochs: int = 2, power: float = 0.7, seed: int = 17) -> str:
    ctes, family = [], ""
    for k, name in enumerate(mixing.LEVELS, 1):
        path = ", ".join(mixing.LEVELS[:k])
        within = f"PARTITION BY {family}" if family else ""
        upper = f"JOIN g{k - 1} USING ({family})" if family else ", whole"
        ctes.append(f"""n{k} AS (SELECT {path}, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {epochs} AS cap, pow(CAST(sum(n_tokens) AS DOUBLE), {power}) AS weight FROM d GROUP BY {path}),
a{k} AS (SELECT n{k}.*, budget, CASE WHEN weight > 0 THEN cap / weight END AS r FROM n{k} {upper}),
b{k} AS (SELECT *, coalesce(sum(cap) OVER w, 0.0) AS caps, sum(weight) OVER ({within}) - coalesce(sum(weight) OVER w, 0.0) AS rest FROM a{k} WINDOW w AS ({within} ORDER BY r NULLS FIRST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{k} AS (SELECT *, coalesce(caps + r * rest <= budget, false) AS full_ FROM b{k}),
o{k} AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0.0 END) OVER ({within}) AS spent, sum(CASE WHEN full_ OR weight <= 0 THEN 0.0 ELSE weight END) OVER ({within}) AS open_ FROM f{k}),
g{k} AS (SELECT {path}, CASE WHEN full_ THEN cap WHEN weight > 0 THEN least(cap, CASE WHEN open_ > 0 THEN (budget - spent) * weight / open_ ELSE 0.0 END) ELSE 0.0 END AS budget{", tokens" if k == 3 else ""} FROM o{k})""")
        family = path
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, 'domain' || (instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 3 AS domain,
  CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents), whole AS (SELECT CAST(sum(n_tokens) AS DOUBLE) * {share} AS budget FROM d),
{", ".join(ctes)},
e AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens + 1e-12) AS BIGINT) ELSE 0 END AS whole, budget, tokens FROM g3),
h AS (SELECT d.*, whole, CAST(floor(budget - whole * tokens + 1e-6) AS BIGINT) AS rest, md5('{seed}/' || whole || '/' || doc_id) AS key FROM d JOIN e USING (domain, lang, source)),
i AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key || md5(text) RANGE UNBOUNDED PRECEDING) AS until FROM h)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN until <= rest THEN 1 ELSE 0 END AS INT) AS epochs FROM i"""


FIM = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS h_ FROM t),
c AS (SELECT *, least(h_[1] % (n + 1), h_[2] % (n + 1)) AS a, greatest(h_[1] % (n + 1), h_[2] % (n + 1)) AS b FROM d),
p AS (SELECT *, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 : n], '') AS suf,
 CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h_[3] % 100 >= 90 THEN 'plain' WHEN h_[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

ORACLES = {"op1_chat_format": CHAT, "op5_mixing": _mixing(), "op6_warc": WARC, "op7_url_filter": URLS, "op8_quality_rules": _quality(), "op9_ngram_jaccard": JACCARD, "op11_fill_in_middle": FIM}
