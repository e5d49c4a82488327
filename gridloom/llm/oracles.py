"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

import math

from gridloom.llm.mtree import EVERY, K, SCALE
from gridloom.llm.quality import FAR, KEPT_BITS, METRICS, MIN_GROUP, RATIOS, REACH
from gridloom.llm.urlgraph import BLOCK_SHARE, DAMPING, RULES, TOLERANCE
from gridloom.llm.variants import DROPPED, LEAST_COUNT, LEAST_LETTERS, RATIO

SPACE = r"[\x20\x09-\x0D]"


def _fences(name: str, by: str) -> str:
    keys = by + ", " if by else ""
    part = f"PARTITION BY {keys}metric"
    at = lambda q: f"min(bucket) FILTER (upto * 100 >= {q} * docs)"
    return f"""{name} AS (SELECT {keys}metric, max(docs) AS docs, {at(25)} AS q1, {at(50)} AS q2, {at(75)} AS q3, {at(FAR)} AS top FROM (
  SELECT {keys}metric, bucket, sum(count(*)) OVER ({part} ORDER BY bucket) AS upto, sum(count(*)) OVER ({part}) AS docs FROM k GROUP BY {keys}metric, bucket) GROUP BY {keys}metric)"""


def quality() -> str:
    ratios = ", ".join(f"{scale} * {a} // greatest({b}, 1) AS {k}" for k, (a, scale, b) in RATIOS.items())
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM b WHERE NOT base_failed" for m in METRICS)
    drop = f"greatest(length(bin(v)) - {KEPT_BITS}, 0)::INT"
    fence = {"low": f"q1 - {REACH} * (q3 - q1)", "high": f"q3 + {REACH} * (q3 - q1)", "far": "2 * top - q2"}
    inside = " AND ".join(f"coalesce({m} {'>=' if side == 'low' else '<='} max({fence[side]}) FILTER (metric = '{m}'), true)" for m, sides in METRICS.items() for side in sides)
    pick = lambda c: f"CASE WHEN own.docs >= {MIN_GROUP} THEN own.{c} WHEN l.docs >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END AS {c}"
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS c FROM win) WHERE c > 1) GROUP BY 1),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_word_lines, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {ratios} FROM m),
k AS (SELECT lang, source, metric, (v >> {drop}) << {drop} AS bucket FROM ({rows})),
{_fences("own", "lang, source")}, {_fences("l", "lang")}, {_fences("a", "")},
lim AS (SELECT own.lang AS t_lang, own.source AS t_source, own.metric, {", ".join(map(pick, ("q1", "q2", "q3", "top")))}
  FROM own LEFT JOIN l ON l.lang IS NOT DISTINCT FROM own.lang AND l.metric = own.metric JOIN a ON a.metric = own.metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept FROM b LEFT JOIN lim ON lang IS NOT DISTINCT FROM t_lang AND source IS NOT DISTINCT FROM t_source
GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {", ".join(METRICS)}"""


def embeddings() -> str:
    return """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) >= 0.9 * x.n * y.n),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT r.vec_id, coalesce(max(d.n), 0) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) d ON d.a = r.vec_id GROUP BY r.vec_id"""


def urls() -> str:
    host = lambda u: rf"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in order) + " END"

    # After so many rounds no more than TOLERANCE of the seeds is on its way, whatever the graph.
    rounds = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))

    def ranks(tag: str, seed: str, src: str, dst: str) -> str:
        return f"""{tag}s AS (SELECT {src} AS s, {dst} AS t, n / sum(n) OVER (PARTITION BY {src}) AS share FROM e),
{tag}w AS (SELECT 0 AS i, host, {seed}::DOUBLE AS r FROM h WHERE {seed} > 0 UNION ALL SELECT i + 1, t, sum(share * r * {DAMPING}) FROM {tag}w JOIN {tag}s ON host = s WHERE i < {rounds} GROUP BY 1, 2),
{tag}r AS (SELECT host, sum(r) / sum(sum(r)) OVER () * (SELECT sum({seed}) FROM h) AS r FROM {tag}w GROUP BY 1)"""

    return f"""WITH RECURSIVE p AS (SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM p),
h AS (SELECT host, avg((by_rule IS NOT DISTINCT FROM 'allow')::INT) AS good, avg((by_rule IS NOT DISTINCT FROM 'block')::INT) AS bad FROM q WHERE host <> '' GROUP BY 1),
x AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\b(?:href|src)\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s<>]+)', 1)) AS link FROM p),
y AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM x),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("link")} AS dst FROM y) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
{ranks("g", "good", "src", "dst")}, {ranks("d", "bad", "dst", "src")},
bad AS (SELECT d.host FROM dr d LEFT JOIN gr g ON g.host = d.host WHERE d.r > {BLOCK_SHARE} * (d.r + coalesce(g.r, 0)))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM q"""


def spelling() -> str:
    low = "translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: {step})) AS crc),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM (SELECT doc_id, {low} AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, list_extract(crc, (xor(c, b) & 255) + 1))), 4294967295) AS h FROM r, t),
w AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {LEAST_LETTERS} AND sum(n) >= {LEAST_COUNT}),
p AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w) UNION ALL SELECT word, unnest(range(length(word) + 1)), word FROM w),
e AS (SELECT DISTINCT x.word AS word, y.word AS near FROM p x JOIN p y USING (i, rest) WHERE x.word <> y.word),
f AS (SELECT e.word, count(*) AS n_near, max(w.n) AS m, arg_min(near, (-w.n, near)) AS best FROM e JOIN w ON w.word = near GROUP BY 1),
g AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN best END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
z AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT z.word, z.next, g.form FROM z JOIN g ON g.word = z.next)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN z ON z.word = g.word AND next IS NULL"""


def products() -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality(), "op8_embedding_ego": embeddings(), "op10_url_pagerank": urls(), "op11_spelling_variants": spelling(), "op13_mtree_topk": products()}
