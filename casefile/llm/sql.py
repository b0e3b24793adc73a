"""SQL counterparts, for DuckDB, of the queries that SQL can express.

The others (fitted models, suffix arrays, tokenization, spans) are held against
brute-force versions in the tests.
"""

from __future__ import annotations

from casefile.llm.mixing import BUDGET, DIMENSIONS, FILLS, ROUNDS, TEMPER
from casefile.llm.urls import RULES

CHAT = """
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), pieces AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM ordered
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(piece, '' ORDER BY place) AS rendered
  FROM pieces GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, place,
    md5(string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS mark
  FROM pieces
), used AS (
  SELECT p.place, p.mark, max(w.n_turns) AS longest,
    min(CASE WHEN w.n_turns = p.place THEN p.conv_id END) AS smallest
  FROM prefixes p JOIN whole w ON p.conv_id = w.conv_id GROUP BY p.place, p.mark
)
SELECT w.conv_id, CAST(0 AS INTEGER) AS part, w.n_turns, w.rendered
FROM whole w JOIN prefixes p ON p.conv_id = w.conv_id AND p.place = w.n_turns
JOIN used u ON u.place = p.place AND u.mark = p.mark
WHERE u.longest = w.n_turns AND u.smallest = w.conv_id
"""


def _mixing() -> str:
    """Raking with windows over the table of cells, step after step."""
    text = f"""
WITH counted AS (
  SELECT doc_id, source, lang,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
), keyed AS (
  SELECT *, coalesce(source, '') AS s, coalesce(lang, '') AS l,
    CASE WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS t
  FROM counted
), cells AS (
  SELECT s, l, t, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM keyed GROUP BY s, l, t HAVING sum(n_tokens) > 0
)"""
    short = dict(zip(DIMENSIONS, "slt", strict=True))
    for name, key in short.items():
        text += f""", power_{key} AS (
  SELECT {key}, pow(sum(tokens), {TEMPER[name]}) AS power FROM cells GROUP BY {key}
), target_{key} AS (
  SELECT {key}, power / (SELECT sum(power) FROM power_{key}) AS target_{key} FROM power_{key}
)"""
    text += """, step0 AS (
  SELECT c.s, c.l, c.t, c.tokens, target_s, target_l, target_t,
    c.tokens / (SELECT sum(tokens) FROM cells) AS weight
  FROM cells c JOIN target_s a ON a.s = c.s JOIN target_l b ON b.l = c.l JOIN target_t d ON d.t = c.t
)"""
    n = 0
    for _ in range(ROUNDS):
        for key in short.values():
            n += 1
            text += f""", step{n} AS (
  SELECT s, l, t, tokens, target_s, target_l, target_t,
    weight * target_{key} / sum(weight) OVER (PARTITION BY {key}) AS weight
  FROM step{n - 1}
)"""
    text += f""", fill0 AS (SELECT s, l, t, tokens, weight, CAST(0 AS DOUBLE) AS p FROM step{n})"""
    for k in range(1, FILLS + 1):
        text += f""", fill{k} AS (
  SELECT s, l, t, tokens, weight, CASE WHEN p >= 1 THEN 1.0 ELSE least(1.0, weight / tokens * scale) END AS p
  FROM (
    SELECT *, coalesce(greatest(0.0, {BUDGET} * sum(tokens) OVER () - sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN p >= 1 THEN 0.0 ELSE weight END) OVER (), 0), 0) AS scale
    FROM fill{k - 1}
  ) AS scaled
)"""
    text += f"""
SELECT k.doc_id, k.source, k.lang, k.t AS topic, k.n_tokens,
  round(CASE WHEN k.n_tokens > 0 THEN coalesce(f.p, 0.0) ELSE 0.0 END, 6) AS probability,
  CAST(('0x' || substr(md5(coalesce(CAST(k.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0
    < CASE WHEN k.n_tokens > 0 THEN coalesce(f.p, 0.0) ELSE 0.0 END AS sampled
FROM keyed k LEFT JOIN fill{FILLS} f ON f.s = k.s AND f.l = k.l AND f.t = k.t
"""
    return text


def _urls() -> str:
    """The rules by length; no page of these tables names a canonical url or
    redirects, and if one did its host would have to be followed here too."""
    cases = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[2]))

    def case(value) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{value(h, p, v)}'"
            for h, p, v in cases
        )

    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} END AS rule,
  {case(lambda h, p, v: v)} ELSE 'allow' END AS verdict
FROM parts
"""


VECTORS = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), named AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, count(p.b) AS n_links, any_value(n.component_id) AS component_id,
  any_value(n.component_id) = e.vec_id AS kept
FROM embeddings e JOIN named n ON n.a = e.vec_id LEFT JOIN pairs p ON p.a = e.vec_id
GROUP BY e.vec_id
"""

# Every order step by step: masks are strings of failed letters.
AUDIT = """
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS text,
    coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words
  FROM documents
), flagged AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM texts t LEFT JOIN marks m ON m.doc_id = t.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), judged AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails,
    contains(fails, x) AS hit,
    length(translate(fails, before, '')) < length(fails) AS gone
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM summed
"""


def statements() -> dict[str, str]:
    return {
        "op1_chat_snapshots": CHAT,
        "op6_mixing": _mixing(),
        "op7_urls": _urls(),
        "op8_pivots": VECTORS,
        "op11_filter_audit": AUDIT,
    }
