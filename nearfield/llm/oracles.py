"""SQL counterparts of those corpus operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[p : p + n - 1], ' ') AS words
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM n)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS words
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item, s.n, p FROM spots s JOIN windows USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
edges AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS words
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS r FROM edges),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS spot FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS line FROM words ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


_RANKED = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
t AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_DIVERGENCE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
u AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM u GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
l AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM u JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(z.total, 0) + l.v) AS p,
             1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN z ON z.lang = g.lang AND z.source = g.source),
b AS (SELECT a.lang, a.source, o.source AS item, sum(((a.p - o.p) * (a.p - o.p)) // o.p)::BIGINT AS value
      FROM p a JOIN p o ON a.lang = o.lang AND a.term = o.term AND a.source <> o.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, o.source AS item, coalesce(b.value, 0) AS value
          FROM g a JOIN g o ON a.lang = o.lang AND a.source <> o.source LEFT JOIN b ON b.lang = a.lang AND b.source = a.source AND b.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def oracle() -> dict[str, str]:
    return {
        "op4_fm_decontamination": _DECONTAMINATION, "op8_debruijn_repeats": _REPEATS, "op11_pair_maxscore": _RANKED,
        "op13_source_divergence": _DIVERGENCE,
    }
