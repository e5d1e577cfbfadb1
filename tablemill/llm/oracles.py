"""SQL for DuckDB with the results of those corpus queries that SQL can express."""

from __future__ import annotations

from collections import Counter

from tablemill.llm import contamination, licences, quality_rules
from tablemill.llm.licence_table import must, templates, terms


def quality_rules_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    bounds = []
    for r in quality_rules.RULES:
        per = r.per or "1"
        if r.least is not None:
            bounds.append(f"{r.over} >= {r.least} * {per}")
        if r.most is not None:
            bounds.append(f"{r.over} <= {r.most} * {per}")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
g AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(lines) AS n_lines
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(bounds)} AS kept FROM m"""


def contamination_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{contamination.UPPER}', '{contamination.LOWER}'), '{contamination.WORD}')"
    size = contamination.WINDOW
    return rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark),
bw AS (SELECT item, least(len(words), {size}) AS size, words, unnest(range(1, len(words) - least(len(words), {size}) + 2)) AS i FROM b WHERE len(words) > 0),
grams AS (SELECT DISTINCT item, list_slice(words, i, i + size - 1) AS g FROM bw),
sizes AS (SELECT DISTINCT len(g) AS size FROM grams),
d AS (SELECT doc_id, {words} AS words FROM documents),
dw AS (SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
hits AS (SELECT doc_id, i, len(g) AS size, item FROM dw JOIN grams ON g = list_slice(words, i, i + dw.size - 1)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {contamination.SHARE} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def licences_sql() -> str:
    quote = lambda w: "NULL" if w is None else f"'{w}'"
    rows = [f"({k}, '{licence}', {quote(must(s))}, '{w}', {n})" for k, (licence, s) in enumerate(templates())
            for w, n in sorted(Counter(terms(s)).items())]
    term, stop = r"[\p{L}\p{N}]+", "chr(1)"
    return rf"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS text, 'corpus/' || regexp_replace(coalesce(source, 'none'), '/', '_', 'g')
  || CASE WHEN doc_id % 100 <> 0 THEN '/' || regexp_replace(coalesce(lang, 'none'), '/', '_', 'g') ELSE '' END
  || CASE WHEN doc_id % 10 <> 0 THEN '/' || CAST(doc_id // 100 AS VARCHAR) ELSE '' END AS dir FROM documents),
tmpl(k, licence, must, term, n) AS (VALUES {', '.join(rows)}),
total AS (SELECT count(*) AS n FROM p),
df AS (SELECT term, count(*) AS d FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM p)
  GROUP BY term),
idf AS (SELECT term, ln((1 + total.n) / (1 + coalesce(d, 0))) + 1 AS v FROM (SELECT DISTINCT term FROM tmpl) t FULL JOIN df USING (term), total),
s AS (SELECT doc_id, j, list_extract(parts, j) AS part FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS j FROM
  (SELECT doc_id, list_concat(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
     string_split(regexp_replace(regexp_replace(text, '\n[^\p{{L}}\p{{N}}]*\n', {stop}, 'g'), '([.!?])[ \t\n]+', '\1' || {stop}, 'g'), {stop})) AS parts FROM p))),
sw AS (SELECT doc_id, j, unnest(regexp_extract_all(lower(part), '{term}')) AS term FROM s),
tf AS (SELECT doc_id, j, term, count(*) * any_value(idf.v) AS x, count(*) AS n FROM sw JOIN idf USING (term) GROUP BY doc_id, j, term),
norm AS (SELECT doc_id, j, sqrt(sum(x * x)) AS norm, sum(n) AS words FROM tf GROUP BY doc_id, j),
tn AS (SELECT k, licence, sqrt(sum(n * v * n * v)) AS norm FROM tmpl JOIN idf USING (term) GROUP BY k, licence),
dots AS (SELECT doc_id, j, k, sum(x * tmpl.n * v) AS dot FROM tf JOIN tmpl USING (term) JOIN idf USING (term) GROUP BY doc_id, j, k
  HAVING bool_or(must IS NULL OR must = term)),
scored AS (SELECT doc_id, licence, words, round(dot / norm.norm / tn.norm, 6) AS score FROM dots JOIN norm USING (doc_id, j) JOIN tn USING (k)),
best AS (SELECT * FROM scored WHERE score >= {licences.LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, words DESC, licence) = 1),
sized AS (SELECT doc_id, dir, len(regexp_extract_all(lower(text), '{term}')) AS size FROM p),
said AS (SELECT dir, licence, score FROM best JOIN sized USING (doc_id) WHERE {licences.SHARE} * words >= size
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
near AS (SELECT d.dir, said.dir AS from_dir, licence, score FROM (SELECT DISTINCT dir FROM p) d JOIN said ON d.dir = said.dir OR starts_with(d.dir, said.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(said.dir) DESC) = 1)
SELECT p.doc_id, p.dir || '/' || CAST(p.doc_id AS VARCHAR) || '.txt' AS path, coalesce(best.licence, near.licence) AS licence,
  coalesce(best.score, near.score) AS score, CASE WHEN best.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' END AS found,
  CASE WHEN best.licence IS NULL THEN from_dir END AS from_dir
FROM p LEFT JOIN best USING (doc_id) LEFT JOIN near ON p.dir = near.dir"""
