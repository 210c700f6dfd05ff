"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SETS = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
)
"""

SQL: dict[str, str] = {
    "op3_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20
""",
    "op5_near_dedup": f"""
WITH RECURSIVE {_SETS},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a
GROUP BY r.a
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS text_md5,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * length(translate(text, '!*$%&#', '')) / length(text) ELSE 1.0::DOUBLE END AS w
  FROM documents
),
k AS (SELECT *, -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS draw FROM d),
s AS (
  SELECT source, sum(size) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight,
         CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS source_key
  FROM d GROUP BY source
),
l AS (
  SELECT *, cap / weight AS level,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS free
  FROM s
),
water AS (SELECT arg_min(free, (level, source_key)) AS water FROM l WHERE level > free),
t AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM l CROSS JOIN water
),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
)
SELECT k.doc_id, k.source, CAST(k.size AS BIGINT) AS size, CAST(e.source_size AS BIGINT) AS source_size, e.target,
       CAST(e.epochs * k.size + least(k.size, greatest(0, CAST(round(e.target - e.epochs * e.source_size) AS BIGINT)
         - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.draw, k.h, k.text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
""",
}


def _escaped(column: str) -> str:
    from lodestone.llm.chat import Template

    out = f"replace({column}, '\\', '\\\\')"
    for c in Template().controls():
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL["op7_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (
  SELECT *, lag(role, 1, '') OVER w AS before, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last,
         length({_escaped('text')}) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 16 + length({_escaped('role')}) END AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(9 + sum(chars) AS BIGINT) AS formatted_chars,
       bool_and((before = '' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant'))
         AND bool_and(NOT last OR role = 'assistant') AS valid
FROM t GROUP BY conv_id
"""


def _licence_sql() -> str:
    """Every line and paragraph is scored here: the filter of telling terms is the operator's own."""
    from lodestone.llm.licenses import FILE, HEADER, LAST, LICENCE_FILE, LINE, PARAGRAPH, SPDX, SPDX_EXCEPTION, SPDX_EXPRESSION, SPDX_ID, SPDX_LATER, SPDX_TERMS, SPDX_WORDS, TERM, templates, unknown_idf

    own = templates()
    values = ", ".join("({}, {}, '{}', '{}')".format(i, kind, name, text.replace("'", "''")) for i, (kind, name, text) in enumerate(own))
    return f"""
WITH tpl(template, kind, license, wording) AS (VALUES {values}),
tt AS (SELECT template, kind, license, term, 1 + ln(count(*)) AS tf FROM (SELECT template, kind, license, unnest(regexp_extract_all(lower(wording), '{TERM}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + len(own)} / (1.0 + count(*))) + 1.0 AS idf FROM tt GROUP BY term),
tv AS (SELECT template, kind, license, term, tf * idf / sqrt(sum(tf * tf * idf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
d AS (
  SELECT doc_id, text, path, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_matches(path, '{LICENCE_FILE}') AS is_file
  FROM (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, CASE WHEN doc_id % 10 = 5 THEN 'p' || doc_id // 100 || '/LICENSE' WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE 'p' || doc_id // 100 || '/' || doc_id END) AS path FROM documents)
),
claims AS (
  SELECT DISTINCT doc_id, {HEADER} AS kind, trim(unnest(list_concat(string_split_regex(text, '{LINE}'), string_split_regex(text, '{PARAGRAPH}')))) AS wording FROM d
  UNION SELECT doc_id, {FILE}, text FROM d WHERE is_file
),
lt AS (SELECT kind, wording, term, 1 + ln(count(*)) AS tf FROM (SELECT kind, wording, unnest(regexp_extract_all(lower(wording), '{TERM}')) AS term FROM (SELECT DISTINCT kind, wording FROM claims)) GROUP BY ALL),
lw AS (SELECT kind, wording, term, tf * coalesce(idf, {unknown_idf(len(own))}) AS w FROM lt LEFT JOIN idf USING (term)),
norm AS (SELECT kind, wording, sqrt(sum(w * w)) AS n FROM lw GROUP BY ALL),
near AS (SELECT kind, wording, license, round(sum(w * weight) / any_value(n), 6) AS similarity FROM lw JOIN tv USING (kind, term) JOIN norm USING (kind, wording) GROUP BY kind, wording, template, license),
size AS (SELECT kind, wording, count(*) AS terms FROM lw GROUP BY ALL),
best AS (SELECT kind, wording, max(similarity) AS most FROM near WHERE similarity >= 0.7 GROUP BY ALL),
scored AS (SELECT DISTINCT kind, wording, license, similarity FROM near JOIN best USING (kind, wording) WHERE similarity = most),
expressions AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SPDX_EXPRESSION}', 1)) AS e FROM d),
ids AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(e, '{SPDX_EXCEPTION}', '', 'g'), '{SPDX_ID}')) AS id FROM expressions),
told AS (
  SELECT doc_id, kind, wording, license, similarity, similarity * terms AS matched FROM claims JOIN scored USING (kind, wording) JOIN size USING (kind, wording)
  UNION ALL SELECT DISTINCT doc_id, {SPDX}, regexp_replace(id, '{SPDX_LATER}', ''), regexp_replace(id, '{SPDX_LATER}', ''), 1.0, {SPDX_TERMS} FROM ids WHERE id NOT IN {SPDX_WORDS}
),
totals AS (SELECT doc_id, license, round(sum(matched), 3) AS total FROM told GROUP BY ALL),
of_wording AS (SELECT doc_id, kind, wording, arg_min(license, (-total, license)) AS license FROM told JOIN totals USING (doc_id, license) GROUP BY ALL),
sets AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS l FROM of_wording GROUP BY doc_id),
own AS (
  SELECT doc_id, arg_min(license, (license = '{LAST}', -kind, -total, -similarity, license)) AS license, arg_min(similarity, (license = '{LAST}', -kind, -total, -similarity, license)) AS similarity,
         any_value(array_to_string(CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> '{LAST}') ELSE l END, ',')) AS licenses
  FROM told JOIN totals USING (doc_id, license) JOIN sets USING (doc_id) GROUP BY doc_id
),
held AS (SELECT folder AS above, arg_min(license, (-similarity, license)) AS license, max(similarity) AS similarity FROM d JOIN own USING (doc_id) WHERE is_file GROUP BY folder),
above AS (
  SELECT folder, depth, array_to_string(string_split(folder, '/')[1:depth], '/') AS above
  FROM (SELECT folder, unnest(range(0, CASE WHEN folder = '' THEN 1 ELSE len(string_split(folder, '/')) + 1 END)) AS depth FROM (SELECT DISTINCT folder FROM d))
),
up AS (SELECT folder, arg_max(license, depth) AS up_license, arg_max(similarity, depth) AS up_similarity FROM above JOIN held USING (above) GROUP BY folder)
SELECT doc_id, path, coalesce(license, up_license) AS license, coalesce(similarity, up_similarity) AS similarity, coalesce(licenses, up_license, '') AS licenses,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN up_license IS NOT NULL THEN 'inherited' END AS found
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN up USING (folder)
"""


SQL["op10_licenses"] = _licence_sql()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op11_source_divergence"] = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
tokens AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY ALL HAVING count(DISTINCT n) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
cells AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM tokens t SEMI JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums s USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, 1 + CAST((1000000000::HUGEINT * (coalesce(x.c, 0) + 5)) // (g.n + 5 * v.v) AS BIGINT) AS p,
         1 + CAST((1000000000::HUGEINT * (k.c + 5)) // (v.n + 5 * v.v) AS BIGINT) AS q
  FROM groups g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN cells x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
),
far AS (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.f, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

SQL["op13_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t, row_number() OVER () AS r FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
asked AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
size AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
post AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM post SEMI JOIN asked USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, size),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS s FROM tf JOIN w USING (term), size),
score AS (SELECT item_id, r, doc_id, CAST(sum(s * times) AS BIGINT) AS score FROM asked JOIN part USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL HAVING sum(s * times) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 20
"""
