"""DuckDB SQL for those registered queries that SQL can express."""

from __future__ import annotations

from .license_scan import COVERED, PHRASES, SLACK, STRETCH, TEMPLATES, K
from .near_join import TERM, THRESHOLD
from .resampling import BUCKETS, LEAST_WORDS, SALT, SHARE
from .url_rules import BLOCK_WORDS, BORDER, LISTED, LOWER, UPPER


def url_rules_sql() -> str:
    listed = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for v, r in LISTED)
    words = ", ".join(f"('{w}')" for w in BLOCK_WORDS)
    return f"""
WITH listed(rule, host, path, verdict) AS (VALUES {listed}), words(word) AS (VALUES {words}),
urls AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
fit AS (
  SELECT n, arg_max(l.rule, length(l.rule)) AS rule, arg_max(l.verdict, length(l.rule)) AS verdict
  FROM parts p JOIN listed l ON (p.host = l.host OR ends_with(p.host, '.' || l.host)) AND starts_with(p.path, l.path) GROUP BY n),
word AS (
  SELECT n, string_agg(word, ',' ORDER BY word) AS matched FROM parts JOIN words ON regexp_matches(translate(host || path, '{UPPER}', '{LOWER}'), '(?:^|{BORDER})' || word || '(?:{BORDER}|$)') GROUP BY n)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN word.matched IS NULL THEN 'allow' ELSE 'block' END) AS verdict, coalesce(word.matched, '') AS matched
FROM parts LEFT JOIN fit USING (n) LEFT JOIN word USING (n)"""


def license_sql() -> str:
    """Words of k-grams stand for their hashes."""
    words = lambda text: f"list_filter(regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    grams = f"list_transform(range(0, len(w) - {K - 1}), lambda i: {{'i': i, 'gram': array_to_string(w[i + 1:i + {K}], ' ')}})"
    templates = ", ".join(f"({n}, '{label}', '{wording}')" for n, (label, wording) in enumerate(TEMPLATES))
    at = lambda phrase: f"list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + {len(phrase.split())}], ' ') = '{phrase}')"
    places = " || ".join(at(p) for p in PHRASES.values())
    base = ", ".join(f"CASE WHEN len({at(p)}) > 0 THEN '{label}' END" for label, p in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT template, label, {words('wording')} AS w FROM (VALUES {templates}) AS v(template, label, wording)),
g AS (SELECT template, label, len(w) - {K - 1} AS grams, x.i AS at, x.gram AS gram FROM (SELECT *, unnest({grams}) AS x FROM t)),
h AS (SELECT n, x.i AS i, x.gram AS gram FROM (SELECT n, unnest({grams}) AS x FROM d)),
v AS (SELECT n, template, label, grams, h.i - g.at AS diagonal, list(DISTINCT g.at) AS ats, min(h.i) AS first, max(h.i) AS last FROM h JOIN g USING (gram) GROUP BY ALL),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY n, template ORDER BY diagonal) > {SLACK} THEN 1 ELSE 0 END AS apart FROM v),
r AS (SELECT *, sum(apart) OVER (PARTITION BY n, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM a),
m AS (SELECT n, label, grams, len(list_distinct(flatten(list(ats)))) AS held, max(last) + {K} - min(first) AS length FROM r GROUP BY n, template, label, grams, run),
f AS (SELECT n, list(DISTINCT label) AS found, max(held / grams) AS covered FROM m WHERE held / grams >= {COVERED} AND length <= {STRETCH} * (grams + {K - 1}) GROUP BY n),
b AS (SELECT n, doc_id, len(w) AS n_words, {places} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM d)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(covered, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN f USING (n)"""


def near_sql() -> str:
    """All pairs of texts that share a run of words, without candidates or pruning."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {TERM} THEN list_transform(range(1, len(w) - {TERM - 2}), lambda i: array_to_string(w[i:i + {TERM - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE k >= {THRESHOLD} * (cx.n + cy.n - k)
  UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.w = b.w AND a.doc_id <> b.doc_id),
r AS (SELECT x AS node, x AS seen FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.seen = l.x),
m AS (SELECT node, min(seen) AS class_id FROM r GROUP BY 1),
t AS (SELECT w, min(doc_id) AS text_class FROM w GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT w.doc_id, coalesce(m.class_id, w.doc_id) AS class_id, coalesce(n.n, 0) AS n_links, t.text_class
FROM w JOIN t USING (w) LEFT JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.x = w.doc_id"""


def centroids_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd rounds by all distances, a round after the other."""
    square = "list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
a{r} AS MATERIALIZED (SELECT n, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT n, c.c, {square} AS d FROM kept, c{r} c) GROUP BY n)"""
        if r < rounds:
            steps += f""",
s{r} AS (SELECT a.c, i, sum(kept.v[i]) AS s, count(*) AS m FROM kept JOIN a{r} a USING (n), range(1, 65) AS t(i) GROUP BY a.c, i),
u{r} AS (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN u{r} u USING (c))"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v, sha256('1:' || vec_id) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM kept ORDER BY h LIMIT {k}){steps}
SELECT kept.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (n) JOIN c{rounds} c ON c.c = a.c"""


def resampling_sql() -> str:
    """CRC-32 by a table that SQL makes from the polynomial; ranks by a window over all eligible rows."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH crc AS MATERIALIZED (
  SELECT n AS byte, list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), n) AS v FROM range(256) AS t(n)),
table_of AS MATERIALIZED (SELECT list(v ORDER BY byte) AS t FROM crc),
d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
x AS MATERIALIZED (SELECT n, word, count(*) AS m FROM (SELECT n, unnest(w) AS word FROM d) GROUP BY ALL),
y AS MATERIALIZED (SELECT word, count(*) AS m FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM x UNION SELECT word FROM y)),
bucket AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS k
  FROM vocabulary, table_of),
s AS (SELECT k, sum(m) AS s FROM x JOIN bucket USING (word) GROUP BY k),
t AS (SELECT k, sum(m) AS t FROM y JOIN bucket USING (word) GROUP BY k),
whole AS (SELECT (SELECT coalesce(sum(m), 0) FROM x)::DOUBLE AS s_all, (SELECT coalesce(sum(m), 0) FROM y)::DOUBLE AS t_all),
gain AS MATERIALIZED (
  SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + {BUCKETS}) / ((s::DOUBLE + 1) * (t_all + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (k), whole),
weight AS (SELECT n, sum(m * g)::BIGINT AS weight FROM x JOIN bucket USING (word) JOIN gain USING (k) GROUP BY n),
scored AS (
  SELECT d.n, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SALT}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (n)),
placed AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= eligible * {SHARE} // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (n)"""


ORACLES = {
    "op8_license_diagonals": license_sql(), "op9_url_rules": url_rules_sql(), "op10_near_bayes": near_sql(), "op11_centroid_screen": centroids_sql(),
    "op13_target_resampling": resampling_sql(),
}
