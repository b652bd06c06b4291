"""Vectors: normalisation, pairs, nearest, top-k, components, cores, image groups. Labels are stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import components as C
from ..operators import merging, similarity
from .base import Registry, table

registry = Registry()
query = registry.query
NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"
UNITS = f"u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {NORM}) AS v FROM embeddings)"
PAIRS = UNITS + ", p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label, list_dot_product(x.v, y.v) AS similarity FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query(f"SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / {NORM}, 6) AS first, round({NORM}, 6) AS length FROM embeddings")
def l2_normalise(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(V.normalised(F.col("embedding"))[0], 6).alias("first"), F.round(V.norm(F.col("embedding")), 6).alias("length"))


@query(f"WITH {PAIRS} SELECT a, b, label, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.3")
def cosine_pairs(spark, sf_dir):
    return similarity.pairs_within(vectors(spark, sf_dir), "label", "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {PAIRS}, e AS (SELECT a AS key, similarity FROM p UNION ALL SELECT b, similarity FROM p) SELECT u.vec_id AS key, round(max(similarity), 6) AS nearest FROM u LEFT JOIN e ON u.vec_id = e.key GROUP BY 1")
def nearest_similarity(spark, sf_dir):
    return similarity.nearest(vectors(spark, sf_dir), "label", "vec_id", "embedding")


@query(f"""WITH {UNITS}, n AS (SELECT q.vec_id AS query, x.vec_id AS key, 1 - list_dot_product(q.v, x.v) AS distance FROM u q JOIN u x ON q.label = x.label AND q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, key, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM n WHERE distance <= 0.9) WHERE rank <= 20""")
def topk_filtered(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = similarity.top_k(rows.filter("vec_id % 20 = 0"), rows, "label", "vec_id", "embedding", 20, 0.9)
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM p WHERE similarity >= 0.3 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.3),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, min(seen) AS label FROM r GROUP BY 1""")
def components(spark, sf_dir):
    return C.components(similarity.links_within(vectors(spark, sf_dir), "label", "vec_id", "embedding", 0.3))


def core_sql(rounds: int, least: int) -> str:
    """The edges left after so many rounds, each of which takes the nodes with fewer neighbours; an error where the last
    round still took some."""
    steps = ["e0 AS MATERIALIZED (SELECT a, b FROM p WHERE similarity >= 0.2)"]
    for k in range(rounds):
        steps.append(f"k{k} AS MATERIALIZED (SELECT node FROM (SELECT a AS node FROM e{k} UNION ALL SELECT b FROM e{k}) GROUP BY 1 HAVING count(*) >= {least})")
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT a, b FROM e{k} WHERE a IN (SELECT node FROM k{k}) AND b IN (SELECT node FROM k{k}))")
    settled = f"CASE WHEN (SELECT count(*) FROM e{rounds}) < (SELECT count(*) FROM e{rounds - 1}) THEN CAST(error('the core needs more rounds') AS BOOLEAN) ELSE true END"
    steps.append(f"core AS MATERIALIZED (SELECT a, b FROM e{rounds} WHERE {settled})")
    return f"WITH RECURSIVE {PAIRS}, {', '.join(steps)}"


@query(core_sql(30, 2) + " SELECT a, b FROM core")
def kcore(spark, sf_dir):
    return similarity.core_pairs(vectors(spark, sf_dir), "label", "vec_id", "embedding", 0.2, 2)


@query(core_sql(30, 2) + """,
e AS (SELECT a, b FROM core UNION ALL SELECT b, a FROM core), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
f AS (SELECT node, min(seen) AS family FROM r GROUP BY 1), m AS (SELECT label, vec_id, family FROM embeddings JOIN f ON vec_id = node),
n AS (SELECT label, family, row_number() OVER (PARTITION BY label ORDER BY family) AS n FROM (SELECT DISTINCT label, family FROM m)),
g AS (SELECT vec_id, 'imggrp-' || lpad(CAST(n AS VARCHAR), 3, '0') AS image_group, row_number() OVER (PARTITION BY m.label, m.family ORDER BY vec_id) AS group_order FROM m JOIN n ON m.label = n.label AND m.family = n.family),
x AS (SELECT i.label, i.vec_id, image_group, group_order, CASE WHEN i.vec_id IS NULL THEN 'MISSING_IMAGE_URL' WHEN embedding IS NULL THEN 'VECTORIZE_FAILED' WHEN image_group IS NULL THEN 'NO_SIMILAR_IMAGE_IN_STORE' END AS reason FROM embeddings i LEFT JOIN g ON i.vec_id = g.vec_id)
SELECT label, vec_id, image_group, group_order, CASE WHEN reason IS NULL THEN 'keep' ELSE 'drop' END AS decision, reason FROM x""")
def image_groups(spark, sf_dir):
    return similarity.image_groups(vectors(spark, sf_dir), "label", "vec_id", "embedding", threshold=0.2)


SIGNALS = """SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN ['p' || vec_id % 4] ELSE [] END AS predicates, CASE WHEN vec_id % 5 = 0 THEN ['a' || vec_id % 2] ELSE [] END AS actions,
  CASE WHEN vec_id % 7 <> 0 THEN ['noun' || vec_id % 6] ELSE [] END AS nouns, CASE WHEN vec_id % 4 = 0 AND vec_id % 7 <> 0 THEN ['noun' || vec_id % 6] ELSE [] END AS topics FROM embeddings"""


@query(f"""WITH {UNITS}, s AS ({SIGNALS}),
n AS (SELECT q.vec_id AS query, x.vec_id AS key, 1 - list_dot_product(q.v, x.v) AS distance FROM u q JOIN u x ON q.label = x.label AND q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query, key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM n WHERE distance <= 0.95) WHERE rank <= 20),
j AS (SELECT r.query, r.key, a.predicates AS ap, a.actions AS aa, a.nouns AS an, a.topics AS ato, b.predicates AS bp, b.actions AS ba, b.nouns AS bn, b.topics AS bto FROM r JOIN s a ON a.vec_id = r.query JOIN s b ON b.vec_id = r.key),
g AS (SELECT query, key, CASE WHEN len(ap) + len(aa) + len(an) = 0 OR len(bp) + len(ba) + len(bn) = 0 THEN true
  WHEN len(ato) > 0 AND len(bto) = 0 AND NOT list_has_any(ato, bn) THEN false WHEN len(bto) > 0 AND len(ato) = 0 AND NOT list_has_any(bto, an) THEN false
  WHEN len(ato) > 0 AND len(bto) > 0 AND NOT list_has_any(ato, bto) THEN false WHEN len(aa) > 0 OR len(ba) > 0 THEN list_has_any(aa, ba)
  ELSE list_has_any(ato, bto) OR list_has_any(an, bn) OR list_has_any(ap, bp) END AS fits FROM j)
SELECT query, CAST(sum(key % 5 + 1) AS BIGINT) AS historical_count, count(*) AS similar FROM g WHERE fits GROUP BY 1""")
def keyword_history(spark, sf_dir):
    """Counts of stored keywords near a new one, unless what they are about is at odds."""
    k = F.col("vec_id")
    some = lambda test, value: F.when(test, F.array(value)).otherwise(F.array().cast("array<string>"))
    noun = F.concat(F.lit("noun"), k % 6)
    signals = F.struct(some(k % 3 == 0, F.concat(F.lit("p"), k % 4)).alias("predicates"), some(k % 5 == 0, F.concat(F.lit("a"), k % 2)).alias("actions"), some(k % 7 != 0, noun).alias("nouns"), some((k % 4 == 0) & (k % 7 != 0), noun).alias("topics"))
    rows = vectors(spark, sf_dir).withColumns({"signals": signals, "batch_count": k % 5 + 1})
    return merging.similar_history(rows.filter("vec_id % 20 = 0"), rows, "label", "vec_id", "embedding", most_distance=0.95)


QUERIES, ORACLES = registry.queries, registry.oracles
