"""Graph templates over suppliers (restaurants), part names (menus), documents (articles) and their words."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.fulltext import TextIndex
from ..session import shared_dir
from .base import Registry, table

registry = Registry()
query = registry.query

#: Words of documents that play technologies, events, topics and companies.
WORDS = {"MENTIONS_TECH": ("the", "and", "with"), "DESCRIBES_EVENT": ("for", "from", "by"), "MENTIONS": ("of", "to", "la", "die"), "MENTIONS_COMPANY": ("is", "are", "was", "le")}
EDGES = """
w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents),
edges AS (
  SELECT DISTINCT 'Restaurant' AS src_label, 's' || l_suppkey AS src, 'SELLS' AS type, 'Menu' AS dst_label, p_name AS dst FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT 'Menu', p_name, 'CONTAINS', 'Ingredient', string_split(p_name, ' ')[2] FROM part
  UNION ALL SELECT DISTINCT 'Menu', p_name, 'RELATED_TO', 'Concept', string_split(p_name, ' ')[1] FROM part
  UNION ALL SELECT DISTINCT 'Restaurant', 's' || l_suppkey, 'HAS_TAG', 'Tag', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45
  UNION ALL SELECT 'Restaurant', 's' || s_suppkey, 'LOCATED_IN', 'Area', 'NATION_' || s_nationkey FROM supplier
  UNION ALL SELECT 'Restaurant', 's' || s_suppkey, 'RELATED_TO', 'Concept', 'c' || s_nationkey % 5 FROM supplier
  UNION ALL SELECT 'Article', 'd' || doc_id, 'RELATED_TO', 'Concept', 'c' || doc_id % 7 FROM documents
  """ + "".join(f"UNION ALL SELECT 'Article', 'd' || doc_id, '{k}', 'Term', x FROM (SELECT doc_id, unnest(list_intersect(w, {list(ws)})) AS x FROM w) " for k, ws in WORDS.items()) + """),
restaurants AS (SELECT 's' || s_suppkey AS key, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END AS rating, s_acctbal / 100 AS price, s_acctbal > 500 AS is_active FROM supplier),
articles AS (SELECT 'd' || doc_id AS key, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS published, round(n_chars / 1000.0, 3) AS importance FROM documents),
sells AS (SELECT src AS r, dst AS m FROM edges WHERE type = 'SELLS'), contains AS (SELECT src AS m, dst AS i FROM edges WHERE type = 'CONTAINS'),
tags AS (SELECT src AS r, dst AS t FROM edges WHERE type = 'HAS_TAG'),
pref AS (SELECT * FROM sells WHERE m = 'small' OR m IN (SELECT src FROM edges WHERE type = 'RELATED_TO' AND src_label = 'Menu' AND dst = 'small'))"""
FOUND = """ SELECT key, coalesce(rating, 0.0) AS score, evidence FROM (SELECT r, string_agg(DISTINCT m, ',' ORDER BY m) AS evidence FROM f GROUP BY 1) JOIN restaurants ON r = key
WHERE is_active ORDER BY rating DESC NULLS FIRST, key LIMIT """
PAPERS = " SELECT key, published, importance FROM articles WHERE key IN (SELECT a FROM f) ORDER BY published DESC NULLS FIRST, key LIMIT "


def raw_nodes(spark, sf_dir):
    supplier, part, documents = (table(spark, sf_dir, t) for t in ("supplier", "part", "documents"))
    none = lambda kind: F.lit(None).cast(kind)
    places = supplier.select(F.lit("Restaurant").alias("label"), F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_acctbal")).alias("rating"), (F.col("s_acctbal") / 100).alias("price"), (F.col("s_acctbal") > 500).alias("is_active"), none("timestamp_ntz").alias("published"), none("double").alias("importance"))
    plain = lambda df, label, key: df.select(F.lit(label).alias("label"), key.alias("key")).distinct().select("label", "key", F.col("key").alias("name"), none("double").alias("rating"), none("double").alias("price"), none("boolean").alias("is_active"), none("timestamp_ntz").alias("published"), none("double").alias("importance"))
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 365).cast("int"))
    papers = documents.select(F.lit("Article").alias("label"), F.concat(F.lit("d"), "doc_id").alias("key"), F.left("text", F.lit(60)).alias("name"), none("double").alias("rating"), none("double").alias("price"), none("boolean").alias("is_active"), day.alias("published"), F.round(F.col("n_chars") / 1000.0, 3).alias("importance"))
    return places.unionByName(plain(part, "Menu", F.col("p_name"))).unionByName(plain(part, "Ingredient", F.split("p_name", " ")[1])).unionByName(papers)


def raw_edges(spark, sf_dir, sold_if="l_linenumber = 1"):
    supplier, part, lineitem, documents = (table(spark, sf_dir, t) for t in ("supplier", "part", "lineitem", "documents"))
    edge = lambda df, a, src, kind, b, dst: df.select(F.lit(a).alias("src_label"), src.alias("src"), F.lit(kind).alias("type"), F.lit(b).alias("dst_label"), dst.alias("dst"))
    sold = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    seller, place, paper = (F.concat(F.lit(p), c) for p, c in (("s", "l_suppkey"), ("s", "s_suppkey"), ("d", "doc_id")))
    parts = [
        edge(sold.filter(sold_if), "Restaurant", seller, "SELLS", "Menu", F.col("p_name")),
        edge(part, "Menu", F.col("p_name"), "CONTAINS", "Ingredient", F.split("p_name", " ")[1]),
        edge(part, "Menu", F.col("p_name"), "RELATED_TO", "Concept", F.split("p_name", " ")[0]),
        edge(sold.filter("l_quantity >= 45"), "Restaurant", seller, "HAS_TAG", "Tag", F.col("p_brand")),
        edge(supplier, "Restaurant", place, "LOCATED_IN", "Area", F.concat(F.lit("NATION_"), "s_nationkey")),
        edge(supplier, "Restaurant", place, "RELATED_TO", "Concept", F.concat(F.lit("c"), F.col("s_nationkey") % 5)),
        edge(documents, "Article", paper, "RELATED_TO", "Concept", F.concat(F.lit("c"), F.col("doc_id") % 7)),
    ]
    # a branch a type, so that a template which asks for one type doesn't read what makes the others
    words = F.array_distinct(F.split(F.lower("text"), " "))
    for kind, of in WORDS.items():
        said = documents.select("doc_id", F.explode(F.array_intersect(words, F.array(*[F.lit(w) for w in of]))).alias("w"))
        parts.append(edge(said, "Article", paper, "MENTIONS_TECHNOLOGY" if kind == "MENTIONS_TECH" else kind, "Term", F.col("w")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph(spark, sf_dir, **options):
    return G.Graph(raw_nodes(spark, sf_dir), G.merge_edges(raw_edges(spark, sf_dir, **options)))


def found(where: str, limit: int) -> str:
    return f"WITH {EDGES}, f AS ({where}){FOUND}{limit}"


def papers(where: str, limit: int) -> str:
    return f"WITH {EDGES}, f AS ({where}){PAPERS}{limit}"


def mention(kind: str, word: str) -> str:
    return f"a IN (SELECT src FROM edges WHERE type = '{kind}' AND dst = '{word}')"


ARTICLES = "SELECT key AS a FROM (SELECT key, key AS a FROM articles) WHERE "


@query(found("SELECT * FROM pref WHERE m NOT IN (SELECT m FROM contains WHERE i = 'ring')", 5))
def gq_exclude_ingredient(spark, sf_dir):
    return graph(spark, sf_dir).exclude_ingredient("small", "ring")


@query(found("SELECT * FROM pref WHERE r IN (SELECT r FROM tags WHERE t = 'Brand#7') AND r NOT IN (SELECT r FROM tags WHERE t = 'Brand#3')", 5))
def gq_required_excluded_tag(spark, sf_dir):
    return graph(spark, sf_dir).tagged("small", ["Brand#7"], ["Brand#3"])


@query(papers(ARTICLES + mention("MENTIONS_TECH", "with") + " AND " + mention("DESCRIBES_EVENT", "from"), 5))
def gq_two_term_event(spark, sf_dir):
    return graph(spark, sf_dir).two_terms("with", "from")


@query(f"WITH {EDGES} SELECT src_label AS label, src AS key, 0.8::DOUBLE AS score FROM edges WHERE type = 'RELATED_TO' AND dst = 'c3' AND src_label IN ('Restaurant', 'Article')")
def gq_concept_bridge(spark, sf_dir):
    return graph(spark, sf_dir).concept_bridge("c3")


@query(f"WITH {EDGES}, e AS (SELECT * FROM edges WHERE type = 'RELATED_TO' AND dst = 'c2') SELECT count(*) FILTER (WHERE src_label = 'Restaurant') AS restaurants, count(*) FILTER (WHERE src_label = 'Article') AS articles, min(src) FILTER (WHERE src_label = 'Restaurant') AS first_restaurant, min(src) FILTER (WHERE src_label = 'Article') AS first_article FROM e")
def gq_concept_bridge_lists(spark, sf_dir):
    return graph(spark, sf_dir).concept_bridge_lists("c2")


@query(found("SELECT * FROM pref WHERE r IN (SELECT src FROM edges WHERE type = 'LOCATED_IN' AND dst = 'NATION_15') AND r IN (SELECT r FROM tags WHERE t = 'Brand#7')", 10))
def gq_area_menu_tag(spark, sf_dir):
    return graph(spark, sf_dir).area_menu_tag("NATION_15", "small", "Brand#7")


@query(f"""WITH {EDGES} SELECT key, coalesce(rating, 0.0) AS score, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE type = 'LOCATED_IN' AND src = key), '') AS areas,
  coalesce((SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM tags WHERE r = key), '') AS tags FROM restaurants WHERE is_active AND key IN (SELECT r FROM pref)""")
def gq_menu_only(spark, sf_dir):
    return graph(spark, sf_dir).menu_only("small")


@query(found("SELECT * FROM pref WHERE r NOT IN (SELECT r FROM sells JOIN contains USING (m) WHERE i = 'ring')", 5).replace("l_linenumber = 1", "l_linenumber = 1 AND l_quantity = 50"))
def gq_exclude_everywhere(spark, sf_dir):
    return graph(spark, sf_dir, sold_if="l_linenumber = 1 AND l_quantity = 50").exclude_ingredient_everywhere("small", "ring")


@query(found("SELECT * FROM sells WHERE m <> 'red widget' AND r IN (SELECT r FROM sells WHERE m = 'red widget') AND m NOT IN (SELECT m FROM contains WHERE i = 'bolt')", 5))
def gq_other_menus(spark, sf_dir):
    return graph(spark, sf_dir).other_menus("red widget", "bolt")


@query(found("SELECT * FROM pref WHERE r IN (SELECT key FROM restaurants WHERE price <= 60) AND r IN (SELECT r FROM tags WHERE t = 'Brand#7')", 5))
def gq_menu_tag_price(spark, sf_dir):
    return graph(spark, sf_dir).menu_tag_price("small", "Brand#7", 60.0)


@query(found("SELECT * FROM pref WHERE r IN (SELECT r FROM tags WHERE t IN ('Brand#7', 'Brand#9') GROUP BY r HAVING count(DISTINCT t) = 2)", 5))
def gq_context_tags(spark, sf_dir):
    return graph(spark, sf_dir).tagged("small", ["Brand#7", "Brand#9"], [])


@query(f"WITH {EDGES} SELECT key, published, importance FROM articles WHERE key IN (SELECT src FROM edges WHERE type = 'MENTIONS' AND dst = 'die') ORDER BY importance DESC NULLS FIRST, published DESC NULLS FIRST, key LIMIT 10")
def gq_topic(spark, sf_dir):
    return graph(spark, sf_dir).topic("die")


@query(papers(ARTICLES + mention("MENTIONS_COMPANY", "is") + " AND " + mention("MENTIONS_COMPANY", "are") + " AND " + mention("DESCRIBES_EVENT", "for"), 10))
def gq_company_comparison(spark, sf_dir):
    return graph(spark, sf_dir).compare_companies("is", "are", "for")


@query(f"""WITH {EDGES}, f AS ({ARTICLES}{mention("MENTIONS", "of")} AND {mention("DESCRIBES_EVENT", "by")}), p AS ({PAPERS}10)
SELECT p.*, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE type = 'MENTIONS_TECH' AND src = key), '') AS techs,
  coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE type = 'MENTIONS_COMPANY' AND src = key), '') AS companies FROM p""")
def gq_topic_event(spark, sf_dir):
    return graph(spark, sf_dir).topic_event("of", "by")


@query(papers(ARTICLES + mention("MENTIONS", "la") + " AND " + mention("DESCRIBES_EVENT", "for"), 10))
def gq_security_incident(spark, sf_dir):
    return graph(spark, sf_dir).topic_event("la", "for", neighbours=False)


@query("""WITH p AS (SELECT doc_id AS key, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w IN ('with', 'from', 'dans') GROUP BY 1, 2),
d AS (SELECT word, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT key, round(sum(tf * ln(1 + n / df)), 6) AS score FROM p JOIN d USING (word), n GROUP BY 1 ORDER BY score DESC, key LIMIT 10""")
def gq_fulltext(spark, sf_dir):
    return G.full_text(table(spark, sf_dir, "documents"), "doc_id", F.split(F.lower("text"), " "), ["with", "from", "dans"], 10)


QUESTIONS = {"food": (["with", "from", "dans"], 5), "condition": (["la", "by"], 5), "news": (["of", "for", "is"], 10)}


@query(f"""WITH q AS (SELECT * FROM (VALUES {", ".join(f"('{q}', '{w}', {n})" for q, (words, n) in QUESTIONS.items() for w in words)}) AS q(question, word, most)),
p AS (SELECT doc_id AS key, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w IN (SELECT word FROM q) GROUP BY 1, 2),
d AS (SELECT word, count(*) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT question, most, key, round(sum(tf * ln(1 + n / df)), 6) AS score FROM q JOIN p USING (word) JOIN d USING (word), n GROUP BY 1, 2, 3)
SELECT question, key, score FROM s QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, key) <= most""")
def fulltext_index(spark, sf_dir):
    """Two batches, of which the second repeats the first one's documents, then three questions to the stored index."""
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.lower("text"), " ")
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")
    index.add(docs.filter("lang = 'en'"), "doc_id", words)
    index.add(docs, "doc_id", words)
    answers = [index.search(asked, limit).select(F.lit(question).alias("question"), "key", "score") for question, (asked, limit) in QUESTIONS.items()]
    return reduce(DataFrame.unionByName, answers)


@query(f"""WITH {EDGES} SELECT 'edge:' || type AS what, count(*) AS n FROM edges GROUP BY 1
UNION ALL SELECT 'bridges', count(*) FROM edges x JOIN edges y ON x.dst = y.dst AND x.type = 'RELATED_TO' AND y.type = 'RELATED_TO' AND x.src_label = 'Restaurant' AND y.src_label = 'Article'
UNION ALL SELECT 'idle', count(*) FROM restaurants WHERE key NOT IN (SELECT r FROM sells)""")
def graph_verify_counts(spark, sf_dir):
    return graph(spark, sf_dir).counts()


@query("SELECT 'Customer' AS label, 'k' || c_nationkey AS key, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 2")
def node_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.lit("Customer").alias("label"), F.concat(F.lit("k"), "c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return G.merge_nodes(rows, "seq")


@query(f"WITH {EDGES} SELECT src_label, type, count(*) AS n FROM edges GROUP BY 1, 2")
def edge_merge(spark, sf_dir):
    every = raw_edges(spark, sf_dir)
    return G.merge_edges(every.unionByName(every)).groupBy("src_label", "type").agg(F.count("*").alias("n"))


QUERIES, ORACLES = registry.queries, registry.oracles
