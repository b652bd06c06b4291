"""Small functions over the driver's tables: tags, JSON, times, distinct texts, cached answers, merged graphs, jitter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions import text as S
from ..operators import graph_build, records
from ..sources import lake
from .base import Registry, table

registry = Registry()
query = registry.query


def sql_escaped(text: str) -> str:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{mark}', '{entity}')"
    return text


ALT = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<b>\"A\" & ''B''</b>' ELSE substr(html, 1, 900) END"


@query(f"""
WITH v AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '  ' ELSE ' ' || url || '?a=1&b=' || page_id || chr(10) END AS url, {ALT} AS alt FROM pages),
h AS (SELECT page_id, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS url, {sql_escaped("coalesce(alt, '')")} AS alt FROM v),
t AS (SELECT page_id, url, '<img src="' || {sql_escaped("url")} || '" alt="' AS head, alt FROM h)
SELECT page_id, CASE WHEN url = '' THEN '' ELSE head || left(alt, greatest(496 - length(head), 0)::INT) || '" />' END AS tag FROM t""")
def image_tags(spark, sf_dir):
    """The tag of an image: its address and as much of the alternative text as fits."""
    url = F.expr("CASE WHEN page_id % 7 = 0 THEN '  ' ELSE concat(' ', url, '?a=1&b=', page_id, '\\n') END")
    alt = F.expr("CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<b>\"A\" & \\'B\\'</b>' ELSE substr(html, 1, 900) END")
    return table(spark, sf_dir, "pages").select("page_id", S.image_tag(url, alt).alias("tag"))


@query("SELECT doc_id, left(coalesce(CASE WHEN doc_id % 6 > 0 THEN text END, ''), 100) AS title, left(coalesce(array_to_string(regexp_split_to_array(text, '\\s+'), ', '), ''), 100) AS listed FROM documents")
def shortened_texts(spark, sf_dir):
    """A text, and the list of its words, cut to a column's width; null is empty."""
    rows = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 6 > 0, F.col("text"))
    return rows.select("doc_id", S.shortened(title, 100).alias("title"), S.shortened(F.array_join(F.split("text", r"\s+"), ", "), 100).alias("listed"))


@query(r"""
WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'So: ```json' || chr(10) || props || chr(10) || '``` done' WHEN 1 THEN '``` ' || props || '```' WHEN 2 THEN 'it is ' || props || ' ok' ELSE event_type END AS answer FROM events)
SELECT event_id, coalesce(nullif(regexp_extract(answer, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1), ''), nullif(regexp_extract(answer, '(?s)(\{.*\})', 1), '')) AS block FROM a""")
def json_blocks(spark, sf_dir):
    """The JSON object in an answer: fenced, bare within prose, or none."""
    answer = F.expr("CASE event_id % 4 WHEN 0 THEN concat('So: ```json\\n', props, '\\n``` done') WHEN 1 THEN concat('``` ', props, '```') WHEN 2 THEN concat('it is ', props, ' ok') ELSE event_type END")
    return table(spark, sf_dir, "events").select("event_id", S.json_block(answer).alias("block"))


@query("SELECT user_id, event_id, event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, sf_dir):
    """A user's events, a hundred ids at most in each JSON array, read back as rows of the fields wanted."""
    item = F.to_json(F.struct("event_id", F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("value").alias("unread")))
    payloads = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("payload"))
    return payloads.select("user_id", lake.json_items(F.col("payload"), "event_id: bigint, name: string, k: bigint"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 23400 SECOND WHEN 1 THEN o_orderdate - INTERVAL 9000 SECOND END AS at FROM orders""")
def utc_times(spark, sf_dir):
    """ISO times with zones as times in UTC without one; what is no time is null."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T06:30:00Z"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T06:30:00+09:00"))).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.utc_naive(given).alias("at"))


@query("""
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN list_filter(list_transform(regexp_split_to_array(p_name || ' | ' || p_type || '|  |' || p_name || ' |' || p_brand, '\\|'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS texts FROM part)
SELECT p_partkey, array_to_string(list_filter(texts, lambda x, i: list_position(texts, x) = i), ';') AS texts FROM v""")
def distinct_texts(spark, sf_dir):
    """A list's texts trimmed, each once in the order of coming; null has none."""
    given = F.when(F.col("p_partkey") % 9 > 0, F.split(F.concat("p_name", F.lit(" | "), "p_type", F.lit("|  |"), "p_name", F.lit(" |"), "p_brand"), r"\|"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.unique_texts(given), ";").alias("texts"))


@query("""
WITH k AS (SELECT url, nullif(trim(CASE page_id % 4 WHEN 0 THEN ' ' ELSE regexp_extract(url, '^[a-z]+://[^/]+', 0) || '  ' END), '') AS key FROM pages)
SELECT key, length(key)::BIGINT AS answer, count(*) AS n_rows, CASE WHEN key IS NULL THEN 0 ELSE 1 END AS n_asked FROM k GROUP BY key""")
def cached_answers(spark, sf_dir):
    """A model asked once for each distinct address: rows served, and times asked, by key."""
    key = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.lit("  ")))
    rows = table(spark, sf_dir, "pages").select(key.alias("url"))
    served = records.once_each(rows, F.col("url"), lambda k: F.struct(F.length(k).cast("long").alias("answer"), F.lit(1).alias("asked")), "made")
    return served.groupBy(S.blank(F.col("url")).alias("key")).agg(F.max("made.answer").alias("answer"), F.count("*").alias("n_rows"), F.coalesce(F.max("made.asked"), F.lit(0)).alias("n_asked"))


@query("""
WITH k AS (SELECT o_custkey::VARCHAR AS src, CASE o_orderkey % 5 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Company' WHEN 2 THEN 'Event' WHEN 3 THEN 'Topic' ELSE 'Person' END AS kind, o_orderpriority AS name FROM orders)
SELECT DISTINCT 'Article' AS src_label, src, CASE kind WHEN 'Technology' THEN 'MENTIONS_TECH' WHEN 'Company' THEN 'MENTIONS_COMPANY' WHEN 'Event' THEN 'DESCRIBES_EVENT' ELSE 'MENTIONS' END AS type, kind AS dst_label, name AS dst FROM k WHERE kind <> 'Person'""")
def keyword_graph(spark, sf_dir):
    """Edges from articles to their keywords; kinds that the graph doesn't know make none."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Technology", "Company", "Event", "Topic", "Person")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    said = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("article_id")).agg(F.collect_list(F.struct(kind.alias("kind"), F.col("o_orderpriority").alias("name"))).alias("keywords"))
    return graph_build.keyword_edges(said)


@query("""
WITH c AS (SELECT c_custkey::VARCHAR AS key, c_name AS name, c_nationkey::VARCHAR AS area FROM customer),
n AS (SELECT 'Restaurant' AS label, key, CASE WHEN key::BIGINT % 2 = 0 THEN upper(name) ELSE name END AS name FROM c UNION ALL SELECT DISTINCT 'Area', area, area FROM c)
SELECT label, n.key, name, coalesce(e.n, 0) AS n_edges FROM n LEFT JOIN (SELECT key, count(*) AS n FROM c GROUP BY key) e ON e.key = n.key AND label = 'Restaurant'""")
def merged_imports(spark, sf_dir):
    """Two imports of one graph: of a node the later counts, edges stand once."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("area"))
    areas = graph_build.node(c, "Area", F.col("area"), name=F.col("area")).distinct()
    edges = c.select(F.lit("Restaurant").alias("src_label"), F.col("key").alias("src"), F.lit("LOCATED_IN").alias("type"), F.lit("Area").alias("dst_label"), F.col("area").alias("dst"))
    first = graph_build.node(c, "Restaurant", F.col("key"), name=F.col("name")).unionByName(areas)
    later = graph_build.node(c.filter("key % 2 = 0"), "Restaurant", F.col("key"), name=F.upper("name"))
    graph = graph_build.merged([(first, edges), (later, edges)])
    n = graph.edges.groupBy(F.col("src_label").alias("label"), F.col("src").alias("key")).agg(F.count("*").alias("n_edges"))
    return graph.nodes.select("label", "key", "name").join(n, ["label", "key"], "left").fillna(0, ["n_edges"])


@query("SELECT o_orderkey, 0.9 + 0.2 * (CAST('0x' || left(md5('posts|' || o_orderkey || '|' || o_orderpriority), 8) AS BIGINT) / 4294967296.0::DOUBLE) AS jitter FROM orders")
def keyword_jitter(spark, sf_dir):
    """A factor near one that scope, id and keyword fix, so a run gives the same order again."""
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.hash_uniform(F.lit("posts"), F.col("o_orderkey"), F.col("o_orderpriority"), low=0.9, high=1.1).alias("jitter"))


QUERIES, ORACLES = registry.queries, registry.oracles
