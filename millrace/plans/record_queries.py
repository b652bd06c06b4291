"""Records, posts and graph builds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import hash_embedder
from ..operators import graph_build, policy, posts, records
from ..operators import upserts as U
from .base import Registry, table

registry = Registry()
query = registry.query


@query(r"""SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(CASE p_partkey % 4 WHEN 0 THEN p_name || ' 2큰술' WHEN 1 THEN p_name || '  1/2 컵 약간' WHEN 2 THEN p_name || ' 300 g' ELSE p_name END, '\s+', ' ', 'g')),
  '(?:\s+(?:약간|적당량|조금|취향껏|[0-9]+(?:/[0-9]+)?(?:\.[0-9]+)?\s*(?:g|kg|ml|l|개|대|쪽|알|큰술|작은술|스푼|컵|줌|장|봉|팩|캔|꼬집|T|t)))+$', '')) AS name FROM part""")
def ingredient_names(spark, sf_dir):
    given = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' 2큰술') WHEN 1 THEN concat(p_name, '  1/2 컵 약간') WHEN 2 THEN concat(p_name, ' 300 g') ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", records.ingredient_name(given).alias("name"))


@query("""
WITH m AS (SELECT DISTINCT p_name AS menu, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[2] END AS k FROM part),
r AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS keyword, p_brand AS ingredient, 'u' || string_split(p_name, ' ')[2] AS url FROM part WHERE p_size < 5 AND string_split(p_name, ' ')[2] < 'm'),
f AS (SELECT p_name AS menu, min(p_type) AS ingredient FROM part WHERE p_size > 40 GROUP BY 1)
SELECT DISTINCT m.menu, r.ingredient, 'RECIPE' AS source, r.url AS source_url FROM m JOIN r ON m.k = r.keyword
UNION SELECT DISTINCT m.menu, f.ingredient, 'CSV_FALLBACK', '' FROM m JOIN f ON m.menu = f.menu WHERE m.k IS NULL OR m.k NOT IN (SELECT keyword FROM r)""")
def recipe_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")[1]
    menus = part.select(F.col("p_name").alias("raw_name"), F.lit(None).cast("string").alias("normalized_name"), F.when(F.col("p_partkey") % 3 == 0, word).alias("recipe_keyword"))
    recipes = part.filter("p_size < 5").select(word.alias("keyword"), F.col("p_brand").alias("ingredient"), F.concat(F.lit("u"), word).alias("recipe_url")).filter("keyword < 'm'").distinct()
    fallback = part.filter("p_size > 40").groupBy(F.col("p_name").alias("menu")).agg(F.array(F.min("p_type")).alias("ingredients"))
    return records.menu_ingredients(menus, recipes, fallback)


@query("""
WITH f AS (SELECT user_id AS entity_id, event_type AS reason, ts, event_id FROM events),
l AS (SELECT entity_id, CASE reason WHEN 'error' THEN 'NETWORK_ERROR' WHEN 'view' THEN 'SELECTOR_MISMATCH' WHEN 'click' THEN 'NOT_FOUND' ELSE 'OTHER' END AS reason_code, arg_max(event_id % 7, struct_pack(t := ts, c := event_id % 7)) AS n, max(ts) AS ts FROM f GROUP BY 1, 2)
SELECT entity_id, reason_code, n + CASE WHEN CAST(ts AS DATE) < DATE '2024-01-30' THEN 1 ELSE 0 END AS retry_count,
  CASE reason_code WHEN 'NETWORK_ERROR' THEN CASE WHEN n + CASE WHEN CAST(ts AS DATE) < DATE '2024-01-30' THEN 1 ELSE 0 END >= 5 THEN 'DROP' ELSE 'RETRY' END WHEN 'SELECTOR_MISMATCH' THEN 'REPROCESS' WHEN 'NOT_FOUND' THEN 'DROP' ELSE 'WARN' END AS action FROM l""")
def retry_state(spark, sf_dir):
    reason = F.expr("CASE event_type WHEN 'error' THEN 'NETWORK_ERROR' WHEN 'view' THEN 'SELECTOR_MISMATCH' WHEN 'click' THEN 'NOT_FOUND' ELSE 'OTHER' END")
    fails = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), reason.alias("reason_code"), F.col("ts").alias("created_at"), (F.col("event_id") % 7).alias("retry_count"))
    return records.retry_step(fails, F.lit("2024-01-30").cast("date"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'plain text' WHEN 1 THEN 'see ' || chr(10) || 'end https://real.kr/x' ELSE 'kept line' END AS post FROM documents""")
def generated_clean(spark, sf_dir):
    answer = F.expr("CASE doc_id % 3 WHEN 0 THEN '<think>hmm</think>답변: plain text' WHEN 1 THEN concat('see https://example.com/a\\nend https://real.kr/x') ELSE '글자수 300자, 키워드 포함\\nkept line' END")
    return table(spark, sf_dir, "documents").select("doc_id", posts.cleaned(answer).alias("post"))


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '  ' ELSE c_name || chr(10) || 'x' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'IC01' ELSE 'IC02' END AS info, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS shop FROM customer)
SELECT CASE WHEN c_custkey % 10 = 0 THEN 'EMPTY' WHEN info = 'IC01' AND shop IS NULL THEN 'NO_SHOP' ELSE 'ok' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def post_insert(spark, sf_dir):
    title = F.when(F.col("c_custkey") % 10 == 0, "  ").otherwise(F.concat("c_name", F.lit("\nx")))
    results = table(spark, sf_dir, "customer").select(title.alias("title"), F.lit("body").alias("post"), F.array(F.lit("a"), F.lit("b")).alias("keywords"), F.when(F.col("c_custkey") % 2 == 0, "IC01").otherwise("IC02").alias("information_cd"), F.lit(1).alias("map_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("shop_id"), F.col("c_custkey").alias("crawling_id"))
    good, bad = posts.post_rows(results, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id")))
    return bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n")).unionByName(good.select(F.lit("ok").alias("outcome"), "post_id").groupBy("outcome").agg(F.count_distinct("post_id").alias("n")))


@query("""SELECT c_custkey AS post_id, left('BUILDING' || ' #' || c_mktsegment, 100) AS tag, count(o_orderkey) AS used FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment""")
def post_vector(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("post_id"), F.col("c_custkey").alias("shop_id"), F.col("c_name").alias("content"), F.array(F.lit("BUILDING"), "c_mktsegment").alias("keywords"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shop_id"), F.col("o_orderkey").alias("crawling_id"), F.col("o_orderdate").alias("crawling_created_at"), F.lit(None).cast("timestamp_ntz").alias("created_dt"))
    docs = posts.vector_documents(made, rows, hash_embedder(8))
    return docs.select("post_id", "metadata.tag", F.coalesce(F.size("metadata.used_crawling_ids"), F.lit(0)).cast("long").alias("used")).withColumn("used", F.greatest("used", F.lit(0)))


@query()
def generation_loop(spark, sf_dir):
    prompts = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return posts.generate(prompts, "prompt", lambda p: F.left(p, F.lit(300)), policy.quality_issue, lambda p, issue: F.concat(p, F.lit(" "), issue)).select("item_id", "post", "issue")


@query("""SELECT c_custkey, len(list_filter(string_split('MATCH (a); ; RETURN ' || c_name || ';', ';'), lambda s: trim(s) <> '')) AS n FROM customer""")
def script_split(spark, sf_dir):
    script = F.concat(F.lit("MATCH (a); ; RETURN "), "c_name", F.lit(";"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(posts.script_statements(script)).cast("long").alias("n"))


@query("""
WITH a AS (SELECT 'd' || doc_id AS thread, CASE doc_id % 4 WHEN 0 THEN 'OpenAI GPT update' WHEN 1 THEN 'Kubernetes cloud breach' ELSE 'quiet' END AS t FROM documents),
e AS (SELECT thread, unnest(CASE t WHEN 'OpenAI GPT update' THEN ['MENTIONS_TECH:gpt', 'MENTIONS_COMPANY:openai', 'DESCRIBES_EVENT:update'] WHEN 'Kubernetes cloud breach' THEN ['MENTIONS_TECH:kubernetes', 'DESCRIBES_EVENT:security_incident', 'MENTIONS:cloud'] ELSE [] END) AS x FROM a)
SELECT string_split(x, ':')[1] AS type, string_split(x, ':')[2] AS dst, count(*) AS n FROM e GROUP BY 1, 2""")
def graph_build_news(spark, sf_dir):
    title = F.expr("CASE doc_id % 4 WHEN 0 THEN 'OpenAI GPT update' WHEN 1 THEN 'Kubernetes cloud breach' ELSE 'quiet' END")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("thread"), title.alias("title"), F.lit("").alias("content"), F.lit("u").alias("article_url"), F.lit("2026-05-20 10:00:00").alias("created_at"))
    return graph_build.news_graph(rows)[1].groupBy("type", "dst").agg(F.count("*").alias("n"))


@query("""SELECT 'SELLS' AS type, count(*) AS n FROM (SELECT DISTINCT s_suppkey, p_name FROM supplier JOIN part ON p_partkey % 100 = s_suppkey)
UNION ALL SELECT 'HAS_TAG', count(*) FROM (SELECT DISTINCT s_suppkey, p_brand FROM supplier JOIN part ON p_partkey % 100 = s_suppkey)
UNION ALL SELECT 'LOCATED_IN', count(*) FROM supplier WHERE s_nationkey <> 7 AND s_suppkey IN (SELECT p_partkey % 100 FROM part)""")
def graph_build_restaurant(spark, sf_dir):
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    menus = part.groupBy((F.col("p_partkey") % 100).alias("s_suppkey")).agg(F.collect_list(F.struct(F.col("p_name").alias("name"), F.lit(None).cast("string").alias("normalized_name"), F.lit(None).cast("string").alias("recipe_search_keyword"), F.col("p_retailprice").cast("string").alias("price"))).alias("menus"), F.array(F.struct(F.collect_set("p_brand").alias("keywords"))).alias("reviews"))
    store = F.struct(F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("name"), F.lit("addr").alias("address_detail"), F.when(F.col("s_nationkey") == 7, "UNKNOWN").otherwise(F.col("s_nationkey").cast("string")).alias("address_cd"), F.col("s_acctbal").cast("string").alias("rating"), F.lit("").alias("canonical_url"))
    given = supplier.join(menus, "s_suppkey").select(store.alias("store"), "menus", "reviews")
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("cd"), F.col("n_name").alias("name"))
    none = lambda fields: spark.createDataFrame([], fields)
    edges = graph_build.restaurant_graph(given, areas, none("keyword string, ingredient string, recipe_url string"), none("menu string, ingredients array<string>"))[1]
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Company|OpenAI' WHEN 1 THEN '' ELSE 'Topic|a,Topic|b,Event|c' END AS kept,
  CASE doc_id % 3 WHEN 0 THEN 'LOW_CONFIDENCE_KEYWORD,LOW_KEYWORD_COUNT' WHEN 1 THEN 'ALL_KEYWORDS_IGNORED' ELSE '' END AS reasons FROM documents""")
def keyword_validation(spark, sf_dir):
    kind = "array<struct<kind: string, name: string, matched: string, confidence: double>>"
    rows = {0: '[{"kind": "Company", "name": "OpenAI", "matched": "x", "confidence": 0.6}, {"kind": "Company", "name": "OpenAI", "matched": "y", "confidence": 0.9}, {"kind": "Topic", "name": " ", "matched": "x", "confidence": 0.9}]', 1: '[{"kind": "Ignore", "name": "n", "matched": "x", "confidence": 0.9}]', 2: '[{"kind": "Topic", "name": "a", "matched": "x", "confidence": 0.9}, {"kind": "Topic", "name": "b", "matched": "x", "confidence": 0.8}, {"kind": "Event", "name": "c", "matched": "x", "confidence": 0.75}]'}
    given = F.coalesce(*[F.when(F.col("doc_id") % 3 == k, F.from_json(F.lit(v), kind)) for k, v in rows.items()])
    made = table(spark, sf_dir, "documents").select("doc_id", records.validated(given, F.lit(50), F.array().cast("array<string>")).alias("v"))
    return made.select("doc_id", F.array_join(F.transform("v.kept", lambda k: F.concat_ws("|", k["kind"], k["name"])), ",").alias("kept"), F.array_join("v.review_reasons", ",").alias("reasons"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '2000-01-01'")
def valid_tokens(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP_NTZ '2000-01-01 00:00:00'").select("o_orderkey")


@query("""WITH s AS (SELECT c_nationkey AS uid, 'google' AS provider, max(c_name) AS email FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), t AS (SELECT s_nationkey AS uid, 'google' AS provider, min(s_name) AS email FROM supplier GROUP BY 1)
SELECT coalesce(s.uid, t.uid) AS uid, 'google' AS provider, coalesce(s.email, t.email) AS email FROM t FULL JOIN s USING (uid, provider)""")
def social_upsert(spark, sf_dir):
    source = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").groupBy(F.col("c_nationkey").alias("uid")).agg(F.max("c_name").alias("email")).withColumn("provider", F.lit("google"))
    target = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("uid")).agg(F.min("s_name").alias("email")).withColumn("provider", F.lit("google"))
    return U.merge(target, source, ["uid", "provider"], keep_on_null=True)


@query("""SELECT 'post-' || c_nationkey || '-' || c_custkey AS marker, coalesce(c_mktsegment, 'etc') AS category, n AS comments FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def list_projection(spark, sf_dir):
    comments = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.size(F.collect_list("o_orderkey")).cast("long").alias("comments"))
    both = table(spark, sf_dir, "customer").filter("c_acctbal > 0").join(comments, F.col("c_custkey") == F.col("o_custkey"))
    return both.select(F.format_string("post-%d-%d", "c_nationkey", "c_custkey").alias("marker"), F.coalesce("c_mktsegment", F.lit("etc")).alias("category"), "comments")


QUERIES, ORACLES = registry.queries, registry.oracles
