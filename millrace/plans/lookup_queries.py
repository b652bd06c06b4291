"""Rules of single rows and keys over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..sources import lake
from .base import Registry, table
from .lake_queries import place

registry = Registry()
query = registry.query

TIMES = ("HHmmss", "%H%M%S"), ("yyMMddHHmmss", "%y%m%d%H%M%S"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S")


@query("""WITH t AS (SELECT event_type || '_' || event_id AS thread, ts FROM events), p(prefix) AS (VALUES ('click_'), ('error_'), ('view_1'), ('geeknews_'))
SELECT prefix, max(ts) AS latest FROM p LEFT JOIN t ON regexp_matches(thread, '^' || prefix) GROUP BY prefix""")
def prefix_watermarks(spark, sf_dir):
    """The newest time of each service's threads."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", "event_id").alias("thread"), "ts")
    return L.prefix_watermarks(rows, "thread", "ts", ["click_", "error_", "view_1", "geeknews_"])


@query("""
WITH i AS (SELECT 'inserted' AS origin, 0 AS place, o_custkey AS k, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'updated', 1, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 UNION ALL SELECT 'existing', 2, o_custkey, o_orderkey FROM orders)
SELECT k AS o_custkey, id, origin FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place, id) AS n FROM i) WHERE n = 1""")
def id_fallthrough(spark, sf_dir):
    """A customer's id from what was inserted, else updated, else there before."""
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    return L.first_id("o_custkey", [("inserted", o.filter("o_orderstatus = 'O'")), ("updated", o.filter("o_orderstatus = 'F' AND id % 2 = 0")), ("existing", o)])


def places(spark, sf_dir):
    """(shops, maps, visits) from customers, nations and orders."""
    c = table(spark, sf_dir, "customer")
    shops = c.select(F.col("c_custkey").alias("shop_id"), (F.col("c_custkey") % 40).alias("map_id"), F.col("c_mktsegment").alias("shop_cd"))
    n = table(spark, sf_dir, "nation")
    maps = n.select(F.col("n_nationkey").cast("long").alias("map_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey").cast("string")).alias("address"), F.concat(F.lit("C"), "n_regionkey").alias("category_cd"))
    o = table(spark, sf_dir, "orders")
    visits = o.select((F.col("o_custkey") % 23).alias("map_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("http://v/"), F.col("o_orderkey") % 500)).alias("article_url"), F.col("o_orderdate").alias("created_at"))
    return shops, maps, visits


PLACES = """shops AS (SELECT c_custkey AS shop_id, c_custkey % 40 AS map_id, c_mktsegment AS shop_cd FROM customer),
maps AS (SELECT n_nationkey AS map_id, n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_regionkey AS VARCHAR) END AS address, 'C' || n_regionkey AS category_cd FROM nation),
visits AS (SELECT o_custkey % 23 AS map_id, CASE WHEN o_orderkey % 3 > 0 THEN 'http://v/' || (o_orderkey % 500) END AS article_url, o_orderdate AS created_at FROM orders)"""


@query(f"""WITH {PLACES}, t AS (SELECT user_id AS shop_id, CASE WHEN event_id % 3 = 0 THEN 'own' END AS category_cd, ts AS at, event_id FROM events)
SELECT t.shop_id, s.map_id, coalesce(t.category_cd, m.category_cd) AS category_cd, s.shop_cd, t.at AS created_at FROM t JOIN shops s ON s.shop_id = t.shop_id JOIN maps m ON m.map_id = s.map_id""")
def touch_rows(spark, sf_dir):
    """A row that says a shop was looked at, with its codes by way of its map."""
    shops, maps, _ = places(spark, sf_dir)
    touches = table(spark, sf_dir, "events").select(F.col("user_id").alias("shop_id"), F.when(F.col("event_id") % 3 == 0, "own").alias("category_cd"), F.col("ts").alias("at"))
    return L.touch_rows(touches, shops, maps)


@query(f"WITH {PLACES} SELECT m.name, m.address, count(*) AS shops FROM maps m JOIN shops s ON s.map_id = m.map_id WHERE m.category_cd = 'C1' AND s.shop_cd = 'FURNITURE' GROUP BY ALL")
def loaded_keys(spark, sf_dir):
    """Names and addresses of the places that have shops of a kind already."""
    shops, maps, _ = places(spark, sf_dir)
    return maps.filter("category_cd = 'C1'").join(shops.filter("shop_cd = 'FURNITURE'"), "map_id").groupBy("name", "address").agg(F.count("*").alias("shops"))


@query(f"""WITH {PLACES}, w AS (SELECT DISTINCT 'http://v/' || (o_orderkey % 600) AS dedup_key FROM orders UNION SELECT replace(name, ' ', '') || '|' || address FROM maps WHERE map_id % 2 = 0 AND address IS NOT NULL),
f AS (SELECT w.dedup_key, s.shop_id, m.map_id FROM w JOIN maps m ON replace(m.name, ' ', '') || '|' || m.address = w.dedup_key JOIN shops s ON s.map_id = m.map_id
  UNION SELECT w.dedup_key, s.shop_id, m.map_id FROM w JOIN visits v ON v.article_url = w.dedup_key JOIN maps m ON m.map_id = v.map_id JOIN shops s ON s.map_id = m.map_id),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY shop_id) AS n FROM f) WHERE n = 1),
l AS (SELECT map_id, max(created_at) AS last_checked_at, arg_max(article_url, (created_at, article_url)) FILTER (article_url IS NOT NULL) AS article_url FROM visits GROUP BY 1)
SELECT dedup_key, shop_id, last_checked_at, article_url FROM o LEFT JOIN l USING (map_id)""")
def snapshot_lookup(spark, sf_dir):
    """The state of the shop that a dedup key names, by address of an article or by name and address."""
    shops, maps, visits = places(spark, sf_dir)
    named = maps.filter("map_id % 2 = 0 AND address IS NOT NULL").select(L.bare_key(F.col("name"), F.col("address")).alias("dedup_key"))
    wanted = table(spark, sf_dir, "orders").select(F.concat(F.lit("http://v/"), F.col("o_orderkey") % 600).alias("dedup_key")).unionByName(named)
    return L.snapshots(wanted, shops, maps, visits)


@query("""
WITH d AS (SELECT CASE page_id % 3 WHEN 0 THEN 'see ' || url || '/more, or' WHEN 1 THEN 'none' ELSE 'x' || url END AS document, CASE WHEN page_id % 3 = 1 AND page_id % 2 = 0 THEN url END AS image_url FROM pages WHERE page_id % 5 > 0)
SELECT page_id, url FROM pages p WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE contains(document, p.url) OR image_url = p.url)""")
def unheld_images(spark, sf_dir):
    """Images whose address no stored document holds or names."""
    pages = table(spark, sf_dir, "pages")
    document = F.expr("CASE page_id % 3 WHEN 0 THEN concat('see ', url, '/more, or') WHEN 1 THEN 'none' ELSE concat('x', url) END")
    stored = pages.filter("page_id % 5 > 0").select(document.alias("document"), F.when((F.col("page_id") % 3 == 1) & (F.col("page_id") % 2 == 0), F.col("url")).alias("image_url"))
    return L.unheld_urls(pages.select("page_id", "url").filter("url IS NOT NULL"), "url", stored, "document", "image_url")


@query("SELECT o_custkey, count(*) AS review_count, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*)) / 100 AS rating, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS latest_review_at FROM orders GROUP BY 1")
def review_summary(spark, sf_dir):
    """How many reviews a store has, its rating, and when the last visit was, where any is known."""
    visited = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("review_count"), (F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*")) / 100).alias("rating"), F.max(visited).alias("latest_review_at"))


@query("SELECT event_id, " + ", ".join(f"strftime(ts, '{sql}') AS f{k}" for k, (_, sql) in enumerate(TIMES)) + " FROM events")
def time_names(spark, sf_dir):
    """Times as file and batch names write them."""
    return table(spark, sf_dir, "events").select("event_id", *[F.date_format("ts", form).alias(f"f{k}") for k, (form, _) in enumerate(TIMES)])


PAYLOAD = "CASE event_id % 5 WHEN 0 THEN '[' || props || ', 7, \"x\", {\"k\": null}]' WHEN 1 THEN props WHEN 2 THEN '[]' WHEN 3 THEN 'no json' ELSE '[[' || props || '], ' || props || ']' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN (props ->> '$.k') || ',-' WHEN 4 THEN props ->> '$.k' ELSE '' END AS ks FROM events")
def menu_guard(spark, sf_dir):
    """The objects of a payload that should be a list of objects and may be anything."""
    made = L.objects_of(F.expr(PAYLOAD), "k: string")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(made, lambda m: F.coalesce(m["k"], F.lit("-"))), ",").alias("ks"))


@query("""WITH s AS (SELECT o_custkey AS k, list({'keyword': o_orderpriority, 'more': [' ' || o_orderstatus, ''], 'target': o_orderkey % 5 = 0}) AS stats FROM orders GROUP BY 1),
f AS (SELECT k, list_transform(stats, lambda s: list_concat([s.keyword], s.more)) AS names, list_transform(list_filter(stats, lambda s: s.target), lambda s: list_concat([s.keyword], s.more)) AS targets FROM s)
SELECT k AS o_custkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(['own', '  '], flatten(names)), lambda x: trim(x)), lambda x: x <> ''))), ',') AS selected,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(targets), lambda x: trim(x)), lambda x: x <> ''))), ',') AS target FROM f""")
def keyword_sets(spark, sf_dir):
    """The keywords a post may use, and those it is about."""
    item = F.struct(F.col("o_orderpriority").alias("keyword"), F.array(F.concat(F.lit(" "), "o_orderstatus"), F.lit("")).alias("keywords"), (F.col("o_orderkey") % 5 == 0).alias("has_target_keyword"))
    stats = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(item).alias("stats"))
    sets = stats.select("o_custkey", L.keyword_sets(F.array(F.lit("own"), F.lit("  ")), F.col("stats")).alias("s"))
    return sets.select("o_custkey", F.array_join("s.selected", ",").alias("selected"), F.array_join("s.target", ",").alias("target"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_size WHEN p_partkey % 3 = 1 THEN trim(p_brand) ELSE 'unknown_batch' END AS batch FROM part""")
def batch_fallback(spark, sf_dir):
    """A run's batch by its articles, else by its raw rows, else unknown."""
    articles = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.lit("b"), "p_size"))).otherwise(F.array().cast("array<string>"))
    raw = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit(None).cast("string"), F.lit("  "), F.concat(F.lit(" "), "p_brand"), F.lit("late"))).otherwise(F.array(F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", L.batch_of(articles, raw).alias("batch"))


@query("""WITH k AS (SELECT o_custkey, list({'name': o_orderpriority, 'order': o_orderkey} ORDER BY o_orderkey) AS keywords FROM orders GROUP BY 1)
SELECT o_custkey, '{"article_id":' || o_custkey || ',"keywords":[' || array_to_string(list_transform(keywords, lambda k: '{"name":"' || k.name || '","order":' || k.order || '}'), ',') || '],"keyword_count":' || len(keywords) || '}' AS record FROM k""")
def record_json(spark, sf_dir):
    """An article's record as JSON, with the number of its keywords."""
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("name")))).alias("keywords"))
    named = F.transform("keywords", lambda k: F.struct(k["name"].alias("name"), k["order"].alias("order")))
    return each.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("article_id"), named.alias("keywords"), F.size("keywords").alias("keyword_count"))).alias("record"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'unclear' WHEN l_discount >= l_tax AND l_discount >= 0.05 THEN 'restaurant' WHEN l_tax >= 0.05 THEN 'it_news' ELSE 'mixed' END AS domain,
  CASE WHEN l_linenumber < 7 THEN greatest(l_discount, l_tax, 0.05) END AS confidence FROM lineitem""")
def assisted_domain(spark, sf_dir):
    """The surest of the domains that an assistant offers; without any the question stays unclear."""
    offered = F.array(*[F.struct(F.lit(name).alias("value"), value.alias("confidence")) for name, value in (("restaurant", F.col("l_discount")), ("it_news", F.col("l_tax")), ("mixed", F.lit(0.05)))])
    best = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.surest(F.when(F.col("l_linenumber") < 7, offered).otherwise(F.slice(offered, 1, 0))).alias("b"))
    return best.select("l_orderkey", "l_linenumber", F.coalesce("b.value", F.lit("unclear")).alias("domain"), F.col("b.confidence").alias("confidence"))


@query("SELECT c_custkey::VARCHAR AS address_cd, c_mktsegment AS category_cd, 'say \"' || c_name || '\", twice' AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def seed_candidates(spark, sf_dir):
    """The rows of a quoted seed file with a header that have the category wanted."""
    path = place(spark, "seed")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address_cd"), F.col("c_mktsegment").alias("category_cd"), F.concat(F.lit('say "'), "c_name", F.lit('", twice')).alias("name"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return lake.seed_rows(spark, path, "address_cd string, category_cd string, name string").filter("category_cd = 'BUILDING'")


QUERIES, ORACLES = registry.queries, registry.oracles
