"""Restaurant records: profile pages, reviews, photos, normalisation, recipe targets, and the run over all stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages, stores
from ..operators import dictionaries as D
from ..operators import records, reports
from . import restaurant
from .base import Registry, table
from .scalar_queries import MENTIONS, sql_names

registry = Registry()
query = registry.query

PROFILE = """concat('<html><head><meta name="description" content="About ', s_name, '"><script type="application/ld+json">{"name": "LD ', s_suppkey, '", "address": {"streetAddress": "Road ', s_suppkey,
 '"}, "geo": {"latitude": "', s_nationkey, '.5", "longitude": "7"}, "aggregateRating": {"ratingValue": "3.5"}, "telephone": "T', s_suppkey, '"}</script></head><body>',
 CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('<h1 class="big tit">', s_name, '</h1>') END,
 '<a class="btxt category-0">c', s_nationkey, '</a><a href="#" class="category-1 btxt">d &amp; e</a>',
 CASE WHEN s_suppkey % 4 = 0 THEN concat('<li class="locat"><a href="/list.dc?query=A%20B">x</a><span>F', s_nationkey, '</span></li>') ELSE '' END,
 CASE WHEN s_suppkey % 2 = 0 THEN concat('<li class="tel">02-', s_suppkey, '</li>') ELSE '' END, '<li class="char"><a>k', s_nationkey, '</a><a> </a><a>z</a></li>',
 CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('<p id="lbl_review_point"><strong>', s_suppkey % 5, '.5</strong>점</p>') END,
 '<span class="review-count">(', s_nationkey, '건)</span><p class="open-status">open</p><p class="hour_date">Mon</p><p class="hour_time">9-', s_nationkey, '</p><p class="hour_date">Tue</p><p class="hour_time closed">off</p><p class="hour_date">Wed</p>',
 '<ul class="app-graph"><li><i class="score-number">5</i><p class="btxt">good</p><p class="score-count">', s_suppkey, '명</p></li><li><i class="score-number">4</i></li></ul>',
 '<div class="eval-item"><b class="category-name">taste</b><b class="category-score">4.', s_suppkey % 10, '</b><div class="eval-bar-item"><i class="bar-label">best</i><i class="bar-percent">', s_nationkey, '%</i></div></div>',
 '<p class="cate" id="keyword_preview_1" data-index="1"><span>date <b>', s_nationkey, '</b></span><span>none</span></p><a href="/profile.php?rid=r-', s_suppkey, '">x</a></body></html>')"""


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'LD ' || s_suppkey ELSE s_name END AS name, 'c' || s_nationkey || ',d & e' AS categories, 'About ' || s_name AS description,
  CASE WHEN s_suppkey % 4 = 0 THEN 'A B F' || s_nationkey ELSE 'Road ' || s_suppkey END AS full_address, CASE WHEN s_suppkey % 2 = 0 THEN '02-' || s_suppkey ELSE 'T' || s_suppkey END AS telephone,
  CAST(s_nationkey + 0.5 AS DOUBLE) AS latitude, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 3.5 ELSE s_suppkey % 5 + 0.5 END AS DOUBLE) AS rating, s_nationkey AS review_count, 'k' || s_nationkey || ',z' AS char_keywords,
  'open Mon=9-' || s_nationkey || ' Tue=off!' AS hours, '5 good ' || s_suppkey AS scores, 'taste 4.' || s_suppkey % 10 || ' best ' || s_nationkey || '%' AS evaluation, '1 date ' || s_nationkey AS stats, 'https://p.test/?rid=r-' || s_suppkey AS canonical_url FROM supplier""")
def store_profile(spark, sf_dir):
    """The fields of a page a supplier; half of the pages lack elements that JSON-LD then fills."""
    p = table(spark, sf_dir, "supplier").select("s_suppkey", stores.profile(F.expr(PROFILE), F.lit("P"), F.lit("https://p.test/?rid=")).alias("p"))
    day = lambda d: F.concat(d["date"], F.lit("="), d["hours"], F.when(d["is_closed"], "!").otherwise(""))
    hours = F.concat_ws(" ", "p.business_hours.status", F.array_join(F.transform("p.business_hours.weekly", day), " "))
    scores = F.array_join(F.transform("p.score_distribution", lambda s: F.concat_ws(" ", s["score"].cast("int").cast("string"), s["label"], s["count"].cast("string"))), ";")
    evaluation = F.array_join(F.transform("p.detail_evaluation", lambda e: F.concat_ws(" ", e["category"], e["score"].cast("string"), F.array_join(F.transform(e["details"], lambda b: F.concat_ws(" ", b["label"], b["percent"])), ","))), ";")
    stats = F.array_join(F.transform("p.keyword_stats", lambda g: F.concat_ws(" ", g["group_index"], F.array_join(F.transform(g["keywords"], lambda k: F.concat_ws(" ", k["keyword"], k["count"].cast("string"))), ","))), ";")
    plain = ["p.name", "p.description", "p.full_address", "p.telephone", "p.latitude", "p.rating", "p.review_count", "p.canonical_url"]
    return p.select("s_suppkey", *plain, F.array_join("p.categories", ",").alias("categories"), F.array_join("p.char_keywords", ",").alias("char_keywords"), hours.alias("hours"), scores.alias("scores"), evaluation.alias("evaluation"), stats.alias("stats"))


REVIEWS = """concat('<ul class="Restaurant-MenuList"><li data-menu-index="0"><span class="restaurant-menu">M', o_custkey, '</span><p class="restaurant-price">', o_orderkey % 90, ',000원</p></li><li><span class="restaurant-menu">unnumbered</span></li></ul>',
 '<div class="latter-graph-body"><div class="person-grade"><strong>A', o_custkey, '</strong></div><i class="avg_score">4.1</i><i class="rv_cnt">', o_orderkey % 50, '</i><span class="total_score">', o_orderkey % 5, '.5점</span><span class="date">3일 전</span>',
 '<div class="review_contents btxt">one<br>two &lt;', o_orderkey, '&gt;<br/></div><p class="sub_title">맛: <span class="text">good</span></p><p class="ordered_menu_list">m', o_orderkey % 7, ', , n</p><p class="new-keyword_list">k</p>',
 '<i class="btn-gallery-review" data-origin="http://i/', o_orderkey, '"></i><i class="btn-gallery-review" data-origin=""></i></div><div class="latter-graph-body">nobody</div>',
 '<div class="latter-graph-body"><div class="person-grade"><strong>B</strong></div></div>')"""


@query("""
SELECT o_orderkey, 'A' || o_custkey AS author, 'one' || chr(10) || 'two <' || o_orderkey || '>' AS content, CAST(o_orderkey % 5 + 0.5 AS DOUBLE) AS rating, CAST(o_orderkey % 50 AS INTEGER) AS reviews_of_author, 'good' AS taste, 'm' || o_orderkey % 7 || ',n' AS menus, 'http://i/' || o_orderkey AS images, 'M' || o_custkey || '=' || o_orderkey % 90 * 1000 AS offered FROM orders
UNION ALL SELECT o_orderkey, 'B', '', 0.0, 0, NULL, '', '', 'M' || o_custkey || '=' || o_orderkey % 90 * 1000 FROM orders""")
def store_reviews(spark, sf_dir):
    """Reviews and menus of a page an order; a review without an author doesn't count, nor does an item without a number."""
    # a page takes far longer to read than its order: the few parts of a small file are dealt to all cores first
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    page = orders.select("o_orderkey", pages.texts(F.expr(REVIEWS), ("name", "price", "review_count", "rating", "ordered_menus")).alias("t"))
    offered = F.array_join(F.transform(F.transform("t.menus", stores.menu), lambda m: F.concat_ws("=", m["name"], m["price"].cast("string"))), ",")
    each = page.select("o_orderkey", offered.alias("offered"), F.explode("t.reviews").alias("texts"))
    r = each.select("o_orderkey", "offered", stores.review(F.col("texts")).alias("r"))
    return r.select("o_orderkey", "r.author", "r.content", "r.rating", F.col("r.author_stats.review_count").alias("reviews_of_author"), F.col("r.sub_evaluations")["맛"].alias("taste"), F.array_join("r.ordered_menus", ",").alias("menus"), F.array_join("r.review_images", ",").alias("images"), "offered")


@query("""
WITH b AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'food' ELSE 'inside' END AS tab, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ftp://x' ELSE 'http://x/' || o_orderkey % 6 END AS url FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, url ORDER BY tab, o_orderkey) AS r FROM b WHERE starts_with(url, 'http'))
SELECT o_custkey, url, tab AS category, 'n' || o_orderkey AS nickname FROM f WHERE r = 1
UNION ALL SELECT o_custkey, 'http://page/1', 'unknown', 'p' FROM b GROUP BY 1 HAVING count_if(starts_with(url, 'http')) = 0""")
def photo_merge(spark, sf_dir):
    """Photos of all tabs, each address once; the page's own where the tabs have none."""
    k = F.col("o_orderkey")
    photo = F.struct(F.when(k % 5 == 0, "ftp://x").otherwise(F.concat(F.lit("http://x/"), k % 6)).alias("url"), F.concat(F.lit("n"), k).alias("nickname"), F.lit(None).cast("string").alias("date"))
    tabs = table(spark, sf_dir, "orders").groupBy("o_custkey", F.when(k % 2 == 0, "food").otherwise("inside").alias("tab")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", photo.alias("p")))), lambda x: x["p"]).alias("photos"))
    merged = tabs.groupBy("o_custkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tab", "photos")))).alias("tabs"))
    html = F.lit('<div class="photo_box" data-origin="http://page/1" data-nickname="p"></div><div class="photo_box" data-origin="http://page/1" data-nickname="q"></div><div class="photo_box" data-origin="/local"></div>')
    each = merged.select("o_custkey", F.explode(stores.merged_photos(F.col("tabs"), html)).alias("p"))
    return each.select("o_custkey", "p.url", "p.category", "p.nickname")


@query("""
WITH r AS (SELECT l_orderkey AS k, l_suppkey % 5 AS img, l_linenumber AS line, 'm' || l_partkey % 7 AS menu FROM lineitem),
p AS (SELECT DISTINCT k, 'http://i/' || img AS url, menu FROM r),
i AS (SELECT DISTINCT k, 'http://i/' || img AS url, img % 2 AS g FROM r WHERE line % 2 = 1),
s AS (SELECT k, url, string_agg(menu, ', ' ORDER BY menu) AS menus FROM p GROUP BY 1, 2),
j AS (SELECT i.k, i.g, i.url, s.menus FROM i LEFT JOIN s ON s.k = i.k AND s.url = i.url),
one AS (SELECT k, g, max(menus) AS shared FROM j WHERE menus IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT menus) = 1)
SELECT j.k AS l_orderkey, j.url, coalesce(one.shared, j.menus) AS alt, CASE WHEN one.shared IS NOT NULL THEN 'review_image_url_group' WHEN j.menus IS NOT NULL THEN 'review_image_url' END AS alt_source
FROM j LEFT JOIN one ON one.k = j.k AND one.g = j.g""")
def image_alts(spark, sf_dir):
    """Alternative texts of an order's images from the menus of the lines that show them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), F.col("l_partkey") % 7).alias("menu"), (F.col("l_suppkey") % 5).alias("img")).withColumn("url", F.concat(F.lit("http://i/"), "img"))
    review = F.struct(F.array("menu").alias("ordered_menus"), F.array("url").alias("review_images"))
    given = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("menu", review.alias("r")))), lambda x: x["r"]).alias("reviews"))
    images = lines.filter("l_linenumber % 2 = 1").select("l_orderkey", (F.col("img") % 2).alias("g"), "url").distinct()
    return records.image_alts(images, "l_orderkey", "g", records.image_menus(given, "l_orderkey", "reviews")).select("l_orderkey", "url", "alt", "alt_source")


@query(f"""WITH m AS (SELECT {sql_names([(n, a) for n, _, a in D.COMPANIES])} AS companies FROM (SELECT doc_id, {MENTIONS} AS t FROM documents))
SELECT count(*) AS sample_size, count_if(companies <> '') AS matched, count_if(companies = '') AS unmatched FROM m""")
def company_report(spark, sf_dir):
    return reports.match_report(table(spark, sf_dir, "documents").select(F.expr(MENTIONS).alias("t")), D.companies(F.col("t")))


@query("""
WITH c AS (SELECT label, vec_id, CASE WHEN vec_id % 3 = 0 THEN 'drop' ELSE 'keep' END AS decision FROM embeddings),
h AS (SELECT label, decision, 'http://i/' || vec_id || '?a=1&amp;b' AS url, '<figure class="' || decision || '"><img src="http://i/' || vec_id || '?a=1&amp;b" alt="" /><figcaption>' || CASE decision WHEN 'keep' THEN 'imggrp-001' ELSE 'NO_SIMILAR_IMAGE_IN_STORE' END || '</figcaption></figure>' AS card FROM c)
SELECT label, count_if(decision = 'keep') AS n_keep, count_if(decision = 'drop') AS n_drop,
  '<section><h2>' || CASE WHEN label % 3 = 0 THEN 'Store ' || label WHEN label % 3 = 1 THEN 'Shop ' || label ELSE CAST(label AS VARCHAR) END || '</h2>' || string_agg(card, '' ORDER BY decision DESC, url) || '</section>' AS html FROM h GROUP BY 1""")
def image_report(spark, sf_dir):
    label = F.col("label")
    decision = F.when(F.col("vec_id") % 3 == 0, "drop").otherwise("keep")
    images = table(spark, sf_dir, "embeddings").select("label", F.concat(F.lit("http://i/"), "vec_id", F.lit("?a=1&b")).alias("url"), F.lit(None).cast("string").alias("alt"), F.lit("imggrp-001").alias("image_group"), decision.alias("decision"), F.lit("NO_SIMILAR_IMAGE_IN_STORE").alias("reason"))
    return reports.image_cards(images, "label", [F.when(label % 3 == 0, F.concat(F.lit("Store "), label)), F.when(label % 3 == 1, F.concat(F.lit("Shop "), label))])


@query("SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'cheap', count(*) FROM part WHERE p_retailprice < 1000")
def table_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return reports.table_counts({"customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders"), "cheap": part.filter("p_retailprice < 1000")})


@query("""
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_name END AS keyword FROM part WHERE p_partkey % 4 <> 0),
k AS (SELECT keyword, min(p_partkey) AS first_at FROM m WHERE trim(keyword) <> '' GROUP BY 1),
r AS (SELECT p_name AS keyword, 'u' || p_partkey AS url, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS place FROM part)
SELECT k.keyword, first_at, coalesce(place, 0) AS place, url FROM k LEFT JOIN r ON r.keyword = k.keyword AND place <= 3""")
def recipe_targets(spark, sf_dir):
    """Search words of normalised menus in the order of their first mention, with three recipes each at most."""
    part = table(spark, sf_dir, "part")
    menus = part.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_name")).alias("recipe_keyword"), F.when(F.col("p_partkey") % 4 != 0, "NORMALIZED").otherwise("UNKNOWN").alias("status"))
    found = part.select(F.col("p_name").alias("keyword"), F.concat(F.lit("u"), "p_partkey").alias("url"), "p_size", "p_partkey")
    made = restaurant.recipe_targets(menus, "p_partkey", found, ["p_size", "p_partkey"])
    return made.select("keyword", F.col("at").alias("first_at"), F.coalesce("place", F.lit(0)).alias("place"), "url")


def candidates(spark, sf_dir):
    """Customers as collected stores: every eleventh at an unknown address, every seventh without anything to know it by."""
    k = F.col("c_custkey")
    both = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: a constant table
    store = F.struct(F.when(k % 7 != 0, F.concat(F.lit("e"), k)).alias("entity_id"), F.col("c_name").alias("name"), F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "Nowhere 1").otherwise(F.concat("n_name", F.lit(" street "), k)).alias("full_address"), F.lit(None).cast("string").alias("address_cd"), F.lit(None).cast("string").alias("address_detail"), F.col("c_acctbal").alias("rating"), F.when((k % 2 == 0) & (k % 7 != 0), F.concat(F.lit("https://s/"), k)).alias("canonical_url"), F.lit(True).alias("is_active"))
    review = lambda rating: F.struct(F.lit("x").alias("content"), F.lit("a").alias("author"), F.lit("2024-01-01").alias("visited_at"), rating.cast("double").alias("rating"))
    return both.select(F.lit("b").alias("batch_id"), F.lit(1).alias("run_attempt"), F.concat(F.lit("e"), k).alias("entity_id"), store.alias("store"), F.array(F.struct(F.get(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (k % 3).cast("int")).alias("name"), F.lit(1000).alias("price"))).alias("menus"), F.array(review(k % 5), review(F.lit(None))).alias("reviews"), k.alias("c_custkey"))


def codes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("LA"), "n_nationkey").alias("cd"))


STORES = """
WITH c AS (SELECT c_custkey AS k, c_name, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT k, c_name, CASE WHEN k % 11 = 0 THEN 'Nowhere 1' ELSE n_name || ' street ' || k END AS address FROM c WHERE k % 7 <> 0),
x AS (SELECT k, arg_max('LA' || n_nationkey, length(n_name)) AS cd, max(length(replace(n_name, ' ', ''))) AS width FROM d JOIN nation ON starts_with(replace(address, ' ', ''), replace(n_name, ' ', '')) GROUP BY 1)"""


@query(STORES + """
SELECT 'e' || d.k AS entity_id, CASE WHEN d.k % 2 = 0 THEN 'https://s/' || d.k ELSE replace(c_name, ' ', '') || '|' || replace(address, ' ', '') END AS dedup_key, cd AS address_cd, substr(replace(address, ' ', ''), width + 1) AS address_detail,
  2 AS review_count, CAST(d.k % 5 AS DOUBLE) / 2 AS review_rating, d.k % 3 <> 0 AS is_changed, NULL AS reason_code FROM d JOIN x ON x.k = d.k
UNION ALL SELECT 'e' || k, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 7 = 0 THEN 'INVALID_DATA_FORMAT' ELSE 'UNDEFINED_CODE_DETECTED' END FROM c WHERE k % 7 = 0 OR k % 11 = 0""")
def store_normalise(spark, sf_dir):
    """Normalised and failed stores; a third of them stands in the snapshot as it is."""
    given, places = candidates(spark, sf_dir), codes(spark, sf_dir)
    before = restaurant.normalised_with_snapshot(given.filter("c_custkey % 3 = 0"), places)
    good, bad = restaurant.normalise_stores(given, places, before)
    columns = ["entity_id", "dedup_key", "address_cd", "address_detail", "review_count", "review_rating", "is_changed"]
    return good.select(*columns, F.lit(None).cast("string").alias("reason_code")).unionByName(bad.select("entity_id", "reason_code"), allowMissingColumns=True)


@query(STORES + """
SELECT CASE WHEN d.k % 2 = 0 THEN 'https://s/' || d.k ELSE replace(c_name, ' ', '') || '|' || replace(address, ' ', '') END AS dedup_key, c_name AS name, cd AS address_cd, d.k % 3 = 0 AS known_before,
  CASE WHEN d.k % 3 <> 0 THEN CASE d.k % 3 WHEN 1 THEN 'flour,water' ELSE 'rice' END END AS ingredients, CASE WHEN d.k % 3 = 1 THEN 'RECIPE' WHEN d.k % 3 = 2 THEN 'CSV_FALLBACK' END AS source FROM d JOIN x ON x.k = d.k""")
def restaurant_run(spark, sf_dir):
    """The run over all stages: new and changed stores are saved with their menus' ingredients, and the snapshot follows."""
    given, places = candidates(spark, sf_dir), codes(spark, sf_dir)
    first = restaurant.run(given.filter("c_custkey % 3 = 0"), places, None, None, None, None)
    recipes = spark.createDataFrame([("beta", "flour", "u"), ("beta", "water", "u")], "keyword string, ingredient string, recipe_url string")
    fallback = spark.createDataFrame([("gamma", ["rice"])], "menu string, ingredients array<string>")
    second = restaurant.run(given, places, first.stores, first.snapshot, recipes, fallback)
    listed = second.ingredients.groupBy("dedup_key").agg(F.array_join(F.sort_array(F.collect_list("ingredient")), ",").alias("ingredients"), F.min("source").alias("source"))
    known = first.snapshot.select(F.col("dedup_key"), F.lit(True).alias("known"))
    out = second.stores.join(second.snapshot.select("dedup_key"), "dedup_key", "left_semi").join(known, "dedup_key", "left").join(listed, "dedup_key", "left")
    return out.select("dedup_key", "name", "address_cd", F.coalesce("known", F.lit(False)).alias("known_before"), "ingredients", "source")


QUERIES, ORACLES = registry.queries, registry.oracles
