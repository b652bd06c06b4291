"""Store pages, reports, the restaurant run, merge guard, and bucketed upserts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import pages, stores
from millrace.operators import components, keywords, merging, relational, reports
from millrace.plans import restaurant, store_queries
from millrace.streaming import ingest


def one(spark, column, html):
    return spark.createDataFrame([(html,)], "h string").select(column(F.col("h")).alias("x")).first()["x"]


def test_profile_without_anything(spark):
    made = one(spark, lambda h: stores.profile(h, F.lit("P"), F.lit("u=")), "<html></html>")
    assert (made["name"], made["rating"], made["latitude"], made["canonical_url"], made["business_hours"]["weekly"]) == ("Unknown", 0.0, 0.0, "", [])
    hidden = one(spark, lambda h: stores.profile(h, F.lit("P"), F.lit("u=")), '<input type="hidden" id="hdn_lat" value="1.5"><input id="hdn_lng" value="x">')
    assert (hidden["latitude"], hidden["longitude"]) == (1.5, 0.0)


def test_reviews_and_photos(spark):
    html = '<div class="latter-graph-body"><p class="person-grade"><strong>A</strong></p><p class="sub_title">가격: <span class="text">ok</span></p><p class="sub_title">none</p></div><div class="x latter-graph-body y"><p class="person-grade"><strong> B </strong></p></div>'
    made = one(spark, stores.reviews, html)
    assert [r["author"] for r in made] == ["A", "B"] and made[0]["sub_evaluations"] == {"가격": "ok"} and made[1]["ordered_menus"] == []
    photos = one(spark, stores.page_photos, '<i class="photo_box" data-date="d" data-origin="http://a"></i><i data-origin="http://b" class="photo_box"></i><i class="photo_box" data-origin="x"></i><i class="photo_box" data-origin="http://a"></i>')
    assert [(p["url"], p["date"]) for p in photos] == [("http://a", "d"), ("http://b", "")]


def test_zip_stops_at_the_shorter(spark):
    pairs = spark.range(1).select(stores.zipped(("a", "b"), F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit("x"), F.lit("y"))).alias("x")).first()["x"]
    assert [tuple(p) for p in pairs] == [(1, "x"), (2, "y")]


def test_reports(spark):
    rows = spark.createDataFrame([(["a"],), ([],), (None,)], "names array<string>")
    assert tuple(reports.match_report(rows, F.col("names")).first()) == (3, 1, 2)
    assert spark.range(1).select(reports.markdown_line(F.lit(1), F.lit("a|b"), F.lit(None)).alias("x")).first()["x"] == "| 1 | a\\|b |  |"
    assert [r["id"] for r in reports.at_edge(spark.range(5))] == [0, 1, 2, 3, 4]
    cards = reports.image_cards(spark.createDataFrame([("s", None, None, None, "drop", "R<"), ("s", "u", "a", "g", "keep", None)], "k string, url string, alt string, image_group string, decision string, reason string"), "k", [F.lit(" ")]).first()
    assert cards["html"].startswith('<section><h2>s</h2><figure class="keep">') and "R&lt;" in cards["html"] and (cards["n_keep"], cards["n_drop"]) == (1, 1)


def test_restaurant_run_without_side_tables(spark, sf_dir):
    given, codes = store_queries.candidates(spark, sf_dir), store_queries.codes(spark, sf_dir)
    images = spark.createDataFrame([("https://s/2", "u1", [1.0, 0.0])], "dedup_key string, url string, embedding array<double>")
    first = restaurant.run(given, codes, None, None, None, None, images)
    again = restaurant.run(given, codes, first.stores, first.snapshot, None, None)
    assert first.ingredients.count() == 0 and first.images.first()["decision"] == "drop"
    assert again.normalised.filter("is_changed").count() == 0 and again.stores.count() == first.stores.count() > 50


FIELDS = "a struct<predicates: array<string>, actions: array<string>, nouns: array<string>, topics: array<string>>, b struct<predicates: array<string>, actions: array<string>, nouns: array<string>, topics: array<string>>"


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        (([], [], [], []), (["p"], [], [], []), True),
        ((["p"], [], [], []), (["p"], [], [], []), True),
        ((["p"], [], [], []), (["q"], [], [], []), False),
        ((["p"], ["go"], [], []), (["p"], [], [], []), False),
        ((["p"], ["go"], [], []), (["q"], ["go"], [], []), True),
        (([], [], ["noodle"], ["noodle"]), ([], [], ["soup"], ["soup"]), False),
        (([], [], ["noodle"], ["noodle"]), (["good"], [], [], []), False),
        (([], [], ["noodle"], ["noodle"]), (["good"], [], ["noodles"], []), True),
        (([], [], ["noodle"], ["noodle"]), (["good"], [], ["noodle"], ["noodle"]), True),
    ],
)
def test_merge_guard(spark, a, b, wanted):
    assert spark.createDataFrame([(a, b)], FIELDS).select(merging.may_merge(F.col("a"), F.col("b")).alias("x"), merging.may_merge(F.col("b"), F.col("a")).alias("y")).first() == (wanted, wanted)


def test_core_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(24)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    assert sorted(tuple(r) for r in components.k_core(chain, 2).collect()) == [(100, 101), (100, 102), (101, 102)]


def test_checked_sides_and_hot_keys(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 400 THEN 'hot' ELSE concat('k', id % 100) END AS key")
    table = rows.groupBy("key").count().withColumnRenamed("count", "n")
    for small in (5, 1000):
        assert relational.hot_join(rows, table, ["key"], "n", small=small, hot=100).count() == 1000
    wide = spark.range(10).select(F.repeat(F.lit("x"), 300_000).alias("a"))
    assert relational.small_side(wide, 100, megabytes=1) is wide and relational.small_side(wide, 5) is wide and relational.small_side(wide, 100) is not wide


def test_draws_are_fair(spark):
    rows = spark.range(4000).selectExpr("id", "'s' AS scope")
    taken = {r["id"] for r in keywords.reservoir(rows, F.col("id"), 1000, "x").collect()}
    assert len(taken) == 1000 and 400 < sum(k < 2000 for k in taken) < 600
    heavy = keywords.weighted_sample(rows, "scope", F.col("id"), F.when(F.col("id") < 400, 100.0).otherwise(1.0), 100).filter("id < 400").count()
    assert heavy > 75


def test_upserts_by_buckets(spark, tmp_path):
    """Batches come one after another; untouched buckets keep their version, and old versions go."""
    rng, out, state, source, known = random.Random(1), f"{tmp_path}/out", f"{tmp_path}/state", tmp_path / "in", {}
    source.mkdir()
    for step in range(4):
        rows = [(rng.randrange(30) if step < 3 else 7, step * 100 + k, float(k)) for k in range(20 if step < 3 else 1)]
        known.update({k: (n, v) for k, n, v in rows})
        spark.createDataFrame(rows, "k long, n long, v double").coalesce(1).write.mode("append").parquet(f"{source}/b{step}")
        stream = spark.readStream.schema("k long, n long, v double").option("recursiveFileLookup", "true").parquet(str(source))
        ingest.upsert(stream, ["k"], "n", out, state, buckets=8)
        made = {r["k"]: (r["n"], r["v"]) for r in ingest.newest(spark, out).collect()}
        assert made == known
    assert len(ingest.folders(spark, out, "list")) == 2 and len(set(ingest.versions(spark, out, 9).values())) > 1


def test_a_text_is_computed_once(spark):
    """The expression under a text stands once in the plan, however it is nested: nullif() inside arrays doubles it."""
    made = spark.range(1).select(F.transform(F.array(F.lit("<b>4.5</b>")), lambda x: stores.number(stores.first_text(x, "b"))).alias("n"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("(.*?)</b>") == 1 and "nullif" not in plan
    assert made.first()["n"] == [4.5]
    assert spark.range(1).select(stores.filled_or_null(F.lit("")).alias("a"), stores.filled_or_null(F.lit(None).cast("string")).alias("b")).first()[:] == (None, None)


ODD_PAGES = [
    None,
    "",
    "no markup > at < all",
    '<UL CLASS="x Restaurant-MenuList"><li data-menu-index="1"><SPAN class="restaurant-menu">a &amp;amp;\n b</SPAN></li><li class="c" data-menu-index="2"><p class="restaurant-price">1</p></li></ul><ul class="Restaurant-MenuList"><li data-menu-index="3"><span class="restaurant-menu">z</span></li></ul>',
    '<div class="latter-graph-body"><p class="person-grade"><strong>﷐A</strong><i class="xrv_cnt">1</i><i class="rv_cnt2">2</i><i class="a rv_cnt b">3</i><i class="rv_cnt">4</i><i data-origin="u" class="btn-gallery-review"><div class="btxt c review_contents"> x<BR>\t y </div>',
    '<div class="latter-graph-body">nobody<div <div class="latter-graph-body"><p class="person-grade"><strong class="s"> </strong></p></div><div id="1" class="latter-graph-body"><b class="person-grade"><strong>B</strong><p class="sub_title">k:<span class="text"> </span></p><p class="sub_title">l <span class="text">v</span></p>',
]


def test_pages_are_read_by_batches(spark):
    """What is found on odd pages, alone or together, and with characters that serve as marks elsewhere."""
    html = pa.array(ODD_PAGES)
    made = pages.read(html, pages.FIELDS)
    assert made.to_pylist() == pages.read(html, pages.FIELDS, at_once=1).to_pylist() == [pages.read(html.slice(k, 1), pages.FIELDS)[0].as_py() for k in range(len(html))]
    assert len(pages.read(html.slice(0, 0), pages.FIELDS)) == 0 and "﷐" not in pages.marks(html)
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(ODD_PAGES)], "k int, h string")
    read = rows.select("k", stores.menus(F.col("h")).alias("m"), stores.reviews(F.col("h")).alias("r")).orderBy("k").collect()
    assert [r["m"] and [tuple(m) for m in r["m"]] for r in read] == [None, [], [], [("a &amp; b", 0, "", "1")], [], []]
    assert [r["r"] and [x["author"] for x in r["r"]] for r in read] == [None, [], [], [], ["﷐A"], ["B"]]
    first, second = read[4]["r"][0], read[5]["r"][0]
    assert (first["author_stats"]["review_count"], first["review_images"], first["content"]) == (3, ["u"], "x\ny") and second["sub_evaluations"] == {"l": "v"}
    some = rows.select(pages.texts(F.col("h"), ["rating"]).alias("t")).selectExpr("explode(t.reviews) AS r").collect()
    assert [(x["r"]["author"], x["r"]["review_count"]) for x in some] == [("﷐A", None), ("B", None)]


def test_a_page_is_read_once(spark, sf_dir):
    """One pass over the pages yields menus and reviews: none of Java's expressions runs through a page, nor again for each review."""
    plan = store_queries.store_reviews(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and "split(" not in plan
