"""Records, posts and graph builds on small tables."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.models import batched, hash_embedder, label, lexicon_scorer
from millrace.operators import graph_build, grouping, posts, records
from millrace.schemas import FAIL_RECORD


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("대파 1대", "대파"), ("고춧가루 2큰술", "고춧가루"), ("물 약간", "물"), ("소금 1/2 컵 조금", "소금"), (None, None), ("설탕", "설탕")])
def test_ingredient_name(spark, given, wanted):
    assert value(spark, records.ingredient_name(F.lit(given).cast("string"))) == wanted


def test_image_alts(spark):
    fields = "k string, reviews array<struct<ordered_menus: array<string>, review_images: array<string>>>"
    given = spark.createDataFrame([("s", [([" a ", "b", "a"], ["u1", "u2"]), (["c"], ["u1"]), ([], ["u9"]), (None, None)]), ("t", None)], fields)
    menus = records.image_menus(given, "k", "reviews")
    assert sorted((r["url"], r["menus"]) for r in menus.collect()) == [("u1", ["a", "b", "c"]), ("u2", ["a", "b"])]
    images = spark.createDataFrame([("s", "g1", "u1"), ("s", "g1", "u3"), ("s", "g2", "u2"), ("s", "g2", "u1"), ("s", None, "u4")], "k string, g string, url string")
    made = {(r["g"], r["url"]): (r["alt"], r["alt_source"]) for r in records.image_alts(images, "k", "g", menus).collect()}
    assert made["g1", "u3"] == ("a, b, c", "review_image_url_group") and made["g2", "u2"] == ("a, b", "review_image_url") and made[None, "u4"][1] is None


def test_retry_targets(spark):
    row = lambda ref, data: ("b", 1, "s", "store", "e", ref, "fail", "TIMEOUT", 0, None, "", data)
    given = spark.createDataFrame([row({"address_name": "서울", "shop_name": "가"}, None), row({}, '{"metadata": {"entity_ref": {"address_name": "부산"}}}'), row({"shop_name": "x"}, None)], FAIL_RECORD)
    made = records.target_items(records.retry_targets(given).withColumn("url", F.lit(None).cast("string")))
    assert sorted((r["address"], r["search_query"], r["is_retry"]) for r in made.collect()) == [("부산", "부산", True), ("서울", "서울 가", True)]


def test_models(spark):
    rows = spark.createDataFrame([(1, " a "), (2, "a"), (3, None), (4, "bb")], "id int, url string")
    length = batched(lambda: lambda texts: [len(t) for t in texts], "int")
    made = {r["id"]: r["n"] for r in records.once_each(rows, F.col("url"), length, "n").collect()}
    assert made == {1: 1, 2: 1, 3: None, 4: 2}
    assert value(spark, label(lexicon_scorer(("좋",), ("싫",))(F.lit("싫다")))) == "negative" and value(spark, label(lexicon_scorer(("좋",), ("싫",))(F.lit("그냥")))) == "positive"
    assert value(spark, hash_embedder(4)(F.lit("a b"))) == value(spark, hash_embedder(4)(F.lit("B, A")))


def test_posts(spark):
    clean = lambda t: value(spark, posts.cleaned(F.lit(t)))
    assert clean("<think>x</think>답변: 본문: 맛있다") == "맛있다" and clean("a https://a.test/x b") == "a  b" and clean("a https://atest.kr/x") == "a https://atest.kr/x"
    assert clean("글자수와 키워드\n남는 줄") == "남는 줄"
    full = value(spark, posts.with_required(F.lit("p"), F.lit("http://i"), F.lit("<a>l</a>")))
    assert full == 'p\n\n<img src="http://i" alt="" />\n\n<a>l</a>' and value(spark, posts.with_required(F.lit(full), F.lit("http://i"), F.lit("<a>l</a>"))) == full
    assert value(spark, posts.script_statements(F.lit("a;\n b ;;"))) == ["a", "b"]


def test_grouping(spark):
    counts = spark.createDataFrame([("s", "국물 깊다", 2, 1.0), ("s", "국물 진하다", 1, 0.5), ("s", "친절", 1, 0.9), ("s", "친절해요", 3, 2.0), ("t", "국물", 1, 1.0)], "scope string, keyword string, batch_count long, score_sum double")
    from millrace.models import word_tokenizer

    made = {(r["scope"], r["representative"]): (r["keywords"], r["batch_count"]) for r in grouping.group_keywords(counts, "scope", {}, word_tokenizer).collect()}
    assert made["s", "국물 진하다"] == ("국물 깊다,국물 진하다", 3) and made["s", "친절해요"] == ("친절,친절해요", 4) and made["t", "국물"] == ("국물", 1)


def test_grouping_like_a_plain_loop():
    """Every keyword against every group in turn: canonical words, shared words, containment, nearest centre."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(30)] + ["x" * 30, "y" + "x" * 40, "xx" * 13]
    rows = []
    for n in range(300):
        words = rng.sample(stems, rng.choice([0, 1, 1, 2]))
        rows.append(SimpleNamespace(keyword=f"k{n:03}", words=words, canonicals=[w for w in words if w.startswith("a")][:1], vector=[rng.gauss(0, 1) for _ in range(3)], batch_count=1, score_sum=1.0))
    plain = []
    for row in rows:
        words, canonicals, v = set(row.words), set(row.canonicals), np.array(row.vector)
        held = lambda g: any(x != y and min(len(x), len(y)) >= 2 and (x in y or y in x) for x in words for y in g["words"])  # noqa: E731, B023
        far = lambda g: 1 - v @ g["total"] / (np.linalg.norm(v) * np.linalg.norm(g["total"]))  # noqa: E731, B023
        hit = next((g for test in (lambda g: canonicals & g["canonicals"], lambda g: words & g["words"], held) for g in plain if test(g)), None)  # noqa: B023
        if not hit:
            near = [(far(g), k) for k, g in enumerate(plain) if far(g) <= (grouping.NEAR_STRICT if words and g["words"] else grouping.NEAR)]
            hit = plain[min(near)[1]] if near else None
        if not hit:
            hit = {"keywords": [], "words": set(), "canonicals": set(), "total": np.zeros(3)}
            plain.append(hit)
        hit["keywords"].append(row.keyword)
        hit["words"] |= words
        hit["canonicals"] |= canonicals
        hit["total"] = hit["total"] + v
    groups = grouping.Groups()
    for row in rows:
        groups.add(row)
    assert groups.keywords == [g["keywords"] for g in plain] and len(plain) > 3


def test_news_graph(spark):
    rows = spark.createDataFrame([("g_1", "OpenAI GPT update improves cloud security", "with Microsoft and Kubernetes", "u", "2026-05-20 10:00:00")], "thread string, title string, content string, article_url string, created_at string")
    nodes, edges = graph_build.news_graph(rows)
    assert sorted((r["type"], r["dst"]) for r in edges.collect()) == [("DESCRIBES_EVENT", "update"), ("MENTIONS", "cloud"), ("MENTIONS", "security"), ("MENTIONS_COMPANY", "microsoft"), ("MENTIONS_COMPANY", "openai"), ("MENTIONS_TECH", "gpt"), ("MENTIONS_TECH", "kubernetes")]
    assert nodes.filter("label = 'Article'").first()["published_at"] == "2026-05-20T10:00:00"
    kept = graph_build.keyword_edges(spark.createDataFrame([("a", [("Technology", "GPT"), ("Person", "x")])], "article_id string, keywords array<struct<kind: string, name: string>>"))
    assert [(r["type"], r["dst"]) for r in kept.collect()] == [("MENTIONS_TECH", "GPT")]
    concepts = spark.createDataFrame([("판교", "c1")], "name string, key string")
    assert graph_build.concept_edges(spark.createDataFrame([("Area", "k", "판 교")], "label string, key string, name string"), concepts).first()["dst"] == "c1"


def test_restaurant_graph(spark):
    store = "struct<entity_id: string, name: string, address_detail: string, address_cd: string, rating: string, canonical_url: string>"
    menu = "array<struct<name: string, normalized_name: string, recipe_search_keyword: string, price: string>>"
    given = spark.createDataFrame([(("e", "가", "주소", "LA01", "x", ""), [("짜장", None, None, "9000"), ("짜장", "짜장면", None, "1"), ("짬뽕", "짬뽕", "짬뽕", None)], [(["맛집", " 맛집 "],)]), (("e2", None, None, None, None, None), [], [])], f"store {store}, menus {menu}, reviews array<struct<keywords: array<string>>>")
    areas = spark.createDataFrame([("LA01", "서울")], "cd string, name string")
    recipes = spark.createDataFrame([("짬뽕", "오징어", "u")], "keyword string, ingredient string, recipe_url string")
    fallback = spark.createDataFrame([("짜장", ["면"])], "menu string, ingredients array<string>")
    nodes, edges, bad = graph_build.restaurant_graph(given, areas, recipes, fallback)
    found = {(r["src"], r["type"], r["dst"]) for r in edges.collect()}
    assert found == {("가|주소", "LOCATED_IN", "LA01"), ("가|주소", "SELLS", "짜장"), ("가|주소", "SELLS", "짬뽕"), ("가|주소", "HAS_TAG", "맛집"), ("짬뽕", "CONTAINS", "오징어"), ("짜장", "CONTAINS", "면")}
    assert bad.first()["entity_id"] == "e2" and nodes.filter("key = '가|주소'").first()["rating"] is None
    both = graph_build.merged([(nodes, edges), (nodes.withColumn("name", F.lit("later")), edges)])
    assert both.nodes.filter("key = 'LA01'").first()["name"] == "later" and both.edges.count() == 6


def test_snapshots_of_a_busy_place(spark):
    from millrace.operators import lookups

    shops = spark.range(20_000).select((F.col("id") + 5).alias("shop_id"), F.lit(1).cast("long").alias("map_id"))
    maps = spark.createDataFrame([(1, "a b", "street")], "map_id long, name string, address string")
    visits = spark.range(50_000).select(F.lit(1).cast("long").alias("map_id"), F.lit("http://v/1").alias("article_url"), F.col("id").alias("created_at"))
    wanted = spark.createDataFrame([("http://v/1",), ("ab|street",), ("none",)], "dedup_key string").crossJoin(spark.range(1000)).select("dedup_key")
    made = lookups.snapshots(wanted, shops, maps, visits)  # a billion rows, if all shops met all visits
    assert sorted(tuple(r) for r in made.collect()) == [("ab|street", 5, 49_999, "http://v/1"), ("http://v/1", 5, 49_999, "http://v/1")]
