"""Operators on small tables, with the values that the specification gives."""

import pytest
from pyspark.sql import functions as F

from millrace.models import EchoClient, batched, hash_scorer
from millrace.operators import components as C
from millrace.operators import keywords as K
from millrace.operators import nlq, similarity, spans
from millrace.operators import relational as R
from millrace.operators import upserts as U
from millrace.operators.graph import Graph, merge_edges, merge_nodes
from millrace.plans import pipelines
from millrace.schemas import ANALYSIS


def table(spark, rows, fields):
    return spark.createDataFrame(rows, fields)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_one_to_one(spark):
    shops = table(spark, [(100, 1, "S01"), (200, 2, "S02"), (200, 3, "S03")], "map_id long, shop_id long, shop_cd string")
    crawl = table(spark, [(1, 100), (2, None), (3, 200), (4, 999)], "crawling_id long, map_id long")
    made = R.one_to_one(crawl, shops, "map_id", ["shop_id", "shop_cd"])
    assert rows(made, "crawling_id", "match_status") == [(1, "matched"), (2, "not_found"), (3, "ambiguous"), (4, "not_found")]
    assert rows(made.filter("match_status = 'matched'"), "crawling_id", "shop_id", "shop_cd") == [(1, 1, "S01")]


def test_keep_by_and_new_rows(spark):
    given = table(spark, [("t", 1, "first"), ("t", 2, "second"), ("u", 1, None)], "thread string, seq int, title string")
    assert rows(R.keep_by(given, ["thread"], F.col("seq")).fillna(""), "thread", "title") == [("t", "second"), ("u", "")]
    known = table(spark, [("t",)], "thread string")
    assert rows(R.new_rows(given.union(table(spark, [(None, 3, "x")], given.schema)), known, ["thread"]).fillna("-"), "thread") == [("-",), ("u",)]


def test_longest_prefix(spark):
    codes = table(spark, [("서울", "LA01"), ("서울 강남", "LA02"), ("부산", "LA03")], "name string, cd string")
    places = table(spark, [("서울강남 역삼동 1",), ("서울 중구",), ("제주",)], "address string")
    assert rows(R.longest_prefix(places, "address", codes, "name", "cd"), "address", "matched_code", "remainder") == [("서울 중구", "LA01", "중구"), ("서울강남 역삼동 1", "LA02", "역삼동1")]


def test_global_rank_matches_a_single_window(spark):
    given = spark.range(1000).select((F.col("id") * 37 % 101).alias("v"), "id")
    made = R.global_rank(given, "v", [F.col("v"), F.col("id")], parts=7)
    order = sorted((r["v"], r["id"]) for r in given.collect())
    assert [(r["v"], r["id"]) for r in made.orderBy("rank").collect()] == order and made.agg(F.max("rank")).first()[0] == 1000
    assert R.global_rank(given.limit(0), "v", [F.col("v")]).count() == 0


def test_merge_modes(spark):
    old = table(spark, [(1, "a", 1), (2, "b", 2)], "id long, s string, n int")
    new = table(spark, [(2, None, 5), (3, "c", None)], "id long, s string, n int")
    assert rows(U.merge(old, new, ["id"], keep_on_null=True), "id", "s", "n")[1] == (2, "b", 5)
    assert [tuple(r) for r in U.merge(old, new, ["id"], keep_on_null=False).orderBy("id").collect()] == [(1, "a", 1), (2, None, 5), (3, "c", None)]
    assert U.merge(old.limit(0), new, ["id"], keep_on_null=True).count() == 2


def test_find_or_fill(spark):
    old = table(spark, [(7, "x", None, " "), (8, "y", 1, "C")], "id long, name string, area int, code string")
    new = table(spark, [("x", None, "F"), ("z", 2, "G")], "name string, area int, code string")
    made = U.find_or_fill(old, new, ["name", "area"], ["code"], "id")
    assert sorted((r["id"], r["code"], r["write_action"]) for r in made.collect()) == [(7, "F", "filled"), (8, "C", "kept"), (9, "G", "inserted")]


def test_content_hash_and_changes(spark):
    now = table(spark, [("k", " a  b ", None), ("n", "x", "")], "key string, s string, t string").select("key", U.content_hash(["s", "t"]).alias("h"))
    before = table(spark, [("k", "a b", "")], "key string, s string, t string").select("key", U.content_hash(["s", "t"]).alias("h"))
    assert sorted(tuple(r)[0:1] + tuple(r)[2:] for r in U.changes(now, before, "key", ["h"]).collect()) == [("k", False, False), ("n", True, True)]


def test_image_groups(spark):
    images = table(spark, [("s", "a", [1.0, 0.0, 0.0]), ("s", "b", [0.8, 0.2, 0.0]), ("s", "e", [0.7, 0.3, 0.0]), ("s", "c", [0.0, 1.0, 0.0]), ("s", "d", [0.0, 0.0, 1.0]), ("s", "f", None), ("t", "g", [1.0, 0.0, 0.0]), ("t", "h", [1.0, 0.0, 0.0])], "store string, url string, v array<double>")
    made = {r["url"]: r for r in similarity.image_groups(images, "store", "url", "v").collect()}
    assert [(u, made[u]["image_group"], made[u]["group_order"]) for u in "abe"] == [("a", "imggrp-001", 1), ("b", "imggrp-001", 2), ("e", "imggrp-001", 3)]
    assert {made[u]["reason"] for u in "cdgh"} == {"NO_SIMILAR_IMAGE_IN_STORE"} and made["f"]["reason"] == "VECTORIZE_FAILED"


def test_components_and_core(spark):
    chain = table(spark, [(k, k + 1) for k in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    assert rows(C.components(chain).groupBy("label").count(), "label", "count") == [(0, 31), (100, 2)]
    triangle = table(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)], "a long, b long")
    assert rows(C.k_core(triangle, 2), "a", "b") == [(1, 2), (1, 3), (2, 3)]
    assert C.components(triangle.limit(0)).count() == 0


def test_windows(spark):
    made = spark.range(1).select(K.windows(F.array(*[F.lit(x) for x in "abc"])).alias("w")).first()["w"]
    assert [x["span"] for x in made] == ["a b", "b c", "a b c"]
    assert spark.range(1).select(K.windows(F.array(F.lit("a"))).alias("w")).first()["w"] == []


def test_spans(spark):
    given = table(spark, [(1, "a b", 0, 2, 0.88), (1, "a b c", 0, 3, 0.9), (1, "x y", 5, 2, 0.5), (1, "x y", 8, 2, 0.6)], "k int, span string, start int, width int, score double")
    once = spans.best_of_each(given, "k")
    assert rows(spans.suppressed(once, "k", range(2, 4)), "span", "start") == [("a b c", 0), ("x y", 8)]
    some = F.array(*[F.struct(F.lit(s).alias("span"), F.lit(a).alias("start"), F.lit(2).alias("width"), F.lit(x).alias("score")) for s, a, x in (("a b", 0, 0.95), ("b c", 1, 0.9), ("x y", 5, 0.85))])
    assert spark.range(1).select(spans.greedy(some, 2).alias("w")).first()["w"] == ["a b", "x y"]


def test_span_keywords_of_empty_rows(spark):
    given = table(spark, [(1, None, "positive"), (2, "", "negative"), (3, "one two three four", "positive")], "id int, text string, label string")
    made = {r["id"]: r["keywords"] for r in spans.span_keywords(given, "id", "text", "label", hash_scorer).collect()}
    assert made[1] == "" and made[2] == "" and set(made) == {1, 2, 3}


def test_hybrid_ranks(spark):
    words = [f"keyword{k}" for k in range(1, 13) for _ in range(k)]
    docs = table(spark, [("a", words, "about keyword11")], "id string, w array<string>, title string")
    made = K.hybrid_ranks(docs, "id", F.col("w"), F.col("title")).orderBy("rank").collect()
    assert len(made) == 10 and made[0]["term"] in ("keyword1", "keyword11") and {r["term"] for r in made} >= {"keyword11"}


def test_samples(spark):
    given = spark.range(500).select("id", (F.col("id") % 2).alias("s"), (F.col("id") + 1).alias("w"))
    once = rows(K.weighted_sample(given, "s", F.col("id"), F.col("w"), 5, "x"), "s", "id")
    assert len(once) == 10 and once == rows(K.weighted_sample(given.repartition(7), "s", F.col("id"), F.col("w"), 5, "x"), "s", "id")
    assert K.reservoir(given, F.col("id"), 20).count() == 20


@pytest.mark.parametrize(("text", "wanted"), [("강남 중국집 추천 면은 싫어", "restaurant_menu_exclude_ingredient"), ("GPT 업데이트 뉴스", "news_tech_event_search"), ("안녕", None), ("gpt", None)])
def test_questions(spark, text, wanted):
    made = nlq.understood(table(spark, [(text,)], "t string"), "t").first()
    assert made["template"] == wanted and (made["status"] == "validated") == (wanted is not None)


def test_graph(spark):
    nodes = table(spark, [("Restaurant", "r1", "A", 4.5, 1), ("Restaurant", "r2", "B", None, 1), ("Restaurant", "r2", "B2", None, 2), ("Menu", "m1", "중국음식", None, 1), ("Menu", "m2", "짜장면", None, 1), ("Ingredient", "면", "면", None, 1)], "label string, key string, name string, rating double, seq int")
    merged = merge_nodes(nodes, "seq").select("*", F.lit(1.0).alias("price"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp_ntz").alias("published"), F.lit(None).cast("double").alias("importance"))
    edges = table(spark, [("Restaurant", "r1", "SELLS", "Menu", "m1"), ("Restaurant", "r1", "SELLS", "Menu", "m2"), ("Restaurant", "r2", "SELLS", "Menu", "m2"), ("Menu", "m2", "RELATED_TO", "Menu", "중국음식"), ("Menu", "m2", "CONTAINS", "Ingredient", "면")], "src_label string, src string, type string, dst_label string, dst string")
    g = Graph(merged, merge_edges(edges.union(edges)))
    assert [tuple(r) for r in g.exclude_ingredient("중국음식", "면").collect()] == [("r1", 4.5, "m1")]
    assert g.exclude_ingredient("중국음식", "없음").count() == 0 and g.exclude_ingredient_everywhere("중국음식", "면").count() == 0
    assert rows(merged.filter("key = 'r2'"), "name") == [("B2",)]


def test_post_analysis(spark):
    crawl = table(spark, [(1, "t", "맛있어요 정말 좋네요 또 갈게요", "u", 100, "CA01", None), (2, "OpenAI", "GPT", "u", None, "CA07", None), (3, "x", "y", "u", 200, "CA01", None)], "crawling_id long, title string, content string, article_url string, map_id long, category_cd string, shop_cd string")
    shops = table(spark, [(100, 1, "SC01")], "map_id long, shop_id long, shop_cd string")
    now = F.lit("2026-05-20 12:00:00").cast("timestamp_ntz")
    done = pipelines.post_analysis(crawl, shops, spark.createDataFrame([], ANALYSIS), now)
    got = {r["crawling_id"]: r for r in done.collect()}
    assert set(got) == {1, 2} and got[1]["information_cd"] == "IC01" and got[1]["shop_id"] == 1 and got[1]["shop_cd"] == "SC01"
    assert got[2]["information_cd"] == "IC02" and got[2]["shop_id"] is None and got[2]["keywords"] == "#OpenAI#ai_company"
    again = pipelines.enrich(crawl, shops, done, now)
    assert again.count() == 2


def test_clean_news(spark):
    fields = "thread string, seq int, title string, content string, article_url string, created_at string, category_cd string"
    given = table(spark, [("g_1", 1, "first", "b", "http://u", "2026-05-20 10:00:00", "CA07"), ("g_1", 2, "second", "b", "http://u", "2026-05-20T10:00:00", "CA07"), ("g_2", 3, None, "b", "http://u", "2026-05-20 10:00:00", "CA07"), ("g_3", 4, "t", "b", "http://u", "soon", "CA07")], fields)
    good, bad = pipelines.clean_news(given, "seq")
    assert rows(good, "thread", "title") == [("g_1", "second")] and rows(bad, "thread") == [("g_2",), ("g_3",)]


def test_article_keywords(spark):
    fields = "article_id string, source string, title string, content string, batch_id string"
    given = table(spark, [("a", "s", "OpenAI 출시", "OpenAI model news", "b1"), ("b", "s", " ", "x", "b1")], fields)
    made = pipelines.extract_article_keywords(given, {"openai": "OpenAI"}, EchoClient(fails=("a",)))
    record = made.records.first()
    assert record["keywords"] == "OpenAI" and record["signals"] == ["RELEASE:출시"] and "LLM_CLASSIFICATION_FAILED" in record["review_reasons"]
    assert rows(made.malformed, "article_id", "reason_code") == [("b", "EMPTY_TITLE")] and made.metrics.first()["status"] == "PARTIAL_SUCCESS"


def test_normalise_stores(spark):
    from millrace.schemas import CANDIDATE

    store = lambda name, url: {"entity_id": "e", "name": name, "full_address": "서울강남 역삼동", "rating": 4.0, "canonical_url": url}
    given = spark.createDataFrame([("b", 1, "e1", {}, store("가", "u1"), [{"name": "m", "price": 1}], [{"rating": 5.0, "visited_at": "2026-01-02"}], []), ("b", 2, "e1", {}, store("나", "u1"), [], [], []), ("b", 1, "e2", {}, store(None, None) | {"entity_id": None, "full_address": None}, [], [], [])], CANDIDATE)
    codes = table(spark, [("서울 강남", "LA02")], "name string, cd string")
    good, bad = pipelines.normalise_stores(given, codes, table(spark, [], "dedup_key string, store_hash string"))
    first = good.first()
    assert good.count() == 1 and first["store"]["name"] == "가" and first["address_cd"] == "LA02" and first["address_detail"] == "역삼동" and first["review_count"] == 1 and first["is_changed"]
    assert rows(bad, "entity_id", "reason_code") == [("e2", "INVALID_DATA_FORMAT")]
    same, _ = pipelines.normalise_stores(given, codes, good.select("dedup_key", "store_hash"))
    assert not same.first()["is_changed"]


def test_span_keywords_stay_in_their_row(spark, monkeypatch):
    """A scorer that is an expression shuffles no window; keys that rows share go the other way, with the same result."""
    each = lambda df: sorted(map(tuple, df.collect()), key=str)
    texts = ["좋네요 맛은 있어요 별로 게 좋네요 맛은", "a b c a b c d e", "", None, "one two three four five six"]
    given = table(spark, [(k, t * n if t else t, label) for k, (t, n, label) in enumerate((t, n, label) for t in texts for n in (1, 3) for label in ("positive", "negative"))] + [(None, "x y z", "positive")], "id int, text string, label string")
    made = spans.span_keywords(given, "id", "text", "label", hash_scorer)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(spans, "is_expression", lambda *_: False)
    assert each(made) == each(spans.span_keywords(given, "id", "text", "label", hash_scorer))
    monkeypatch.undo()
    doubled = given.unionByName(table(spark, [(1, "q r s t u", "positive"), (1, "z y", "negative"), (None, "x", "negative")], "id int, text string, label string"))
    mixed = spans.span_keywords(doubled, "id", "text", "label", hash_scorer)
    monkeypatch.setattr(spans, "is_expression", lambda *_: False)
    assert each(mixed) == each(spans.span_keywords(doubled, "id", "text", "label", hash_scorer))
    monkeypatch.undo()
    assert not spans.is_expression(spark, batched(lambda: lambda texts: [{"positive": 1.0, "negative": 0.0} for _ in texts], "struct<positive: double, negative: double>"))


def test_global_rank_looks_no_bounds_up(spark):
    """Ranks come from Spark's own ranges: a row isn't held against a bound of every range."""
    given = spark.range(1000).select((F.col("id") % 7).alias("v"), "id")
    made = R.global_rank(given, "v", [F.col("v"), F.col("id")], parts=300)
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    due = sorted((k % 7, k) for k in range(1000))
    assert [(r["v"], r["id"]) for r in made.orderBy("rank").collect()] == due and [r["rank"] for r in made.select("rank").orderBy("rank").collect()] == list(range(1, 1001))
