"""Whole pipelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import hash_scorer
from . import pipelines
from .base import Registry, table

registry = Registry()
query = registry.query


def crawled(spark, sf_dir):
    """documents as crawled rows: two of three are reviews at a place, the rest news; ids of suppliers' nations as places."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("crawling_id"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("content"), F.concat(F.lit("https://example.com/t/"), "doc_id").alias("article_url"), F.when(F.col("doc_id") % 3 == 0, "CA07").otherwise("CA01").alias("category_cd"), (F.col("doc_id") % 30).alias("map_id"), F.lit(None).cast("string").alias("shop_cd"))


def shops(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 6000").select(F.col("s_nationkey").cast("long").alias("map_id"), F.col("s_suppkey").alias("shop_id"), F.lit("SC01").alias("shop_cd"))


def empty_analysis(spark):
    from ..schemas import ANALYSIS

    return spark.createDataFrame([], ANALYSIS)


SCORE = "CAST('0x' || left(sha256(content), 8) AS BIGINT) / 4294967296.0"


@query(f"""
WITH s AS (SELECT s_nationkey AS map_id, count(*) AS n, min(s_suppkey) AS shop_id FROM supplier WHERE s_acctbal > 6000 GROUP BY 1),
c AS (SELECT doc_id AS crawling_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'CA07' ELSE 'CA01' END AS category_cd, doc_id % 30 AS map_id FROM documents)
SELECT crawling_id, CASE category_cd WHEN 'CA07' THEN 'IC02' ELSE 'IC01' END AS information_cd, CASE WHEN category_cd = 'CA01' THEN shop_id END AS shop_id,
  CASE WHEN {SCORE} >= 0.5 THEN 'positive' ELSE 'negative' END AS sentimental, round(greatest({SCORE}, 1 - {SCORE}), 4) AS score
FROM c LEFT JOIN s USING (map_id) WHERE category_cd = 'CA07' OR n = 1""")
def pipeline_sentiment(spark, sf_dir):
    enriched = pipelines.enrich(crawled(spark, sf_dir), shops(spark, sf_dir), empty_analysis(spark), F.lit("2026-05-20 12:00:00").cast("timestamp_ntz"))
    return pipelines.add_sentiment(enriched, hash_scorer).select("crawling_id", "information_cd", "shop_id", "sentimental", "score")


@query()
def pipeline_post_analysis(spark, sf_dir):
    done = pipelines.post_analysis(crawled(spark, sf_dir), shops(spark, sf_dir), empty_analysis(spark), F.lit("2026-05-20 12:00:00").cast("timestamp_ntz"))
    return done.select("crawling_id", "information_cd", "shop_id", "sentimental", "score", "keywords")


@query("""
WITH n AS (SELECT event_id, 'geeknews_' || event_id % 700 AS thread, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'T ' || event_type END AS title,
  CASE WHEN event_id % 17 = 0 THEN 'yesterday' ELSE 'ok' END AS form, ts FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY event_id DESC) AS r FROM n) WHERE r = 1)
SELECT thread, title, form = 'ok' AND title IS NOT NULL AS success FROM l""")
def pipeline_news_clean(spark, sf_dir):
    made = F.when(F.col("event_id") % 17 == 0, "yesterday").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("geeknews_"), F.col("event_id") % 700).alias("thread"), F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("T "), "event_type")).alias("title"), F.lit("body").alias("content"), F.concat(F.lit("https://example.com/"), "event_id").alias("article_url"), made.alias("created_at"), F.lit("CA07").alias("category_cd"))
    good, bad = pipelines.clean_news(rows, "event_id")
    return good.select("thread", "title", F.lit(True).alias("success")).unionByName(bad.select("thread", "title", F.lit(False).alias("success")))


@query(f"""
WITH c AS (SELECT doc_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'crawling_id' ELSE 'shop_id' END AS scope_type, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id % 30 END AS scope_id FROM documents),
g AS (SELECT scope_type, scope_id, count(*) AS rows, avg(CASE WHEN {SCORE} >= 0.5 THEN 1.0 ELSE 0.0 END) AS r FROM c GROUP BY 1, 2)
SELECT scope_type, scope_id, rows, round(r, 6) AS positive_ratio FROM g WHERE scope_type = 'crawling_id' OR (rows >= 5 AND r >= 0.6)""")
def pipeline_post_candidates(spark, sf_dir):
    from ..models import label

    rows = crawled(spark, sf_dir).select("crawling_id", F.when(F.col("category_cd") == "CA07", "IC02").otherwise("IC01").alias("information_cd"), F.col("map_id").alias("shop_id"), label(hash_scorer(F.col("content"))).alias("sentimental"))
    return pipelines.post_candidates(rows, ratio=0.6).withColumn("positive_ratio", F.round("positive_ratio", 6))


@query()
def pipeline_article_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    articles = docs.select(F.col("doc_id").cast("string").alias("article_id"), "source", F.left("text", F.lit(60)).alias("title"), F.col("text").alias("content"), F.lit("20260520_001").alias("batch_id"))
    return pipelines.extract_article_keywords(articles, {"that": "That"}).records.select("article_id", "keywords", "keyword_count", "llm_failed")


QUERIES, ORACLES = registry.queries, registry.oracles
