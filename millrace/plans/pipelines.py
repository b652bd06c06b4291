"""The batch pipelines from end to end, as functions over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as S
from ..models import EchoClient, Scorer, hash_scorer, label, word_tokenizer
from ..operators import dictionaries as D
from ..operators import keywords as K
from ..operators import policy, spans
from ..operators import relational as R
from ..operators.upserts import merge
from ..schemas import CATEGORY_DEFAULT, INFORMATION_IT, INFORMATION_RESTAURANT
from ..sources.lake import flagged_split


def clean_news(rows: DataFrame, sequence: str, required: tuple[str, ...] = ("title", "content", "article_url", "created_at", "thread", "category_cd")) -> tuple[DataFrame, DataFrame]:
    """(success, fail): the last row of each thread by ``sequence``, cleaned; rows without a required value fail.

    created_at is read in both forms that sources write; one that fits neither fails.
    """
    last = R.keep_by(rows, ["thread"], F.col(sequence))
    when = dates.any_format(F.col("created_at"), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    tidy = last.withColumns({"created_at": when, "title": S.clean(F.col("title")), "content": S.clean(F.col("content"))})
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    linked = tidy.withColumn("content", F.concat_ws("\n", "content", S.anchor(F.col("article_url"), F.col("title"))))
    return flagged_split(linked.drop(sequence), missing)


def save_news(crawling: DataFrame, clean: DataFrame, since: Column | None = None) -> DataFrame:
    """crawling after the new threads came in: those that it has are left out, the rest overwrite by thread."""
    new = R.new_rows(clean.filter(F.col("created_at") > since) if since is not None else clean, crawling, ["thread"])
    return merge(crawling, new.withColumn("map_id", F.nullif("map_id", F.lit(0))), ["thread"], keep_on_null=False)


def enrich(crawling: DataFrame, shops: DataFrame, analysis: DataFrame, now: Column) -> DataFrame:
    """analysis with rows for crawled ids that it lacks: restaurants need exactly one shop at their place."""
    new = R.new_rows(crawling, analysis, ["crawling_id"])
    it = F.col("category_cd") == CATEGORY_DEFAULT
    news = new.filter(it).withColumns({"shop_id": F.lit(None).cast("long"), "matched_cd": F.lit(None).cast("string")})
    places = R.one_to_one(new.filter(~it | it.isNull()), shops.withColumnRenamed("shop_cd", "matched_cd"), "map_id", ["shop_id", "matched_cd"]).filter("match_status = 'matched'").drop("match_status")
    rows = news.unionByName(places).select("crawling_id", "title", "content", "article_url", "map_id", "shop_id", "category_cd", F.when(it, INFORMATION_IT).otherwise(INFORMATION_RESTAURANT).alias("information_cd"), F.coalesce("matched_cd", "shop_cd").alias("shop_cd"), now.alias("created_dt"), F.lit(None).cast("string").alias("sentimental"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("keywords"))
    return merge(analysis, rows, ["crawling_id"], keep_on_null=True)


def add_sentiment(analysis: DataFrame, scorer: Scorer = hash_scorer) -> DataFrame:
    """Labels and scores for rows that lack either and have content; each distinct content is scored once."""
    content = F.col("content")
    usable = content.isNotNull() & ~content.isin("", "-", "N/A") & (F.regexp_replace(content, r"\s", "") != "")
    pending = analysis.filter("sentimental IS NULL OR score IS NULL").filter(usable).select("crawling_id", "content")
    scores = pending.select("content").distinct().withColumn("s", scorer(F.col("content")))
    done = pending.join(scores, "content").select("crawling_id", label(F.col("s")).alias("sentimental"), F.round(F.greatest("s.positive", "s.negative"), 4).alias("score"))
    return merge(analysis, done, ["crawling_id"], keep_on_null=True)


def add_keywords(analysis: DataFrame, scorer: Scorer = hash_scorer) -> DataFrame:
    """Spans for labelled reviews, companies for news; an empty string counts as done."""
    review = analysis.filter(f"keywords IS NULL AND sentimental IS NOT NULL AND information_cd <> '{INFORMATION_IT}'")
    spanned = spans.span_keywords(review, "crawling_id", "content", "sentimental", scorer)
    news = analysis.filter(f"keywords IS NULL AND information_cd = '{INFORMATION_IT}'")
    text = F.concat_ws("\n", "title", "content")
    tagged = news.select("crawling_id", D.company_tags(text).alias("keywords"))
    return merge(analysis, spanned.unionByName(tagged), ["crawling_id"], keep_on_null=True)


def post_analysis(crawling: DataFrame, shops: DataFrame, analysis: DataFrame, now: Column, scorer: Scorer = hash_scorer) -> DataFrame:
    """The four steps in order."""
    return add_keywords(add_sentiment(enrich(crawling, shops, analysis, now), scorer), scorer)


def normalise_stores(candidates: DataFrame, codes: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised, failed) records: dedup_key, address code and detail, review summary, hashes, change flags.

    codes(name, cd); snapshot(dedup_key, store_hash). The first record of a key in a batch counts.
    """
    s = "store"
    key = S.dedup_key(F.col(f"{s}.canonical_url"), F.col(f"{s}.name"), F.col(f"{s}.full_address"), F.col(f"{s}.entity_id"))
    keyed = candidates.withColumns({"dedup_key": key, "address": F.col(f"{s}.full_address")})
    bad = keyed.filter(F.col("dedup_key").isNull()).select("batch_id", "entity_id", F.lit("INVALID_DATA_FORMAT").alias("reason_code"))
    once = R.keep_by(keyed.filter("dedup_key IS NOT NULL").withColumn("at", F.struct("run_attempt", "entity_id")), ["batch_id", "dedup_key"], F.col("at"), last=False).drop("at")
    places = R.longest_prefix(once.select("address").filter("address IS NOT NULL").distinct(), "address", codes, "name", "cd").select("address", F.col("matched_code").alias("address_cd"), F.col("remainder").alias("address_detail"))
    coded = once.join(places, "address", "left")
    store_hash = F.sha2(F.to_json(F.struct(f"{s}.name", "address_cd", "address_detail", f"{s}.rating"), {"ignoreNullFields": "false"}), 256)
    menu_hash = F.sha2(F.array_join(F.sort_array(F.transform("menus", lambda m: F.to_json(m, {"ignoreNullFields": "false"}))), ""), 256)
    hashed = coded.withColumns({"store_hash": store_hash, "menu_hash": menu_hash, "review_count": F.size("reviews"), "review_rating": F.expr("aggregate(reviews, 0D, (s, r) -> s + coalesce(r.rating, 0D)) / nullif(size(reviews), 0)"), "last_visit": F.array_max(F.transform("reviews", lambda r: r["visited_at"]))})
    before = snapshot.select(F.col("dedup_key").alias("old_key"), F.col("store_hash").alias("old_hash"))
    out = hashed.join(before, F.col("dedup_key") == F.col("old_key"), "left").withColumn("is_changed", ~F.col("store_hash").eqNullSafe(F.col("old_hash"))).drop("old_key", "old_hash")
    lost = out.filter("address_cd IS NULL").select("batch_id", "entity_id", F.lit("UNDEFINED_CODE_DETECTED").alias("reason_code"))
    return out.filter("address_cd IS NOT NULL"), bad.unionByName(lost)


@dataclass
class Extraction:
    records: DataFrame
    malformed: DataFrame
    metrics: DataFrame


def extract_article_keywords(articles: DataFrame, dictionary: dict[str, str], client: EchoClient | None = None, top: int = 10) -> Extraction:
    """Ranked keywords of each article: by dictionary (alias -> name), else as the client classifies them.

    Malformed articles are set aside with their reason. The client is asked in Arrow batches, and an article that it
    fails on keeps its dictionary keywords and is marked for review.
    """
    reason = policy.malformed(F.col("title"), F.col("content"), [F.col("article_id"), F.col("source"), F.col("batch_id")])
    judged = articles.withColumn("reason_code", reason)
    good = judged.filter("reason_code IS NULL")
    words = F.filter(word_tokenizer(F.concat_ws(" ", "title", "content")), lambda w: (F.length(w) > 1) & (F.length(w) <= 40) & ~w.rlike("^[0-9]+$"))
    ranked = K.hybrid_ranks(good, "article_id", words, F.lower("title"), top)
    known = F.create_map(*[F.lit(x) for pair in dictionary.items() for x in (pair[0].lower().strip(), pair[1])])
    listed = ranked.withColumn("canonical", F.element_at(known, F.col("term"))).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "canonical"))).alias("terms"))
    asked = client or EchoClient()

    def ask(batches):
        for pdf in batches:
            out = []
            for article, terms in zip(pdf["article_id"], pdf["terms"], strict=True):
                open_terms = [t["term"] for t in terms if t["canonical"] is None]
                try:
                    given, failed = asked.classify(article, open_terms), False
                except RuntimeError:
                    given, failed = [], True
                found = [t["canonical"] for t in terms if t["canonical"] is not None] + [k["name"] for k in given if k["type"] != "Ignore" and k["confidence"] >= 0.5]
                out.append((article, "#".join(dict.fromkeys(found)), len(dict.fromkeys(found)), failed))
            yield pd.DataFrame(out, columns=["article_id", "keywords", "keyword_count", "llm_failed"])

    answered = listed.mapInPandas(ask, "article_id string, keywords string, keyword_count int, llm_failed boolean")
    review = F.filter(F.array(F.when(F.col("llm_failed"), "LLM_CLASSIFICATION_FAILED"), F.when(F.col("keyword_count") < 3, "LOW_KEYWORD_COUNT")), lambda x: x.isNotNull())
    records = good.select("article_id", "title", D.signals(F.concat_ws(" ", "title", "content")).alias("signals")).join(answered, "article_id", "left").withColumn("review_reasons", review)
    malformed = judged.filter("reason_code IS NOT NULL").select("article_id", "batch_id", "reason_code")
    metrics = judged.agg(F.count("*").alias("total"), F.count_if(F.col("reason_code").isNull()).alias("success"), F.count_if(F.col("reason_code").isNotNull()).alias("malformed")).withColumn("status", F.when(F.col("malformed") > 0, "PARTIAL_SUCCESS").otherwise("SUCCESS"))
    return Extraction(records, malformed, metrics)


def post_candidates(rows: DataFrame, least_rows: int = 5, ratio: float = 0.7) -> DataFrame:
    """Groups that may be posted on: scope_type, scope_id, rows, positive_ratio; restaurants by shop, news by article."""
    kind = F.when(F.col("information_cd") == INFORMATION_RESTAURANT, "shop_id").otherwise("crawling_id")
    key = F.when(kind == "shop_id", F.col("shop_id")).otherwise(F.coalesce("crawling_id", "shop_id"))
    grouped = rows.select("*", kind.alias("scope_type"), key.alias("scope_id")).filter("scope_id IS NOT NULL").groupBy("scope_type", "scope_id").agg(F.count("*").alias("rows"), F.avg(F.when(F.col("sentimental") == "positive", 1.0).otherwise(0.0)).alias("positive_ratio"))
    return grouped.filter((F.col("scope_type") == "crawling_id") | ((F.col("rows") >= least_rows) & (F.col("positive_ratio") >= ratio)))
