"""Nested restaurant records: images and their menus, recipes, retries, targets, reference look-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .policy import MOST_RETRIES, action

#: Quantities that end an ingredient.
QUANTITY = r"(?:\s+(?:약간|적당량|조금|취향껏|[0-9]+(?:/[0-9]+)?(?:\.[0-9]+)?\s*(?:g|kg|ml|l|개|대|쪽|알|큰술|작은술|스푼|컵|줌|장|봉|팩|캔|꼬집|T|t)))+$"


def unique_texts(array: Column) -> Column:
    """Trimmed, not blank, each once in the order of coming; an empty array for null."""
    trimmed = F.transform(F.coalesce(array, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def ingredient_name(c: Column) -> Column:
    """Without quantities at its end, however many follow one another."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), QUANTITY, ""))


def image_menus(records: DataFrame, key: str, reviews: str) -> DataFrame:
    """key, url, menus: the menus ordered in the reviews that show an image, first seen first."""
    each = records.select(key, F.posexplode(reviews).alias("r", "review")).select(key, "r", unique_texts(F.col("review.ordered_menus")).alias("menus"), unique_texts(F.col("review.review_images")).alias("urls"))
    pairs = each.filter(F.size("menus") > 0).select(key, "r", "menus", F.explode("urls").alias("url"))
    return pairs.groupBy(key, "url").agg(F.sort_array(F.collect_list(F.struct("r", "menus"))).alias("x")).select(key, "url", F.array_distinct(F.flatten("x.menus")).alias("menus"))


def image_alts(images: DataFrame, key: str, group: str, menus: DataFrame) -> DataFrame:
    """images(key, group, url) with alt and alt_source: a group's one distinct set of menus, else the image's own."""
    own = images.join(menus, [key, "url"], "left")
    sets = own.filter("menus IS NOT NULL").groupBy(key, group).agg(F.collect_set("menus").alias("sets"))
    single = sets.filter(F.size("sets") == 1).select(key, group, F.col("sets")[0].alias("shared"))
    both = own.join(single, [key, group], "left")
    source = F.when(F.col("shared").isNotNull(), "review_image_url_group").when(F.col("menus").isNotNull(), "review_image_url")
    return both.select(*images.columns, F.array_join(F.coalesce("shared", "menus"), ", ").alias("alt"), source.alias("alt_source"))


def menu_ingredients(menus: DataFrame, recipes: DataFrame, fallback: DataFrame) -> DataFrame:
    """menu, ingredient, source, source_url: of the recipe found under the menu's search word, else of the table.

    menus(raw_name, normalized_name, recipe_keyword); recipes(keyword, ingredient, recipe_url); fallback(menu,
    ingredients), looked up by normalized, then by raw name.
    """
    name = F.coalesce(blank(F.col("normalized_name")), F.col("raw_name"))
    rows = menus.select("raw_name", name.alias("menu"), "recipe_keyword").distinct()
    found = rows.join(recipes, F.col("recipe_keyword") == F.col("keyword")).select("raw_name", "menu", "ingredient", F.lit("RECIPE").alias("source"), F.col("recipe_url").alias("source_url"))
    rest = rows.join(recipes.select("keyword").distinct(), F.col("recipe_keyword") == F.col("keyword"), "left_anti")
    by_name = fallback.select(F.col("menu").alias("n"), F.col("ingredients").alias("by_name"))
    by_raw = fallback.select(F.col("menu").alias("w"), F.col("ingredients").alias("by_raw"))
    listed = rest.join(by_name, F.col("menu") == F.col("n"), "left").join(by_raw, F.col("raw_name") == F.col("w"), "left")
    filled = listed.select("raw_name", "menu", F.explode(F.coalesce("by_name", "by_raw")).alias("ingredient"), F.lit("CSV_FALLBACK").alias("source"), F.lit("").alias("source_url"))
    return found.unionByName(filled).select("menu", "ingredient", "source", "source_url").distinct()


def retry_targets(fails: DataFrame) -> DataFrame:
    """entity_id, address, reason_code of failures with an address, which the reference may hold in either place."""
    inner = lambda name: F.coalesce(F.col("entity_ref")[name], F.get_json_object("data", f"$.metadata.entity_ref.{name}"), F.get_json_object("data", f"$.entity_ref.{name}"))
    return fails.select("entity_id", inner("address_name").alias("address"), inner("shop_name").alias("shop"), "reason_code").filter(blank(F.col("address")).isNotNull())


def target_items(targets: DataFrame) -> DataFrame:
    """targets(address, shop, reason_code, url) with search_query and is_retry."""
    text = F.trim(F.concat_ws(" ", F.coalesce("address", F.lit("")), F.coalesce("shop", F.lit(""))))
    return targets.select("*", text.alias("search_query"), F.col("reason_code").isNotNull().alias("is_retry"))


def retry_step(fails: DataFrame, today: Column, most: int = MOST_RETRIES) -> DataFrame:
    """The next state of each entity's newest failure: retry_count one higher unless it was handled today, and action."""
    from .relational import keep_by

    last = keep_by(fails, ["entity_id", "reason_code"], F.struct("created_at", "retry_count"))
    again = F.to_date("created_at") < today
    count = F.coalesce("retry_count", F.lit(0)) + F.when(again, 1).otherwise(0)
    return last.select("entity_id", "reason_code", count.alias("retry_count"), action(F.col("reason_code"), count, most).alias("action"))


def once_each(rows: DataFrame, key: Column, model: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with a model's answer, asked once for each distinct trimmed key."""
    keyed = rows.withColumn("asked_key", blank(key))
    answers = keyed.select("asked_key").filter("asked_key IS NOT NULL").distinct().withColumn(name, model(F.col("asked_key")))
    return keyed.join(answers, "asked_key", "left").drop("asked_key")


#: Kinds of keywords that may be kept, and bounds of confidence and number.
KEYWORD_KINDS = ("Technology", "Company", "Event", "Topic", "Product", "Person", "Concept")
LOW, NORMAL, LEAST_KEYWORDS, LEAST_DOCUMENTS = 0.5, 0.75, 3, 10


def validated(keywords: Column, documents: Column, prior: Column) -> Column:
    """(kept, review_reasons) of an array of (kind, name, matched, confidence): unknown, blank and doubtful ones go."""
    good = lambda k: k["kind"].isin(*KEYWORD_KINDS) & (F.trim(k["name"]) != "") & (F.trim(k["matched"]) != "") & (k["confidence"] >= LOW)
    kept = F.filter(keywords, good)
    names = F.transform(kept, lambda k: F.concat_ws("|", k["kind"], k["name"]))
    once = F.filter(kept, lambda k, i: F.array_position(names, F.concat_ws("|", k["kind"], k["name"])) == i + 1)
    ignored = F.exists(keywords, lambda k: k["kind"] == "Ignore")
    few = F.when((F.size(once) == 0) & ignored, "ALL_KEYWORDS_IGNORED").when(F.size(once) < LEAST_KEYWORDS, "LOW_KEYWORD_COUNT")
    doubtful = F.when(F.exists(kept, lambda k: k["confidence"] < NORMAL), "LOW_CONFIDENCE_KEYWORD")
    reasons = F.array_distinct(F.concat(prior, F.array_compact(F.array(doubtful, few, F.when(documents < LEAST_DOCUMENTS, "SMALL_CORPUS_SIZE")))))
    return F.struct(once.alias("kept"), reasons.alias("review_reasons"))
