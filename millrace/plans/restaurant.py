"""The restaurant run: normalise, validate images, look up recipes, save, and keep the snapshot for the next run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators import dictionaries as D
from ..operators import records, similarity
from ..operators.upserts import merge
from ..sources.lake import first_seen
from .pipelines import normalise_stores

SNAPSHOT = "dedup_key string, store_hash string"
SAVED = "dedup_key string, entity_id string, name string, address_cd string, address_detail string, rating double, review_count int, review_rating double, store_hash string"
RECIPES = "keyword string, ingredient string, recipe_url string"
FALLBACK = "menu string, ingredients array<string>"
INGREDIENTS = ["dedup_key", "menu", "ingredient", "source", "source_url"]


@dataclass
class Run:
    """What a run leaves: normalised and failed records, image decisions, ingredients, stores and snapshot after it."""

    normalised: DataFrame
    failed: DataFrame
    images: DataFrame | None
    ingredients: DataFrame
    stores: DataFrame
    snapshot: DataFrame


def normalised_with_snapshot(candidates: DataFrame, codes: DataFrame) -> DataFrame:
    """The snapshot (dedup_key, store_hash) that a first run of these candidates would leave."""
    good, _ = normalise_stores(candidates, codes, candidates.sparkSession.createDataFrame([], SNAPSHOT))
    return good.select("dedup_key", "store_hash")


def recipe_targets(menus: DataFrame, order: str, recipes: DataFrame, rank_by: list[str], most: int = 3) -> DataFrame:
    """keyword, at, place, url: search words of NORMALIZED menus by first mention, with their best recipes, if any.

    menus(recipe_keyword, status, order); recipes(keyword, url, rank_by). Recipes are cut to ``most`` a keyword by a
    rank that Spark limits before it shuffles.
    """
    words = first_seen(menus.filter("status = 'NORMALIZED'").select(F.col("recipe_keyword").alias("keyword"), order), "keyword", order)
    best = recipes.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy(*rank_by))).filter(F.col("place") <= most)
    return words.join(best.select("keyword", "place", "url"), "keyword", "left")


def ingredients_of(stores: DataFrame, recipes: DataFrame, fallback: DataFrame) -> DataFrame:
    """INGREDIENTS of the stores' menus: each different menu is looked up once."""
    menus = stores.select("dedup_key", F.explode("menus").alias("m")).select("dedup_key", F.col("m.name").alias("raw_name"))
    named = menus.withColumn("normalized_name", F.coalesce(blank(D.menu_name(F.col("raw_name"))), F.col("raw_name"))).distinct()
    asked = named.select("raw_name", "normalized_name", F.col("raw_name").alias("recipe_keyword")).distinct()
    found = records.menu_ingredients(asked, recipes, fallback)
    key = F.coalesce(blank(F.col("normalized_name")), F.col("raw_name"))
    return named.select("dedup_key", key.alias("menu")).distinct().join(found, "menu").select(*INGREDIENTS)


def run(candidates: DataFrame, codes: DataFrame, stores: DataFrame | None, snapshot: DataFrame | None, recipes: DataFrame | None, fallback: DataFrame | None, images: DataFrame | None = None) -> Run:
    """A run after the one that left stores and snapshot (None: the first). Unchanged stores are only touched.

    images(dedup_key, url, embedding) are grouped within their stores. Without recipes and fallback the run goes on
    without ingredients, as it does without images.
    """
    spark = candidates.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    stores, snapshot = stores if stores is not None else empty(SAVED), snapshot if snapshot is not None else empty(SNAPSHOT)
    good, bad = normalise_stores(candidates, codes, snapshot)
    changed = good.filter("is_changed")
    decided = similarity.image_groups(images.join(changed.select("dedup_key"), "dedup_key", "left_semi"), "dedup_key", "url", "embedding") if images is not None else None
    found = ingredients_of(changed, recipes if recipes is not None else empty(RECIPES), fallback if fallback is not None else empty(FALLBACK))
    rows = changed.select("dedup_key", "entity_id", F.col("store.name").alias("name"), "address_cd", "address_detail", F.col("store.rating").alias("rating"), "review_count", "review_rating", "store_hash")
    saved = merge(stores, rows, ["dedup_key"], keep_on_null=True)
    after = merge(snapshot, rows.select("dedup_key", "store_hash"), ["dedup_key"], keep_on_null=True)
    return Run(good, bad, decided, found, saved, after)
