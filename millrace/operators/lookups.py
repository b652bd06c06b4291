"""Rules of single rows and keys: watermarks by prefix, ids that fall through, touches, snapshots, URLs held by texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .relational import small_side


def prefix_watermarks(rows: DataFrame, thread: str, at: str, prefixes: list[str]) -> DataFrame:
    """prefix, latest: the newest time among the threads that start with each prefix, null where none does; one pass."""
    newest = rows.agg(*[F.max(F.when(F.startswith(F.col(thread), F.lit(p)), F.col(at))).alias(f"p{k}") for k, p in enumerate(prefixes)])
    return newest.select(F.inline(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"p{k}").alias("latest")) for k, p in enumerate(prefixes)])))


def first_id(key: str, found: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, id, origin: each key's id from the first source that has one; sources are (name, DataFrame of key and id)."""
    each = None
    for k, (name, df) in enumerate(found):
        part = df.select(key, "id", F.lit(name).alias("origin"), F.lit(k).alias("place"))
        each = part if each is None else each.unionByName(part)
    best = each.filter("id IS NOT NULL").groupBy(key).agg(F.min_by(F.struct("id", "origin"), F.struct("place", "id")).alias("b"))
    return best.select(key, "b.id", "b.origin")


def touch_rows(touches: DataFrame, shops: DataFrame, maps: DataFrame) -> DataFrame:
    """A crawling row for each touch(shop_id, category_cd, at) of a known shop on a known map: the shop's codes, and the
    map's category where the touch has none."""
    shop = shops.select("shop_id", "map_id", "shop_cd")
    place = small_side(maps.select("map_id", F.col("category_cd").alias("map_category")), 200_000)
    rows = touches.join(shop, "shop_id").join(place, "map_id")
    return rows.select("shop_id", "map_id", F.coalesce("category_cd", "map_category").alias("category_cd"), "shop_cd", F.col("at").alias("created_at"))


def bare_key(name: Column, address: Column) -> Column:
    """name|address without spaces in the name; null without an address."""
    return F.concat(F.replace(F.coalesce(name, F.lit("")), F.lit(" "), F.lit("")), F.lit("|"), address)


def snapshots(wanted: DataFrame, shops: DataFrame, maps: DataFrame, visits: DataFrame) -> DataFrame:
    """dedup_key, shop_id, last_checked_at, article_url: the least shop that a wanted key names, by an article's address or
    by name and address, with its newest visit and the newest visit's address. Each way is an equi-join."""
    # all keys of a map name all of its shops, so its least one stands for them; an address counts once a map
    place = maps.join(shops.filter("shop_id IS NOT NULL").groupBy("map_id").agg(F.min("shop_id").alias("shop_id")), "map_id")
    by_name = place.select(bare_key(F.col("name"), F.col("address")).alias("dedup_key"), "shop_id", "map_id")
    seen = visits.select("map_id", F.col("article_url").alias("dedup_key")).distinct()
    by_url = seen.join(place.select("shop_id", "map_id").distinct(), "map_id").select("dedup_key", "shop_id", "map_id")
    found = by_name.unionByName(by_url).join(wanted.select("dedup_key").distinct(), "dedup_key").groupBy("dedup_key").agg(F.min(F.struct("shop_id", "map_id")).alias("s")).select("dedup_key", "s.*")
    newest = F.max_by(F.when(F.col("article_url").isNotNull(), F.col("article_url")), F.when(F.col("article_url").isNotNull(), F.struct("created_at", "article_url"))).alias("article_url")
    last = visits.join(found.select("map_id").distinct(), "map_id", "left_semi").groupBy("map_id").agg(F.max("created_at").alias("last_checked_at"), newest)
    return found.join(last, "map_id", "left").select("dedup_key", "shop_id", "last_checked_at", "article_url")


def unheld_urls(images: DataFrame, url: str, documents: DataFrame, text: str, named: str) -> DataFrame:
    """images whose address stands in no document's text and is no document's ``named`` one.

    An address in a text begins where an address begins, so it is a prefix of such a run: an equi-join on prefixes of
    the lengths that addresses have, not a comparison of all pairs.
    """
    wanted = images.select(F.col(url).alias("u")).filter("u IS NOT NULL").distinct()
    lengths = [r[0] for r in wanted.select(F.length("u").alias("n")).distinct().orderBy("n").collect()]  # lengths of addresses
    runs = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?=(https?://\S+))"), 1)).alias("run")).distinct()
    tried = runs.select(F.explode(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("run")), lambda n: F.left("run", n))).alias("u"))
    held = tried.unionByName(documents.select(F.col(named).alias("u"))).join(wanted, "u", "left_semi").distinct()
    return images.join(held, F.col(url) == F.col("u"), "left_anti")


def objects_of(payload: Column, fields: str) -> Column:
    """The objects in a JSON array as structs of the fields given; other elements are passed over, and what is no array
    has none."""
    parsed = F.try_parse_json(payload)
    listed = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed.cast("array<variant>"))
    objects = F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.transform(objects, lambda x: F.from_json(x.cast("string"), f"struct<{fields}>"))


def batch_of(articles: Column, raw: Column) -> Column:
    """The first article's batch, else the first that isn't blank among the raw rows', else unknown_batch."""
    first = F.get(F.filter(F.transform(raw, blank), lambda b: b.isNotNull()), 0)
    return F.coalesce(F.get(articles, 0), first, F.lit("unknown_batch"))


def surest(candidates: Column) -> Column:
    """Of an array of (value, confidence) the first one of the highest confidence; null for none."""
    best = F.array_max(F.transform(candidates, lambda c: c["confidence"]))
    return F.get(F.filter(candidates, lambda c: c["confidence"] == best), 0)


def keyword_sets(chosen: Column, stats: Column) -> Column:
    """(selected, target): chosen keywords with those of the stats and of their groups, and those of stats marked as
    targets; trimmed, without blanks, sorted. stats: array of (keyword, keywords, has_target_keyword)."""
    names = lambda s: F.concat(F.array(s["keyword"]), F.coalesce(s["keywords"], F.array().cast("array<string>")))
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, blank), lambda x: x.isNotNull())))
    of = lambda kept: F.flatten(F.transform(kept, names))
    return F.struct(tidy(F.concat(chosen, of(stats))).alias("selected"), tidy(of(F.filter(stats, lambda s: F.coalesce(s["has_target_keyword"], F.lit(False))))).alias("target"))
