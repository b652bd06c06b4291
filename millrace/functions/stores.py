"""Fields of a store's profile page by expressions: the store itself, its menus, reviews and photos.

Elements are found by name and class or id; those looked up here hold no element of their own name, so one expression
reads each. Parts that repeat and hold others (reviews, evaluations) reach from one start to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pages
from .html import json_ld
from .pages import ENTITIES
from .text import digits_to_int, strip_all

def plain(c: Column) -> Column:
    """Text of markup: tags out, entities decoded, white space collapsed and trimmed."""
    bare = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(c, r"(?s)<[^>]*>", ""))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def marked(*classes: str, **attributes: str) -> str:
    """Expression of a start tag's attributes that have the classes and the values (expressions) given."""
    words = "".join(rf'(?=[^>]*\bclass="(?:[^"]*\s)?{c}(?:\s[^"]*)?")' for c in classes)
    return words + "".join(rf'(?=[^>]*\b{k.replace("_", "-")}="{v}")' for k, v in attributes.items())


def inner(html: Column, tag: str, mark: str = "") -> Column:
    """Markup inside the first such element; empty without one."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b{mark}[^>]*>(.*?)</{tag}>", 1)


def filled_or_null(c: Column) -> Column:
    """Null for the empty string. c is computed once: inside an array nullif() would compute it twice, and nested ones again."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def first_text(html: Column, tag: str, mark: str = "") -> Column:
    """Text of the first such element; null without one or where it is blank."""
    return filled_or_null(plain(inner(html, tag, mark)))


def all_texts(html: Column, tag: str, mark: str = "") -> Column:
    """Texts of all such elements that have one."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{mark}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, plain), lambda x: x != "")


def attribute(html: Column, tag: str, mark: str, name: str) -> Column:
    """An attribute of the first such element; null without one."""
    return filled_or_null(F.regexp_extract(html, rf'(?is)<{tag}\b{mark}[^>]*?\b{name}="([^"]*)"', 1))


def parts(html: Column, start: str) -> Column:
    """Markup from each start tag (an expression) up to the next one."""
    split = F.split(html, rf"(?is)(?={start})")
    return F.filter(split, lambda x: x.rlike(rf"(?is)^{start}"))


def number(c: Column, kind: str = "double") -> Column:
    """The first number in a text; null without one."""
    return filled_or_null(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1)).try_cast(kind)


def zipped(names: tuple[str, str], left: Column, right: Column) -> Column:
    """Pairs of two arrays in order, as many as the shorter one has."""
    both = F.arrays_zip(left.alias(names[0]), right.alias(names[1]))
    return F.slice(both, 1, F.least(F.size(left), F.size(right)))


def opening_hours(html: Column) -> Column:
    """status, today_hours, weekly (date, hours, is_closed): dates and times are two lists that go together."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)(<[a-z]+\b{marked('hour_time')}[^>]*>.*?)</"), F.lit(1))
    pairs = zipped(("date", "tag"), all_texts(html, "[a-z]+", marked("hour_date")), tags)
    weekly = F.transform(pairs, lambda p: F.struct(p["date"].alias("date"), plain(p["tag"]).alias("hours"), p["tag"].rlike(r'(?is)^<[^>]*\bclass="(?:[^"]*\s)?closed(?:\s[^"]*)?"').alias("is_closed")))
    text = lambda mark: F.coalesce(first_text(html, "[a-z]+", mark), F.lit(""))
    return F.struct(text(marked("open-status")).alias("status"), text(marked(id="today-main-hours")).alias("today_hours"), weekly.alias("weekly"))


def score_distribution(html: Column) -> Column:
    """Array of (score, label, count) of the graph's rows that have a score and a count."""
    rows = F.regexp_extract_all(inner(html, "ul", marked("app-graph")), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    made = F.transform(rows, lambda x: F.struct(first_text(x, "[a-z]+", marked("score-number")).try_cast("double").alias("score"), F.coalesce(first_text(x, "p", marked("btxt")), F.lit("")).alias("label"), F.coalesce(number(first_text(x, "p", marked("score-count")), "int"), F.lit(0)).alias("count"), first_text(x, "p", marked("score-count")).isNotNull().alias("counted")))
    kept = F.filter(made, lambda r: r["score"].isNotNull() & r["counted"])
    return F.transform(kept, lambda r: F.struct(r["score"].alias("score"), r["label"].alias("label"), r["count"].alias("count")))


def detail_evaluation(html: Column) -> Column:
    """Array of (category, score, details of (label, percent))."""

    def item(x: Column) -> Column:
        bars = F.transform(parts(x, rf"<[a-z]+\b{marked('eval-bar-item')}[^>]*>"), lambda b: F.struct(first_text(b, "[a-z]+", marked("bar-label")).alias("label"), first_text(b, "[a-z]+", marked("bar-percent")).alias("percent")))
        whole = F.filter(bars, lambda b: b["label"].isNotNull() & b["percent"].isNotNull())
        return F.struct(first_text(x, "[a-z]+", marked("category-name")).alias("category"), first_text(x, "[a-z]+", marked("category-score")).try_cast("double").alias("score"), whole.alias("details"))

    made = F.transform(parts(html, rf"<[a-z]+\b{marked('eval-item')}[^>]*>"), item)
    return F.filter(made, lambda r: r["category"].isNotNull() & r["score"].isNotNull())


def keyword_stats(html: Column) -> Column:
    """Array of (group_index, keywords of (keyword, count)) of the previews that have counted keywords."""

    def group(x: Column) -> Column:
        spans = F.regexp_extract_all(x, F.lit(r"(?is)<span\b[^>]*>(.*?)</span>"), F.lit(1))
        counted = F.filter(spans, lambda s: s.rlike(r"(?is)<b\b[^>]*>\s*[0-9]+\s*</b>"))
        words = F.transform(counted, lambda s: F.struct(plain(F.regexp_replace(s, r"(?is)<b\b.*?</b>", "")).alias("keyword"), number(first_text(s, "b"), "int").alias("count")))
        return F.struct(F.coalesce(attribute(x, "p", "", "data-index"), F.lit("")).alias("group_index"), words.alias("keywords"))

    previews = F.regexp_extract_all(html, F.lit(rf"(?is)(<p\b{marked('cate', id='keyword_preview_[^\"]*')}[^>]*>.*?</p>)"), F.lit(1))
    return F.filter(F.transform(previews, group), lambda g: F.size(g["keywords"]) > 0)


def profile(html: Column, platform: Column, address_of_id: Column) -> Column:
    """The seventeen fields of a store: headings and marked elements first, then JSON-LD, then hidden fields.

    address_of_id is put before the id to make the page's own address, which is empty without an id. Numbers that are
    missing are 0, texts empty, lists empty; a store without a name is Unknown.
    """
    filled = lambda *c: F.coalesce(*c, F.lit(""))
    positive = lambda c: F.when(c != 0, c)
    link = F.regexp_extract(html, rf'(?is)<li\b{marked("locat")}[^>]*>(.*?)</li>', 1)
    asked = F.nullif(F.regexp_extract(link, r'(?is)<a\b[^>]*href="[^"]*?query=([^"]*)"', 1), F.lit(""))
    base = F.coalesce(F.try_url_decode(asked), first_text(link, "a"))
    located = F.nullif(F.trim(F.concat_ws(" ", base, F.when(base.isNotNull(), first_text(link, "span")))), F.lit(""))
    lat, lng = (json_ld(html, f"$.geo.{k}").try_cast("double") for k in ("latitude", "longitude"))
    hidden = lambda k: attribute(html, "input", marked(id=k), "value").try_cast("double")
    no_geo = (F.coalesce(lat, F.lit(0.0)) == 0) & (F.coalesce(lng, F.lit(0.0)) == 0)
    rid = F.regexp_extract(html, r"rid=([A-Za-z0-9_-]+)", 1)
    traits = all_texts(inner(html, "li", marked("char")), "a")
    return F.struct(
        F.coalesce(first_text(html, "h1", marked("tit")), json_ld(html, "$.name"), F.lit("Unknown")).alias("name"),
        all_texts(html, "a", r'(?=[^>]*\bclass="(?:[^"]*\s)?btxt(?:\s[^"]*)?")(?=[^>]*\bclass="[^"]*category-)').alias("categories"),
        filled(F.regexp_extract(html, rf'(?is)<meta\b{marked(name="description")}[^>]*\bcontent="([^"]*)"', 1)).alias("description"),
        F.trim(F.replace(filled(located, json_ld(html, "$.address.streetAddress")), F.lit("지도보기"), F.lit(""))).alias("full_address"),
        filled(first_text(html, "li", marked("tel")), json_ld(html, "$.telephone")).alias("telephone"),
        F.coalesce(F.when(no_geo, hidden("hdn_lat")).otherwise(lat), F.lit(0.0)).alias("latitude"),
        F.coalesce(F.when(no_geo, hidden("hdn_lng")).otherwise(lng), F.lit(0.0)).alias("longitude"),
        F.coalesce(positive(number(first_text(html, "[a-z]+", marked(id="lbl_review_point")))), json_ld(html, "$.aggregateRating.ratingValue").try_cast("double"), F.lit(0.0)).alias("rating"),
        F.coalesce(number(first_text(html, "[a-z]+", marked("review-count")), "int"), F.lit(0)).alias("review_count"),
        traits.alias("char_keywords"),
        opening_hours(html).alias("business_hours"),
        score_distribution(html).alias("score_distribution"),
        detail_evaluation(html).alias("detail_evaluation"),
        keyword_stats(html).alias("keyword_stats"),
        rid.alias("source_internal_id"),
        platform.alias("source_platform"),
        F.when(rid != "", F.concat(address_of_id, rid)).otherwise("").alias("canonical_url"),
    )


def named(**fields: Column) -> Column:
    """Struct with the names given, also where fields aren't resolved yet (nested lambdas lose an alias)."""
    return F.named_struct(*[c for name, field in fields.items() for c in (F.lit(name), field)])


def menu(m: Column) -> Column:
    """(name, price, description, menu_index) of an item's texts."""
    return named(name=m["name"], price=digits_to_int(F.coalesce(m["price"], F.lit("0"))), description=F.coalesce(m["description"], F.lit("")), menu_index=m["menu_index"])


def menus(html: Column) -> Column:
    """Array of (name, price, description, menu_index) of the menu list's items that have a name."""
    return F.transform(pages.texts(html)["menus"], menu)


def review(r: Column) -> Column:
    """The ten fields of a review's texts."""
    value = lambda name, kind, missing: F.coalesce(r[name].try_cast(kind), F.lit(missing))
    return named(
        content=strip_all(r["content"]),
        author=r["author"],
        author_stats=named(avg_score=value("avg_score", "double", 0.0), review_count=value("review_count", "int", 0), follower_count=value("follower_count", "int", 0)),
        visited_at=F.coalesce(r["visited_at"], F.lit("")),
        rating=F.coalesce(number(r["rating"]), F.lit(0.0)),
        sub_evaluations=F.map_from_entries(r["sub_evaluations"]),
        ordered_menus=r["ordered_menus"],
        keywords=r["keywords"],
        review_images=r["review_images"],
        source_review_id=F.lit(""),
    )


def reviews(html: Column) -> Column:
    """Array of the ten fields of each review that has an author; line breaks in its text stay."""
    return F.transform(pages.texts(html)["reviews"], review)


def page_photos(html: Column) -> Column:
    """Array of (url, category, nickname, date) of the photo boxes, each address once, the first one counting."""
    boxes = F.regexp_extract_all(html, F.lit(rf"(?is)(<[a-z]+\b{marked('photo_box')}[^>]*>)"), F.lit(1))
    value = lambda b, name: F.coalesce(F.nullif(F.regexp_extract(b, rf'(?is)\bdata-{name}="([^"]*)"', 1), F.lit("")), F.lit(""))
    made = F.transform(boxes, lambda b: F.struct(value(b, "origin").alias("url"), F.lit("unknown").alias("category"), value(b, "nickname").alias("nickname"), value(b, "date").alias("date")))
    return first_of_each(F.filter(made, lambda p: F.startswith(p["url"], F.lit("http"))))


def first_of_each(photos: Column) -> Column:
    """Of an array of structs with url those whose url didn't come before."""
    urls = F.transform(photos, lambda p: p["url"])
    return F.filter(photos, lambda p, i: F.array_position(urls, p["url"]) == i + 1)


def merged_photos(tabs: Column, html: Column) -> Column:
    """Photos of the tabs (map of category to array of (url, nickname, date)); those of the page where tabs have none."""
    each = F.flatten(F.transform(F.map_entries(tabs), lambda e: F.transform(e["value"], lambda p: F.struct(p["url"].alias("url"), e["key"].alias("category"), F.coalesce(p["nickname"], F.lit("")).alias("nickname"), F.coalesce(p["date"], F.lit("")).alias("date")))))
    good = first_of_each(F.filter(each, lambda p: F.coalesce(F.startswith(p["url"], F.lit("http")), F.lit(False))))
    return F.when(F.size(good) > 0, good).otherwise(page_photos(html))
