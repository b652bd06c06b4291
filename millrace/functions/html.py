"""Fields of crawled pages by expressions: titles, metas, headings, JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_all, visible


def tag_text(html: Column, tag: str) -> Column:
    """Visible text of the first element of a name; null without one."""
    return F.nullif(visible(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(strip_all(F.regexp_extract(html, rf"""(?is)<meta\s+(?:name|property)=["']{name}["']\s+content=["'](.*?)["']""", 1)), F.lit(""))


def links(html: Column) -> Column:
    """Addresses of all links, in order."""
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))


def json_ld(html: Column, path: str) -> Column:
    """A value of the first JSON-LD block by JSON path; null if there is none or it doesn't parse."""
    block = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    return F.get_json_object(block, path)


def store_page(html: Column) -> Column:
    """name, address, rating, menus (JSON) of a store's page: JSON-LD first, then headings."""
    return F.struct(
        F.coalesce(json_ld(html, "$.name"), tag_text(html, "h1"), tag_text(html, "title"), F.lit("Unknown")).alias("name"),
        json_ld(html, "$.address.streetAddress").alias("address"),
        json_ld(html, "$.aggregateRating.ratingValue").try_cast("double").alias("rating"),
        json_ld(html, "$.hasMenu").alias("menus"),
    )


def article_page(html: Column) -> Column:
    return F.struct(F.coalesce(meta(html, "og:title"), tag_text(html, "h1"), tag_text(html, "title")).alias("title"), tag_text(html, "article").alias("content"), meta(html, "author").alias("author"))
