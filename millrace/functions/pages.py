"""Texts of a store page's menus and reviews, looked up by Arrow's expressions for all pages of a batch.

Spark's expressions are Java's, which try each tag of a page again for each field; Arrow's (RE2) take linear time and a fraction of
it, and can't look ahead, so that a tag's name and class are one expression. All beyond ASCII counts as part of a name.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import python

#: Entities that pages use in names and texts.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

# ASCII but letters, digits, _ and >; the class lists them, since folding cases of all that is beyond ASCII takes RE2 milliseconds
_SPACE, _OTHER = r"[\t\n\x0B\f\r ]", r"[\x00-/:-=?@\[-^`{-\x7F]"
_BEFORE = rf"{_OTHER}(?:[^>]*{_OTHER})?"  # between a tag's name and an attribute's


def start(name: str, *classes: str) -> str:
    """Expression of a start tag up to the end of its class attribute, which has one class or two."""
    between = rf"{_SPACE}(?:[^\"]*{_SPACE})?"
    words = "|".join(between.join(order) for order in dict.fromkeys((classes, classes[::-1])))
    return rf'<{name}{_BEFORE}class="(?:[^"]*{_SPACE})?(?:{words})(?:{_SPACE}[^"]*)?"'


def group(texts: pa.Array, expression: str) -> pa.Array:
    """x of the first place that an expression fits; null without one."""
    return pc.struct_field(pc.extract_regex(texts, expression), [0])


def cut(texts: pa.Array, expression: str, place: int) -> pa.Array:
    """What stands before (0) or after (1) the first place of an expression; null without one."""
    pairs = pc.split_pattern_regex(texts, expression, max_splits=1)
    sizes = pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(pairs).take(pa.array(np.cumsum(sizes) - 2 + place, mask=sizes < 2))


def inner(texts: pa.Array, name: str, *classes: str) -> pa.Array:
    """Markup inside the first such element, which holds none of its own name; null without one. Cuts are faster than groups."""
    return cut(cut(texts, rf"(?is){start(name, *classes)}[^>]*>", 1), f"(?i)</{name}>", 0)


def plain(markup: pa.Array) -> pa.Array:
    """Text of markup: tags out, entities decoded, white space collapsed and trimmed."""
    bare = pc.replace_substring_regex(markup, "(?s)<[^>]*>", "")
    for entity, character in ENTITIES:
        bare = pc.replace_substring(bare, entity, character)
    return pc.utf8_trim(pc.replace_substring_regex(bare, f"{_SPACE}+", " "), " ")


def filled(texts: pa.Array) -> pa.Array:
    """Null for the empty string."""
    return pc.if_else(pc.equal(texts, ""), None, texts)


def first_text(texts: pa.Array, name: str, *classes: str) -> pa.Array:
    """Text of the first such element; null without one or where it is blank."""
    return filled(plain(inner(texts, name, *classes)))


def marks(texts: pa.Array) -> tuple[str, str]:
    """Two characters that no text has: of Unicode's noncharacters, then of a private area."""
    held = texts.buffers()[2].to_pybytes() if len(texts) and texts.buffers()[2] else b""
    return tuple(islice((c for c in map(chr, (*range(0xFDD0, 0xFDF0), *range(0xF0000, 0xFFFFE))) if c.encode() not in held), 2))


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the values of lists."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


def marked_parts(texts: pa.Array, mark: str) -> tuple[np.ndarray, pa.Array]:
    """(row, part) of the parts of texts that follow a mark."""
    rows, values = flat(pc.split_pattern(texts, mark))
    later = np.concatenate([[False], rows[1:] == rows[:-1]]) if len(rows) else np.zeros(0, bool)
    return rows[later], values.filter(pa.array(later))


def pieces(texts: pa.Array, expression: str, mark: str) -> tuple[np.ndarray, pa.Array]:
    """(row, piece) of the parts of texts from each place of an expression up to the next."""
    return marked_parts(pc.replace_substring_regex(texts, expression, rf"{mark}\0"), mark)


def found(texts: pa.Array, expression: str, mark: tuple[str, str]) -> tuple[np.ndarray, pa.Array]:
    """(row, first group) of all places of an expression."""
    rows, values = marked_parts(pc.replace_substring_regex(texts, expression, rf"{mark[0]}\1{mark[1]}"), mark[0])
    return rows, pc.list_element(pc.split_pattern(values, mark[1], max_splits=1), 0) if len(values) else values


def lists(rows: np.ndarray, values: pa.Array, n: int, null: pa.Array | None = None) -> pa.Array:
    """Lists of n rows from values with their rows in ascending order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values, mask=null)


def kept(rows: np.ndarray, values: pa.Array, which: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rows and values that a mask (without nulls) names."""
    return rows[which.to_numpy(zero_copy_only=False)], values.filter(which)


def listed(texts: pa.Array) -> pa.Array:
    """The parts between commas, trimmed, without blanks; none for null."""
    rows, values = flat(pc.split_pattern(texts, ","))
    values = pc.utf8_trim(values, " ")
    return lists(*kept(rows, values, pc.not_equal(values, "")), len(texts))


ANY = "[a-z]+"
#: Fields that are the text of the first element of a name (ANY: each) and class.
TEXTS = {"avg_score": (ANY, "avg_score"), "review_count": (ANY, "rv_cnt"), "follower_count": (ANY, "follower_cnt"), "visited_at": ("span", "date"), "rating": (ANY, "total_score")}
LISTS = {"ordered_menus": (ANY, "ordered_menu_list"), "keywords": (ANY, "new-keyword_list")}
ITEM = {"name": ("span", "restaurant-menu"), "price": ("p", "restaurant-price"), "description": ("p", "menu-description")}


def sub_evaluations(x: pa.Array, mark: tuple[str, str]) -> pa.Array:
    """Lists of (k, v): the text of a paragraph without its value's, and its value."""
    rows, subs = found(x, rf"(?is){start('p', 'sub_title')}[^>]*>(.*?)</p>", mark)
    value = first_text(subs, "span", "text")
    rest = plain(pc.replace_substring_regex(subs, rf"(?is){start('span', 'text')}[^>]*>.*?</span>", ""))
    pairs = pa.StructArray.from_arrays([pc.utf8_trim(pc.replace_substring(rest, ":", ""), " "), value], names=["k", "v"])
    return lists(*kept(rows, pairs, value.is_valid()), len(x))


def images(x: pa.Array, mark: tuple[str, str]) -> pa.Array:
    """Lists of the addresses of a review's photos."""
    rows, tags = pieces(x, f"(?is){start(ANY, 'btn-gallery-review')}", mark[0])
    urls = filled(group(tags, rf'(?is)^<[a-z]+{_OTHER}(?:[^>]*{_OTHER})?data-origin="(?P<x>[^"]*)"'))
    return lists(*kept(rows, urls, urls.is_valid()), len(x))


def contents(x: pa.Array) -> pa.Array:
    """Texts with line breaks for those of the markup."""
    rows, lines = flat(pc.split_pattern_regex(pc.fill_null(inner(x, "div", "review_contents", "btxt"), ""), rf"(?i)<br{_SPACE}*/?>"))
    return pc.binary_join(lists(rows, plain(lines), len(x)), "\n")


def asked(texts: pa.Array, elements: dict[str, tuple[str, str]], fields: frozenset[str]) -> dict[str, pa.Array]:
    """First texts of the fields asked for, nulls for the others."""
    return {f: first_text(texts, *e) if f in fields else pa.nulls(len(texts), pa.string()) for f, e in elements.items()}


def menus(html: pa.Array, mark: tuple[str, str], fields: frozenset[str]) -> pa.Array:
    """Lists of (name, price, description, menu_index) of the menu list's items that have a name."""
    rows, items = found(inner(html, "ul", "Restaurant-MenuList"), rf"(?is)(<li{_BEFORE}data-menu-index=[^>]*>.*?)</li>", mark)
    index = pc.fill_null(group(items, rf'(?is)<li{_OTHER}(?:[^>]*?{_OTHER})??data-menu-index="(?P<x>[^"]*)"'), "") if "menu_index" in fields else pa.nulls(len(items), pa.string())
    made = asked(items, ITEM, fields | {"name"}) | {"menu_index": index}
    return lists(*kept(rows, pa.StructArray.from_arrays(list(made.values()), names=list(made)), made["name"].is_valid()), len(html), html.is_null())


def reviews(html: pa.Array, mark: tuple[str, str], fields: frozenset[str]) -> pa.Array:
    """Lists of the texts of each review that has an author."""
    rows, x = pieces(html, f"(?is){start('div', 'latter-graph-body')}[^>]*>", mark[0])
    graded = cut(x, rf"(?is){start(ANY, 'person-grade')}[^>]*>", 1)
    author = filled(plain(cut(cut(graded, rf"(?is)<strong(?:{_OTHER}[^>]*)?>", 1), "(?i)</strong>", 0)))
    rows, x = kept(rows, x, author.is_valid())
    made = {"content": contents(x), "author": author.drop_null()} | asked(x, TEXTS, fields) | {"sub_evaluations": sub_evaluations(x, mark)} | {f: listed(t) for f, t in asked(x, LISTS, fields).items()} | {"review_images": images(x, mark)}
    return lists(rows, pa.StructArray.from_arrays(list(made.values()), names=list(made)), len(html), html.is_null())


def _struct(*strings: str, **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in strings] + [T.StructField(n, t) for n, t in others.items()])


_STRINGS = T.ArrayType(T.StringType())
_REVIEW = _struct("content", "author", *TEXTS, sub_evaluations=T.ArrayType(_struct("k", "v")), **dict.fromkeys(LISTS, _STRINGS), review_images=_STRINGS)
_PAGE = _struct(menus=T.ArrayType(_struct(*ITEM, "menu_index")), reviews=T.ArrayType(_REVIEW))
#: Fields that a caller may leave out, and bytes of pages that are worked on together.
FIELDS, AT_ONCE = frozenset((*ITEM, "menu_index", *TEXTS, *LISTS)), 1 << 24


def read(html: pa.Array, fields: frozenset[str], at_once: int = AT_ONCE) -> pa.Array:
    """(menus, reviews) of pages, some of a batch at a time."""
    html = html.cast(pa.string())
    mark = marks(html)
    shares = [html.slice(at, n) for at, n in python.shares(pc.binary_length(html), at_once)] or [html]
    made = [(menus(h, mark, fields), reviews(h, mark, fields)) for h in shares]
    return pa.StructArray.from_arrays([pa.concat_arrays(column) for column in zip(*made, strict=True)], names=["menus", "reviews"])


def texts(html: Column, fields: Iterable[str] = FIELDS) -> Column:
    """Struct of menus and reviews, lists of the texts of a page; null lists for null. Of FIELDS those not asked for are null or empty."""
    wanted = frozenset(fields)

    def page_texts(html: pa.Array) -> pa.Array:
        return read(html, wanted)

    return F.arrow_udf(page_texts, _PAGE)(html)
