"""Column functions on strings. All pass null through unless they say otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR_LENGTH = 500


def strip_all(c: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[blank(c) for c in columns])


def drop_invisible(c: Column) -> Column:
    """Without zero-width and control characters (line feeds, tabs and returns stay); no-break spaces become spaces."""
    return F.translate(F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), "\u00a0", " ")


def clean(c: Column) -> Column:
    """Invisible characters dropped, line feeds and blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(drop_invisible(c), r"\n+", "\n"), r"[ \t]+", " ")


def escape_html(c: Column, *, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def anchor(url: Column, title: Column, length: int = ANCHOR_LENGTH) -> Column:
    """A link of at most ``length`` characters: the title is shortened with an ellipsis to fit; a URL that leaves no
    room stands alone, cut; a blank URL gives the empty string."""
    address = strip_all(url)
    head = F.concat(F.lit('<a href="'), escape_html(address), F.lit('">'))
    room = F.lit(length) - F.length(head) - 4
    label = escape_html(F.coalesce(strip_all(title), F.lit("")))
    fitted = F.when(F.length(label) <= room, label).otherwise(F.concat(F.left(label, room - 1), F.lit("…")))
    return F.when(F.coalesce(address, F.lit("")) == "", "").when(room < 1, F.left(address, F.lit(length))).otherwise(F.concat(head, fitted, F.lit("</a>")))


def image_tag(url: Column, alt: Column, length: int = ANCHOR_LENGTH) -> Column:
    head = F.concat(F.lit('<img src="'), escape_html(strip_all(url)), F.lit('" alt="'))
    room = F.lit(length) - F.length(head) - 4
    return F.when(F.coalesce(strip_all(url), F.lit("")) == "", "").otherwise(F.concat(head, F.left(escape_html(F.coalesce(alt, F.lit(""))), F.greatest(room, F.lit(0))), F.lit('" />')))


def shortened(c: Column, length: int) -> Column:
    """At most ``length`` code points; null becomes empty."""
    return F.left(F.coalesce(c, F.lit("")), F.lit(length))


def hashtags(words: Column) -> Column:
    """#a#b#c; the empty string for no words."""
    return F.when(F.size(words) > 0, F.concat(F.lit("#"), F.array_join(words, "#"))).otherwise("")


def parse_hashtags(c: Column, most: int = 15) -> Column:
    """The words of #a#b#c, blanks dropped, white space inside collapsed, at most ``most``."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "#"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.array_remove(parts, ""), 1, most)


def span_text(c: Column) -> Column:
    """Full stops and all but letters, digits, Hangul and white space become spaces; collapsed and trimmed."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[.。]", " "), r"[^\s0-9A-Za-z가-힣]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def span_tokens(c: Column, most: int = 15) -> Column:
    """Tokens without lone consonants and vowels, of at most ``most`` characters."""
    return F.filter(F.split(span_text(c), " "), lambda t: (t != "") & ~t.rlike("^[ㄱ-ㅎㅏ-ㅣ]+$") & (F.length(t) <= most))


def has_word(c: Column, alias: str) -> Column:
    """Whether the alias stands in the text: ASCII aliases between other characters than letters and digits."""
    if alias.isascii():
        return F.concat(F.lit(" "), F.lower(c), F.lit(" ")).rlike(rf"(?<![a-z0-9]){_quoted(alias.lower())}(?![a-z0-9])")
    return F.contains(F.lower(c), F.lit(alias.lower()))


def _quoted(text: str) -> str:
    return "".join(f"\\{ch}" if ch in r".^$*+?()[]{}|\-/" else ch for ch in text)


def digits_to_int(c: Column) -> Column:
    """The number that the digits spell; 0 where there are none."""
    return F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("int"), F.lit(0))


def dedup_key(url: Column, name: Column, address: Column, entity: Column) -> Column:
    """The URL, else name|address without spaces, else the entity's id."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    pair = F.when(blank(name).isNotNull() & blank(address).isNotNull(), F.concat_ws("|", bare(name), bare(address)))
    return F.coalesce(blank(url), pair, blank(entity))


def summary(c: Column, length: int = 300) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(length))


def visible(c: Column) -> Column:
    """Without markup and addresses, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<[^>]+>", " "), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def sentences(c: Column, least: int = 8) -> Column:
    """Parts between stops, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(c, r"[.!?。！？]+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def without_thinking(c: Column) -> Column:
    """A model's answer without its think block, code fence and introduction line."""
    plain = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    plain = F.regexp_replace(plain, r"(?m)^```[A-Za-z]*\s*$", "")
    return strip_all(F.regexp_replace(plain, r"(?i)^\s*(?:post|answer|result|본문|결과)\s*:\s*", ""))


def json_block(c: Column) -> Column:
    """The first JSON object of a fenced or plain answer, as text; null if there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    plain = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(plain, F.lit("")))


def required_part(c: Column, part: Column) -> Column:
    """c with the part on a line of its own at the end, unless it holds it."""
    return F.when(part.isNull() | F.contains(c, part), c).otherwise(F.concat(c, F.lit("\n"), part))


def thread_id(url: Column, service: Column) -> Column:
    """service_id of an article: the address's query parameter id, else its last path segment."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/*$", 1)
    return F.concat_ws("_", service, F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]id=([^&#]*)", 1), F.lit("")), last))


def fixed_chunks(c: Column, length: int, overlap: int) -> Column:
    """Array of pieces of ``length`` characters, each beginning ``overlap`` before the end of the one before."""
    step = length - overlap
    last = F.greatest(F.ceil((F.length(c) - overlap) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.substring(c, k * step + 1, F.lit(length)))


def stable_pick(c: Column, n: int) -> Column:
    """A number below n, from the first 32 bits of the sha256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % n
