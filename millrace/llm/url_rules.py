"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression on host and path together with the literal tokens that any URL it matches
must hold. Listed rules read host and path as they are, patterns read them lower-cased (A-Z); where a token of either
ends, and where a word in a pattern does, is one definition (BORDER). The index keeps each rule under the one of its tokens that is rarest in the URLs at hand. A URL
fetches the rules filed under its own tokens by an equi-join, and only those rules run their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_table, small_side

BORDER = r"[^a-z0-9\x{80}-\x{10ffff}]"  # between tokens of a lower-cased address; also the SQL's
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_FIELDS = "rule: string, weight: int, listed: boolean, verdict: string, pattern: string, tokens: array<string>"


@dataclass(frozen=True)
class Rule:
    """listed: a rule of the list, of which the longest decides; else a pattern, heard where no listed rule fits."""

    rule: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"
    listed: bool = False


def words_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER))) if t]


def prefix_rule(verdict: str, rule: str) -> Rule:
    """``host/path-prefix``: fits the host and its subdomains where the path starts with the prefix."""
    host, slash, path = rule.partition("/")
    end = re.escape(slash + path) if path else "(?:/|$)"
    whole = re.sub(r"[^/]*$", "", slash + path)  # the last part of a prefix may be cut off inside a token
    return Rule(rule, rf"^(?:[^/]*\.)?{re.escape(host)}{end}", tuple(words_of(f"{host}/{whole}")), verdict, True)


def word_rule(word: str) -> Rule:
    """A word of host or path, standing between borders."""
    return Rule(word, rf"(?:^|{BORDER}){re.escape(word)}(?:{BORDER}|$)", tuple(words_of(word)))


#: The listed rules, and words of addresses that don't lead to prose.
LISTED = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BLOCK_WORDS = ("ads", "adserver", "adult", "bet", "betting", "casino", "doubleclick", "escort", "gambling", "payday", "pharmacy", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx")
DEFAULT_RULES = tuple(prefix_rule(v, r) for v, r in LISTED) + tuple(word_rule(w) for w in BLOCK_WORDS)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(target, UPPER, LOWER), f"{BORDER}+"), ""))


def rule_index(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row a rule, with the token it is filed under: of its tokens the rarest in urls(target), ties by name.

    A rule without literal tokens is filed under the empty token, which every URL asks for.
    """
    table = literal_table(urls.sparkSession, [vars(r) | {"weight": len(r.rule)} for r in rules], RULE_FIELDS)
    asked = table.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(url_tokens(F.col("target"))).alias("token")).join(small_side(asked, 100_000), "token", "left_semi").groupBy("token").count()
    filed = (
        table.select("*", F.explode_outer("tokens").alias("token"))
        .join(seen, "token", "left")
        .groupBy("rule", "weight", "listed", "verdict", "pattern")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("rarest"))
    )
    return filed.select("rule", "weight", "listed", "verdict", "pattern", F.col("rarest.token").alias("token"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the longest listed rule that fits, else null), verdict, matched (patterns that fit).

    Null and malformed URLs have empty host and path, fit no rule and are allowed. Rows that repeat stay as often
    as they come; an empty table gives an empty result; columns other than the two named are not looked at.
    Ties between listed rules of one length go to the name that sorts last.
    """
    each = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    host, path = url_parts(F.col("url"))
    keyed = each.select("page_id", "url", "copies", host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    index = rule_index(keyed, rules)
    asked = keyed.select("*", F.explode(F.array_append(url_tokens(F.col("target")), F.lit(""))).alias("token"))
    tried = asked.join(small_side(index, 100_000), "token", "left").withColumn("fits", F.coalesce(F.rlike(F.when(F.col("listed"), F.col("target")).otherwise(F.translate("target", UPPER, LOWER)), F.col("pattern")), F.lit(False)))
    listed, pattern = F.col("fits") & F.col("listed"), F.col("fits") & ~F.col("listed")
    judged = tried.groupBy("page_id", "url", "copies", "host", "path").agg(
        F.max(F.when(listed, F.struct("weight", "rule", "verdict"))).alias("best"),
        F.max(F.when(pattern & (F.col("verdict") == "block"), 1)).alias("blocked"),
        F.array_join(F.sort_array(F.collect_set(F.when(pattern, F.col("rule")))), ",").alias("matched"),
    )
    verdict = F.coalesce("best.verdict", F.when(F.col("blocked") == 1, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "matched", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
