"""Whether two keywords may be merged, and how often keywords like one were counted before.

A keyword's signals are a struct of arrays: predicates, actions, nouns and topics (the nouns that stand before a
judgement). They come from a tokenizer; nothing here reads the keyword itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import top_k

KINDS = ("predicates", "actions", "nouns", "topics")


def held_within(a: Column, b: Column) -> Column:
    """Whether a signal of one side is part of another one of the other side, both of two or more characters."""
    inside = lambda x, y: (x != y) & (F.length(x) >= 2) & (F.length(y) >= 2) & (F.contains(x, y) | F.contains(y, x))
    return F.exists(a, lambda x: F.exists(b, lambda y: inside(x, y)))


def may_merge(a: Column, b: Column) -> Column:
    """True unless what the two are about, ask for or judge is at odds.

    Without any signal on one side there is nothing at odds. Topics must meet: with topics on one side only, they must
    be among the other's nouns or hold or be held by one; with topics on both, they must share one. Then contained
    signals suffice; else actions on either side must be shared; else a shared topic, noun or predicate is needed.
    """
    shares = lambda kind: F.arrays_overlap(a[kind], b[kind])
    has = lambda x, kind: F.size(x[kind]) > 0
    signals = lambda x: F.concat(x["predicates"], x["actions"], x["nouns"])
    silent = lambda x: F.size(signals(x)) == 0
    one_sided = has(a, "topics") != has(b, "topics")
    topics, nouns = (F.when(has(a, "topics"), x).otherwise(y) for x, y in ((a["topics"], b["topics"]), (b["nouns"], a["nouns"])))
    astray = one_sided & ~(F.arrays_overlap(topics, nouns) | held_within(topics, nouns))
    apart = has(a, "topics") & has(b, "topics") & ~shares("topics")
    active = has(a, "actions") | has(b, "actions")
    return F.when(silent(a) | silent(b), True).when(astray | apart, False).when(held_within(signals(a), signals(b)), True).when(active, shares("actions")).otherwise(shares("topics") | shares("nouns") | shares("predicates"))


def fits(a: dict[str, set[str]], b: dict[str, set[str]]) -> bool:
    """may_merge() of two dictionaries of sets, for tasks that keep groups."""
    every = [x["predicates"] | x["actions"] | x["nouns"] for x in (a, b)]
    if not all(every):
        return True
    within = lambda left, right: any(x != y and min(len(x), len(y)) >= 2 and (x in y or y in x) for x in left for y in right)
    topics = [x["topics"] for x in (a, b)]
    if all(topics):
        if not topics[0] & topics[1]:
            return False
    elif any(topics):
        about, nouns = (topics[0], b["nouns"]) if topics[0] else (topics[1], a["nouns"])
        if not (about & nouns or within(about, nouns)):
            return False
    if within(*every):
        return True
    kinds = ("actions",) if a["actions"] or b["actions"] else ("topics", "nouns", "predicates")
    return any(a[k] & b[k] for k in kinds)


def similar_history(keywords: DataFrame, stored: DataFrame, scope: str, key: str, vector: str, *, k: int = 20, most_distance: float = 0.3) -> DataFrame:
    """query (a key of keywords), historical_count, similar: the summed batch_count of the stored keywords like it.

    Like it are those among the k nearest of its scope within the distance that may be merged with it. keywords and
    stored have scope, key, vector and signals; stored has batch_count. Keywords without any are left out.
    """
    near = top_k(keywords, stored, scope, key, vector, k, most_distance)
    mine = keywords.select(F.col(key).alias("query"), F.col("signals").alias("mine"))
    theirs = stored.select(F.col(key).alias("key"), F.col("signals").alias("theirs"), "batch_count")
    both = near.join(mine, "query").join(theirs, "key").filter(may_merge(F.col("mine"), F.col("theirs")))
    return both.groupBy("query").agg(F.sum("batch_count").alias("historical_count"), F.count("*").alias("similar"))
