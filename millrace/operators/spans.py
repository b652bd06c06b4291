"""Keyword spans of reviews: scored word windows, vetoes, dominance, and a greedy choice, all on arrays in the row.

Where the scorer is an expression no window leaves its row. A model in Python can't be called inside an array, so its
windows are rows of their own, and rows that share a key are taken together that way.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hashtags, span_tokens
from ..models import Scorer
from ..session import stored
from .keywords import windows

#: Fixed values.
TOP, EPS, MOST_CHARS, OPPOSITE, MARGIN, HIGH, SHAPED_LENGTH = 3, 0.05, 30, 0.5, 0.025, 0.55, 4
SHAPED = r"(?:네요|습니다|어요|아요|해요|게|고|죠|냐)$"


def best_of_each(spans: DataFrame, key: str) -> DataFrame:
    """Of a row's spans with the same text the best, the first among equals."""
    best = spans.groupBy(key, "span").agg(F.max_by(F.struct("start", "width", "score"), F.struct("score", (-F.col("start")).alias("early"))).alias("b"))
    return best.select(key, "span", "b.start", "b.width", "b.score")


def suppressed(spans: DataFrame, key: str, widths: range, eps: float = EPS) -> DataFrame:
    """Without spans inside a longer one that scores at most ``eps`` less: each span names the few that it covers."""
    inner = lambda w: F.transform(F.sequence(F.lit(0), F.col("width") - w), lambda i: F.struct((F.col("start") + i).alias("start"), F.lit(w).alias("width")))
    covers = [F.when(F.col("width") > w, inner(w)) for w in widths[:-1]]
    covered = spans.select(key, (F.col("score") + eps).alias("limit"), F.explode(F.flatten(F.array_compact(F.array(*covers)))).alias("c")).groupBy(key, F.col("c.start").alias("start"), F.col("c.width").alias("width")).agg(F.max("limit").alias("limit"))
    return spans.join(covered, [key, "start", "width"], "left").filter("limit IS NULL OR score > limit").drop("limit")


def greedy(spans: Column, top: int = TOP) -> Column:
    """Texts of at most ``top`` spans that don't overlap: best score first, then the longer, then the earlier."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct((-s["score"]).alias("loss"), (-s["width"]).alias("short"), s["start"].alias("start"), s["span"].alias("span"))))
    kind = "array<struct<loss: double, short: int, start: int, span: string>>"
    clear = lambda s: lambda p: (s["start"] < p["start"] - p["short"]) & (p["start"] < s["start"] - s["short"])
    step = lambda acc, s: F.when((F.size(acc) < top) & ~F.exists(acc, clear(s)), F.array_append(acc, s)).otherwise(acc)
    return F.transform(F.reduce(ordered, F.array().cast(kind), step), lambda s: s["span"])


def is_expression(spark: SparkSession, scorer: Scorer) -> bool:
    """Whether a scorer can be called inside an array: one in Python can't."""
    try:
        spark.range(0).select(F.transform(F.array(F.lit("")), scorer))
    except AnalysisException:
        return False
    return True


def for_label(label: Column, scores: Column) -> tuple[Column, Column]:
    """(score with the label, score against it)."""
    positive = label == "positive"
    return F.when(positive, scores["positive"]).otherwise(scores["negative"]), F.when(positive, scores["negative"]).otherwise(scores["positive"])


def contrary(with_it: Column, against: Column) -> Column:
    return (against > with_it) & (against >= OPPOSITE) & ((against - with_it >= MARGIN) | (against >= HIGH))


def shaped(word: Column) -> Column:
    return word.rlike(SHAPED) & (F.length(word) <= SHAPED_LENGTH)


def chosen_in_row(tokens: DataFrame, key: str, scorer: Scorer, low: int, high: int, top: int) -> DataFrame:
    """key and words of tokens(key, label, tokens), a row each.

    Equal texts are neighbours when sorted by text, and a span's covers are its neighbours when sorted by place, so a row
    takes n log n steps. Columns that a step looks up by place are named there twice or more: Spark then computes them
    first, once a row.
    """
    label = F.col("label")
    vetoed = tokens.withColumn("veto", F.transform("tokens", lambda t: shaped(t) & contrary(*for_label(label, scorer(t)))))
    at = lambda x, k: (x["width"] > k) & F.coalesce(F.get(F.col("veto"), x["start"] + k), F.lit(False))
    any_veto = lambda x: reduce(or_, [at(x, k) for k in range(max(high, 2))])
    open_ones = F.filter(windows(F.col("tokens"), low, high), lambda x: (F.length(x["span"]) <= MOST_CHARS) & ~any_veto(x))
    scored = F.transform(open_ones, lambda x: F.struct(x["span"].alias("span"), x["start"].alias("start"), x["width"].alias("width"), scorer(x["span"]).alias("s")))
    with_it = lambda x: for_label(label, x["s"])[0]
    against = lambda x: for_label(label, x["s"])[1]
    held = F.transform(F.filter(scored, lambda x: with_it(x) >= against(x)), lambda x: F.struct(x["span"].alias("span"), (-with_it(x)).alias("loss"), x["start"].alias("start"), x["width"].alias("width")))
    kept = vetoed.select(key, F.sort_array(held).alias("kept"))
    first = F.filter("kept", lambda x, i: (i == 0) | (x["span"] != F.get(F.col("kept"), i - 1)["span"]))
    placed = F.transform(first, lambda x: F.struct(x["start"].alias("start"), x["width"].alias("width"), x["span"].alias("span"), (-x["loss"]).alias("score")))
    best = kept.select(key, F.sort_array(placed).alias("best"))
    near = (high - low + 1) ** 2  # at most as many spans begin where a cover may, before and after
    covers = lambda x: lambda y: (y["width"] > x["width"]) & (y["start"] <= x["start"]) & (y["start"] + y["width"] >= x["start"] + x["width"]) & (x["score"] <= y["score"] + EPS)
    left = F.filter("best", lambda x, i: ~F.exists(F.slice(F.col("best"), F.greatest(i - near, F.lit(0)) + 1, F.lit(2 * near + 1)), covers(x))) if high > low else F.col("best")
    return best.select(key, greedy(left, top).alias("words"))


def chosen_by_window(tokens: DataFrame, key: str, scorer: Scorer, low: int, high: int, top: int) -> DataFrame:
    """key and words of tokens(key, label, tokens), one row a key that has any. Each distinct window is scored once."""
    spans = tokens.select(key, "label", F.inline(windows(F.col("tokens"), low, high))).filter(F.length("span") <= MOST_CHARS)
    words = spans.select(F.explode(F.split("span", " ")).alias("asked")).filter(shaped(F.col("asked")))
    scores = spans.select(F.col("span").alias("asked")).unionByName(words).distinct().withColumn("s", scorer(F.col("asked")))
    with_it, against = for_label(F.col("label"), F.col("s"))
    scored = spans.join(scores, spans["span"] == scores["asked"]).filter(with_it >= against).select(key, "label", "start", "width", "span", with_it.alias("score"))
    each = scored.select(key, "label", "start", "width", F.explode(F.split("span", " ")).alias("asked")).filter(shaped(F.col("asked"))).join(scores, "asked").filter(contrary(with_it, against))
    kept = scored.join(each.select(key, "start", "width").distinct(), [key, "start", "width"], "left_anti")
    left = suppressed(best_of_each(kept, key), key, range(low, high + 1)) if high > low else best_of_each(kept, key)
    return left.groupBy(key).agg(F.collect_list(F.struct("start", "width", "span", "score")).alias("spans")).select(key, greedy(F.col("spans"), top).alias("words"))


def span_keywords(rows: DataFrame, key: str, text: str, label: str, scorer: Scorer, *, low: int = 2, high: int = 3, top: int = TOP) -> DataFrame:
    """key and keywords (#a#b#c; empty where none) of every row with a label.

    Windows that score for the label are kept, unless one of their sentiment-shaped words clearly scores against it;
    then the best of equal texts, without dominated ones, are chosen greedily. Rows that share their key share their
    windows; a row without a key has none.
    """
    tagged = lambda df: df.select(F.col(key), F.col(label).alias("label"), span_tokens(F.col(text)).alias("tokens"))
    named = lambda words: F.coalesce(hashtags(words), F.lit("")).alias("keywords")
    joined = lambda df: df.select(key).join(chosen_by_window(tagged(df), key, scorer, low, high, top), key, "left").select(key, named(F.col("words")))
    if not is_expression(rows.sparkSession, scorer):
        return joined(rows)
    one_each = lambda df: chosen_in_row(tagged(df), key, scorer, low, high, top).select(key, F.when(F.col(key).isNull(), "").otherwise(named(F.col("words"))).alias("keywords"))
    repeated = stored(rows.groupBy(key).agg(F.count("*").alias("n")).filter(f"n > 1 AND {key} IS NOT NULL").select(key), "repeated")
    if repeated.isEmpty():
        return one_each(rows)
    return one_each(rows.join(repeated, key, "left_anti")).unionByName(joined(rows.join(repeated, key, "left_semi")))
