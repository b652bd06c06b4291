"""Models behind small interfaces, with deterministic stand-ins. A model is given to an operator, never looked up.

A scorer turns a text column into (positive, negative) probabilities; a tokenizer into an array of tokens; an embedder
into a vector; a client answers prompts. Real models come in as Arrow functions (``batched``) with the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[Column], Column]


def batched(load: Callable[[], Callable[[list[str]], list]], kind: str) -> Callable[[Column], Column]:
    """A column function of a model: loaded once a worker, called with a batch of texts at a time."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return run


def hash_scorer(text: Column) -> Column:
    """(positive, negative) that the text's sha256 fixes."""
    p = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(2**32)
    both = lambda x: F.struct(x.alias("positive"), (1 - x).alias("negative"))
    return F.get(F.transform(F.array(p), both), F.lit(0))  # inside an array p would be computed for either


def lexicon_scorer(good: tuple[str, ...], bad: tuple[str, ...]) -> Scorer:
    """(positive, negative) by the words that a text has; ties are positive."""

    def score(text: Column) -> Column:
        count = lambda words: sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
        p = (count(good) + 1.0) / (count(good) + count(bad) + 2.0)
        return F.struct(p.alias("positive"), (1 - p).alias("negative"))

    return score


def label(scores: Column) -> Column:
    return F.when(scores["positive"] >= scores["negative"], "positive").otherwise("negative")


def word_tokenizer(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hash_embedder(size: int = 16) -> Callable[[Column], Column]:
    """A vector of pseudo-random signs, summed over the words, so that texts of the same words are near."""

    def embed(text: Column) -> Column:
        words = word_tokenizer(text)
        part = lambda k: F.reduce(F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(k)), F.lit(2)) == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x)
        return F.array(*[part(k) for k in range(size)])

    return embed


class EchoClient:
    """A client that answers with the first keyword candidates it is given; ``fails`` lists articles it refuses."""

    def __init__(self, fails: tuple[str, ...] = ()) -> None:
        self.fails = fails

    def classify(self, article_id: str, candidates: list[str]) -> list[dict]:
        if article_id in self.fails:
            raise RuntimeError("no answer")
        return [{"name": c, "type": "Technology", "confidence": 0.8} for c in candidates]
