"""Greedy grouping of keywords within a scope, in alphabetic order: each joins the first group that takes it."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models import hash_embedder
from .merging import KINDS, fits
from .morphology import SIGNALS

#: Cosine distances for joining a group, and for general words of different signatures.
NEAR, NEAR_STRICT = 0.30, 0.18
PIECE = 24  # characters of the longest part of a word that is looked up; longer words are compared one by one


def pieces(word: str) -> set[str]:
    """What a word holds beside itself, of two characters up to PIECE."""
    return {word[i : i + n] for n in range(2, min(len(word) - 1, PIECE) + 1) for i in range(len(word) - n + 1)}


def signature(signals: dict[str, set[str]], common: set[str]) -> tuple[set[str], str]:
    """(what a keyword is grouped by, its kind): its actions, else its topics, else nouns that others have, too, else
    its predicates, else nothing."""
    for kind, mark, found in (("action", "a", signals["actions"]), ("topic", "n", signals["topics"]), ("topic", "n", signals["nouns"] & common), ("general", "p", signals["predicates"])):
        if found:
            return {f"{mark}:{x}" for x in found}, kind
    return set(), "unknown"


def signal_parts(signals: dict[str, set[str]]) -> set[str]:
    """Predicates, actions and nouns, those with a copula also without it."""
    every = signals["predicates"] | signals["actions"] | signals["nouns"]
    return every | {x[:-2] for x in every if x.endswith("이다") and len(x) > 2}


class Groups:
    """The groups of one scope: sums, the groups of every signature, part, piece and canonical word, signals, the centres
    in one array. Without signals a keyword's words are its signature and its parts."""

    def __init__(self) -> None:
        self.keywords, self.counts, self.scores, self.signals, self.kinds = [], [], [], [], []
        self.of_word, self.of_part, self.of_piece, self.of_canonical, self.long = (defaultdict(set) for _ in range(5))
        self.totals, self.sizes, self.worded = np.zeros((0, 0)), np.zeros(0), np.zeros(0, bool)

    def place(self, words: set[str], parts: set[str], canonicals: set[str], signals: dict[str, set[str]], kind: str, vector: np.ndarray) -> int | None:
        """By canonical word, then by shared signature, then by containment where the guard lets the two merge, then the
        nearest centre that is near enough; of groups with another signature only general ones, and nearer."""
        for known, mine in ((self.of_canonical, canonicals), (self.of_word, words)):
            if hit := [min(known[w]) for w in mine if w in known]:
                return min(hit)
        held = {k for x in parts if len(x) >= 2 for k in self.around(x)}
        for k in sorted(held):
            if fits(signals, self.signals[k]):
                return k
        n = len(self.keywords)
        size = np.linalg.norm(vector) * self.sizes[:n]
        distance = np.where(size > 0, 1 - self.totals[:n] @ vector / np.where(size > 0, size, 1), 2.0) if n else np.zeros(0)
        general = np.array([kind == other == "general" for other in self.kinds], bool)
        near = np.flatnonzero(distance <= np.where(self.worded[:n] & bool(words), np.where(general, NEAR_STRICT, -1.0), NEAR))
        return int(near[distance[near].argmin()]) if len(near) else None

    def around(self, word: str) -> set[int]:
        """Groups of the known parts that hold the word or that it holds; equal ones are no matter of containment."""
        hit = set().union(*[self.of_part[p] for p in pieces(word) if p in self.of_part])
        if len(word) <= PIECE and word in self.of_piece:
            hit |= self.of_piece[word]
        return hit.union(*[k for y, k in self.long.items() if word != y and (word in y or y in word)])

    def add(self, row) -> None:
        words, canonicals, vector = set(row.words), set(row.canonicals), np.array(row.vector, float)
        given = getattr(row, "signals", None)
        signals = {k: set(given[k]) if given is not None else set() for k in KINDS}
        parts, kind = set(getattr(row, "parts", row.words)), getattr(row, "kind", "general")
        k = self.place(words, parts, canonicals, signals, kind, vector)
        if k is None:
            k = len(self.keywords)
            self.keywords.append([])
            self.counts.append(0)
            self.scores.append(0.0)
            self.signals.append({x: set() for x in KINDS})
            self.kinds.append(kind)
            if k == len(self.sizes):
                room = max(64, k)
                self.totals = np.concatenate([self.totals.reshape(k, len(vector)), np.zeros((room, len(vector)))])
                self.sizes, self.worded = np.concatenate([self.sizes, np.zeros(room)]), np.concatenate([self.worded, np.zeros(room, bool)])
        self.keywords[k].append(row.keyword)
        self.counts[k] += row.batch_count
        self.scores[k] += row.score_sum
        self.totals[k] += vector
        self.sizes[k] = np.linalg.norm(self.totals[k])
        self.worded[k] |= bool(words)
        for x in KINDS:
            self.signals[k][x] |= signals[x]
        for w in canonicals:
            self.of_canonical[w].add(k)
        if self.kinds[k] == "unknown":
            self.kinds[k] = kind
        for w in words:
            self.of_word[w].add(k)
        for w in parts:
            if k not in self.of_part[w]:
                self.of_part[w].add(k)
                for p in pieces(w):
                    self.of_piece[p].add(k)
                if len(w) > PIECE:
                    self.long[w].add(k)


def group_keywords(counts: DataFrame, scope: str, synonyms: dict[str, str], tokens: Callable[[Column], Column], embed: Callable[[Column], Column] | None = None, signals: Callable[[Column], Column] | None = None) -> DataFrame:
    """scope, representative (the longest keyword, the first among equals), keywords, batch_count, score_sum.

    counts(scope, keyword, batch_count, score_sum). signals (see ``morphology``) give a keyword's signature and feed the
    guard of the containment step; without them its words do, and nothing is at odds. A scope's keywords meet in one task: they are the vocabulary of one
    shop's selected spans, already counted, not its texts.
    """
    with_signals = signals is not None
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]) if synonyms else None
    words = tokens(F.col("keyword"))
    canonicals = F.array_compact(F.transform(words, lambda w: F.element_at(known, w))) if known is not None else F.array().cast("array<string>")
    ready = counts.select(F.col(scope).cast("string").alias("scope"), "keyword", "batch_count", "score_sum", words.alias("words"), canonicals.alias("canonicals"), (embed or hash_embedder())(F.col("keyword")).alias("vector"), (signals(F.col("keyword")) if signals else F.lit(None).cast(SIGNALS)).alias("signals"))
    ready = ready.withColumn("signals", F.struct(*[F.coalesce(F.col("signals")[k], F.array().cast("array<string>")).alias(k) for k in KINDS]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups, rows = Groups(), rows.sort_values("keyword")
        if with_signals:
            each = [{k: set(x[k]) for k in KINDS} for x in rows["signals"]]
            seen = Counter(n for x in each for n in x["topics"] or x["nouns"])
            known = [signature(x, {n for n in x["nouns"] if seen[n] >= 2}) for x in each]
            rows = rows.assign(words=[w for w, _ in known], kind=[k for _, k in known], parts=list(map(signal_parts, each)))
        for row in rows.itertuples():
            groups.add(row)
        each = zip(groups.keywords, groups.counts, groups.scores, strict=True)
        return pd.DataFrame([(rows["scope"].iloc[0], max(k, key=len), ",".join(sorted(k)), n, score) for k, n, score in each], columns=["scope", "representative", "keywords", "batch_count", "score_sum"])

    return ready.groupBy("scope").applyInPandas(run, "scope string, representative string, keywords string, batch_count long, score_sum double")
