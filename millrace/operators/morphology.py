"""Morphemes of short Korean texts: a word lattice over a dictionary, its cheapest path, and the signals in it.

The dictionary is a table of forms and tags; what a form costs is estimated from a corpus in Spark. A word's lattice has
an edge for every form of the dictionary and for runs the dictionary doesn't know, and the cheapest path wins, where
endings, particles and the like pay for standing in the wrong place. The signals of a keyword (predicates, actions,
nouns, topics) come from one scan over its morphemes; ``merging.may_merge`` compares them.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import small_side

#: Tags of nouns, of nouns that can be topics, of what goes before and after nouns, of predicates, of what
#: makes predicates, and predicate stems that say nothing alone.
NOUNS, TOPIC_NOUNS, BEFORE_NOUN, AFTER_NOUN = {"NNG", "NNP", "NNB"}, {"NNG", "NNP"}, {"XPN"}, {"XSN"}
PREDICATES, VERBALIZERS, GENERIC = {"VV", "VA", "VX"}, {"XSV", "XSA"}, {"있", "없", "하", "되", "이", "같"}
MOST_FORMS = 1_000_000  # rows of a dictionary that every worker holds
UNKNOWN, UNKNOWN_CHAR, MISPLACED = 9.0, 2.5, 8.0  # costs of a run the dictionary doesn't know, of each of its characters, of a tag where it can't stand
LONGEST_UNKNOWN = 6
SIGNALS = "struct<predicates: array<string>, actions: array<string>, nouns: array<string>, topics: array<string>>"
Morphemes = list[tuple[str, str]]


def dictionary_costs(dictionary: DataFrame, texts: DataFrame) -> DataFrame:
    """form, tag, cost of dictionary(form, tag): -ln of the form's share of all places in texts(text) where a form of
    the dictionary stands, plus the logarithm of its number of tags.

    Words are counted first, so a frequent word is cut into substrings once. Blank and repeated entries don't count.
    """
    forms = dictionary.select(F.trim("form").alias("form"), "tag").filter("form <> '' AND tag IS NOT NULL").distinct()
    longest = forms.agg(F.coalesce(F.max(F.length("form")), F.lit(0))).first()[0]
    words = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    starts = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", k, longest))).alias("rest"))
    parts = starts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("rest")), lambda k: F.substring("rest", F.lit(1), k))).alias("form"))
    known = forms.groupBy("form").agg(F.count("*").alias("tags"))
    counts = parts.join(small_side(known.select("form"), 200_000), "form").groupBy("form").agg(F.sum("n").alias("n"))
    sizes = known.join(counts, "form", "left").select("form", "tags", F.coalesce("n", F.lit(0)).alias("n"))
    whole = sizes.agg(F.sum(F.col("n") + 1).alias("whole"))
    share = sizes.join(F.broadcast(whole)).select("form", (F.log("tags") - F.log((F.col("n") + 1) / F.col("whole"))).alias("cost"))  # one row of sums
    return forms.join(share, "form").select("form", "tag", "cost")


def kind(c: str) -> str:
    """The tag of a run of characters that no dictionary has."""
    if c.isascii():
        return "SL" if c.isalpha() else "SN" if c.isdigit() else "SW"
    return "NNG" if unicodedata.category(c)[0] == "L" else "SW"


def misplaced(before: str, tag: str) -> bool:
    """Whether a tag can't follow the one before it in a word; "" is the word's start."""
    nominal = before in NOUNS or before in AFTER_NOUN or before in ("NR", "NP", "SL", "SN", "ETN")
    if tag[0] == "J":
        return not (nominal or before[:1] == "J" or before in ("MAG", "EC"))
    if tag[0] == "E":
        return not (before in PREDICATES or before in VERBALIZERS or before in ("VCP", "VCN", "EP"))
    if tag in VERBALIZERS:
        return not (nominal or before in ("MAG", "XR"))
    if tag == "VCP":
        return not (nominal or before == "MAG")
    if tag in PREDICATES:  # a stem begins a word, or follows an ending or an adverb
        return nominal or before == "XR"
    return tag in AFTER_NOUN and not nominal


class Lattice:
    def __init__(self, entries: list[tuple[str, str, float]]) -> None:
        self.forms: dict[str, list[tuple[str, float]]] = {}
        for form, tag, cost in entries:
            self.forms.setdefault(form, []).append((tag, cost))
        self.longest = max(map(len, self.forms), default=0)

    def edges(self, word: str, at: int) -> Iterator[tuple[int, str, float]]:
        """(end, tag, cost) of what may begin at a place: forms, and unknown runs of one kind of character."""
        for end in range(at + 1, min(len(word), at + self.longest) + 1):
            for tag, cost in self.forms.get(word[at:end], ()):
                yield end, tag, cost
        tag, end = kind(word[at]), at + 1
        if tag == "NNG":
            while end <= min(len(word), at + LONGEST_UNKNOWN) and kind(word[end - 1]) == tag:
                yield end, tag, UNKNOWN + UNKNOWN_CHAR * (end - at)
                end += 1
        else:  # foreign words, numbers and marks stay whole
            while end < len(word) and kind(word[end]) == tag:
                end += 1
            yield end, tag, UNKNOWN + UNKNOWN_CHAR

    def word(self, word: str) -> tuple[float, Morphemes]:
        """The cheapest path; of equals the one with fewer morphemes, then the one found first."""
        best: list[dict[str, tuple[float, int, int, str]]] = [{} for _ in range(len(word) + 1)]
        best[0][""] = (0.0, 0, -1, "")
        for at in range(len(word)):
            if not best[at]:
                continue
            for end, tag, cost in self.edges(word, at):
                for before, (so_far, n, _, _) in best[at].items():
                    total = so_far + cost + MISPLACED * misplaced(before, tag)
                    if (total, n + 1) < best[end].get(tag, (math.inf, 0))[:2]:
                        best[end][tag] = (total, n + 1, at, before)
        if not word:
            return 0.0, []
        at, tag = len(word), min(best[-1], key=lambda t: best[-1][t][:2])
        total, out = best[at][tag][0], []
        while at:
            _, _, start, before = best[at][tag]
            out.append((word[start:at], tag))
            at, tag = start, before
        return total, out[::-1]

    def morphemes(self, text: str) -> Morphemes:
        return [m for word in text.split() for m in self.word(word)[1]]


def scan(morphemes: Morphemes) -> tuple[list[str], list[str], list[str], list[str]]:
    """(predicates, actions, nouns, topics), each once, in order.

    What a verb can build on is held until it comes, or until a particle or ending closes the phrase: a run of nouns
    with its affixes, an adverb, a root. A verb-making suffix builds a predicate and an action on the root, the adverb
    or the nouns, in that order; the copula a predicate on adverb or nouns; a verb or adjective stands for itself, but a
    generic one leans on its nouns, and a verb after an adverb is an action. Without a predicate the nouns stand for
    one. The first noun is the topic if the keyword begins with a noun and has a predicate, unless it only says what
    the one noun is.
    """
    predicates: list[str] = []
    actions: list[str] = []
    held = {"root": "", "adverb": "", "nouns": ""}
    clear = lambda *names: held.update(dict.fromkeys(names or held, ""))
    for form, tag in morphemes:
        if tag in NOUNS or tag in BEFORE_NOUN:
            held["nouns"] += form
            clear("root", "adverb")
        elif tag in AFTER_NOUN:
            held["nouns"] += form if held["nouns"] else ""
        elif tag in ("MAG", "XR"):
            held["adverb" if tag == "MAG" else "root"] = form
        elif tag in VERBALIZERS:
            if base := next((name for name in held if held[name]), None):
                made = f"{held[base]}{form}다"
                predicates.append(made)
                actions.append(made)
                clear(*(() if base == "root" else (base,)))
        elif tag == "VCP":
            if base := held["adverb"] or held["nouns"]:
                predicates.append(f"{base}이다")
            clear()
        elif tag in PREDICATES:
            predicates.append(f"{held['nouns']}_{form}다" if form in GENERIC and held["nouns"] else f"{form}다")
            if tag == "VV" and held["adverb"]:
                actions.append(f"{held['adverb']}{form}다")
            clear()
        elif tag[0] in "JE":
            clear()
    if not predicates and held["nouns"]:
        predicates.append(held["nouns"])
    tags = [tag for _, tag in morphemes]
    nouns = [form for form, tag in morphemes if tag in TOPIC_NOUNS]
    verbal = any(tag in PREDICATES or tag in VERBALIZERS for tag in tags)
    if not actions and not verbal and "VCP" not in tags and nouns:
        actions.append("".join(nouns))
    first = next((tag for tag in tags if tag[0] not in "JE"), "")
    nominal = "VCP" in tags and not verbal and len(nouns) == 1
    about = nouns[:1] if nouns and (verbal or "VCP" in tags) and not nominal and (first in NOUNS or first in BEFORE_NOUN) else []
    return tuple(list(dict.fromkeys(x)) for x in (predicates, actions, nouns, about))


def entries_of(costs: DataFrame) -> list[tuple[str, str, float]]:
    """The dictionary, to be held by every worker; too large a one is an error."""
    rows = costs.select("form", "tag", "cost").limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"a dictionary of more than {MOST_FORMS} entries")
    return sorted(tuple(r) for r in rows)


def signals_of(costs: DataFrame) -> Callable[[Column], Column]:
    """A function of a keyword column: its signals, see scan(); all empty for null."""
    held = costs.sparkSession.sparkContext.broadcast(entries_of(costs))  # at most MOST_FORMS rows

    @F.pandas_udf(SIGNALS)
    def signals(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(held.value)
        for texts in batches:
            known = {t: scan(lattice.morphemes(t)) for t in set(texts.dropna())}
            rows = [known[t] if isinstance(t, str) else ([], [], [], []) for t in texts]
            yield pd.DataFrame(rows, columns=["predicates", "actions", "nouns", "topics"])

    return signals
