"""Dictionaries of any size matched in one pass over Arrow batches of texts.

Aliases of ASCII are filed under their first token, which the text's own tokens look up; an alias of several tokens is
then compared where it may stand. Aliases of other scripts stand inside words, too: an automaton of all of them reads the
text once. So a text costs its length and its hits, whatever the number of aliases. The index is built once a Python
worker; the dictionary travels with the function, so it should be some megabytes at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile("[a-z0-9]+")
_INDEXES: dict[Sequence[tuple[str, Sequence[str]]], AliasIndex] = {}


def stands(text: str, alias: str) -> bool:
    """Whether the alias stands in the text between other characters than a-z and 0-9."""
    at = text.find(alias)
    while at >= 0:
        end = at + len(alias)
        if not (TOKEN.match(text, end) or (at and TOKEN.match(text, at - 1))):
            return True
        at = text.find(alias, at + 1)
    return False


class AliasIndex:
    """entries: (code, aliases). Aliases of ASCII stand between other characters than a-z and 0-9, others anywhere."""

    def __init__(self, entries: Sequence[tuple[str, Sequence[str]]]) -> None:
        self.codes = [code for code, _ in entries]
        self.first: dict[str, list[tuple[str, int]]] = {}  # token: aliases that begin with it
        self.bare: list[tuple[str, int]] = []  # aliases without a token, compared one by one
        inside: dict[str, list[int]] = {}
        for n, (_, aliases) in enumerate(entries):
            for alias in map(str.lower, aliases):
                if not alias.isascii():
                    inside.setdefault(alias, []).append(n)
                elif token := TOKEN.search(alias):
                    self.first.setdefault(token[0], []).append((alias, n))
                else:
                    self.bare.append((alias, n))
        self.inside = None
        if inside:
            self.inside = ahocorasick.Automaton()
            for alias, numbers in inside.items():
                self.inside.add_word(alias, numbers)
            self.inside.make_automaton()

    def find(self, lowered: str) -> list[str]:
        """Codes of the aliases in a lower-cased text, in the order of the entries."""
        found = {n for alias, n in self.bare if stands(lowered, alias)}
        for token in self.first.keys() & set(TOKEN.findall(lowered)):
            for alias, n in self.first[token]:
                if n not in found and (alias == token or stands(lowered, alias)):
                    found.add(n)
        if self.inside is not None and not lowered.isascii():
            for _, numbers in self.inside.iter(lowered):
                found.update(numbers)
        return [self.codes[n] for n in sorted(found)]


def matcher(entries: Sequence[tuple[str, Sequence[str]]]) -> Callable[[Column], Column]:
    """A function of a text column: array of the codes whose aliases it has, case aside; empty for null."""
    kept = tuple((code, tuple(aliases)) for code, aliases in entries)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def codes(lowered: pd.Series) -> pd.Series:
        if kept not in _INDEXES:
            _INDEXES[kept] = AliasIndex(kept)
        find = _INDEXES[kept].find
        return pd.Series([find(x) if isinstance(x, str) else [] for x in lowered], dtype=object)

    return lambda text: codes(F.lower(text))
