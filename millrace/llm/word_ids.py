"""Token ids of a word-separable BPE vocabulary, with a bounded cache of words in each Python worker."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Controls that Python takes for white space and the vocabulary doesn't, and starts of special tokens.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Letters that stay single characters when lower-cased or composed, and ASCII punctuation but the apostrophe.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<end>[!-&(-/:-@\[-`{-~]*)$"
AT_ONCE = 1_500_000  # characters of texts that are cut into words together
_ENCODERS: dict[str, WordEncoder] = {}


def joined(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units in turn, how many each has)."""
    return np.frombuffer(b"".join(units), "<u4"), np.fromiter(map(len, units), np.int64, len(units)) // 4


def gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units numbered by ``at``, in that order, how many each has)."""
    each = sizes[at]
    before = np.cumsum(each) - each
    return ids[np.arange(int(each.sum())) + np.repeat((np.cumsum(sizes) - sizes)[at] - before, each)], each


class WordEncoder:
    """encode(): little-endian unsigned 32-bit ids of each text, as tokenizers gives them without special tokens.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        pieces = self.tokenizer.get_vocab()
        self.last = np.zeros(max(pieces.values()) + 1, bool)  # whether an id ends a word
        self.last[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, stems: list[str], rest: list[str]) -> None:
        """Keeps the ids of plain stems and of other words that are not known yet."""
        known = self.known
        stems, rest = [w for w in stems if w not in known], [w for w in rest if w not in known]
        if stems:  # each stem is one word of the vocabulary's own splitting, so it has one id that ends a word, its last
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
            ends, whole = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), ids.tobytes()
            known.update(zip(stems, map(whole.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        known.update(zip(rest, self.whole(rest), strict=True))

    def spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) of the distinct words: a plain word is a stem, lower-cased, and an end."""
        stem, end = pc.extract_regex(words, PLAIN).flatten()  # null where a word is not plain
        stems, others = pc.utf8_lower(stem).dictionary_encode(), pc.coalesce(end, words).dictionary_encode()
        firsts, lasts = stems.dictionary.to_pylist(), others.dictionary.to_pylist()
        self.learn(firsts, lasts)
        units = [*map(self.known.__getitem__, firsts), *map(self.known.__getitem__, lasts), b""]
        if len(self.known) > self.most:
            self.known.clear()
        at = np.empty(2 * len(words), np.int64)
        at[0::2] = stems.indices.fill_null(len(units) - 1).to_numpy()
        at[1::2] = others.indices.to_numpy() + len(firsts)
        ids, each = gathered(*joined(units), at)
        return ids, each.reshape(-1, 2).sum(axis=1)

    def encode_some(self, texts: list[str]) -> Iterator[bytes]:
        cut = [[] if any(c in text for c in ODD) else text.split() for text in texts]
        every = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        flat, each = gathered(*self.spelled(every.dictionary), every.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *map(len, cut)])].tolist()
        for text, own, a, b in zip(texts, cut, bounds[:-1], bounds[1:], strict=True):
            yield flat[a:b].tobytes() if own or not text else self.whole([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, low, held = [], 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= AT_ONCE or k == len(texts) - 1:
                out += self.encode_some(texts[low : k + 1])
                low, held = k + 1, 0
        return out


def encoder(name: str) -> WordEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(public_tokenizers.path(name) if "/" not in name else name)
    return _ENCODERS[name]
