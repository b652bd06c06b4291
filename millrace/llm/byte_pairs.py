"""Byte-level BPE encoding and decoding with an index of pair occurrences.

The words that a group of texts newly brings are laid side by side as byte symbols, and an index maps every pair that
has a rank to all its positions in all those words. Active ranks are taken in ascending order; taking one merges its
pair at each of its positions, from left to right, and moves the entries of the pairs to the left and right. So a rank
is looked at once for a whole group, whatever the number of words, and a merge costs the same in a word of a million
letters. That is the library's order (least rank first, leftmost among equals) as long as no merge makes a pair of a
lower rank, which the vocabulary is checked for.

Texts are cut where a space stands before something that is no white space: no word of the vocabulary's splitting
reaches across. Ids, and the bytes they decode to, are kept for the parts in a bounded cache in each Python worker.
Characters are classed as letters, numbers and spaces by the library itself when a worker first meets them; a text with
a character that the splitting expression here would class otherwise goes through the library (column by_library).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the splitting expression takes it (fixed value), and the expression: contractions, then runs of
#: letters, of numbers and of others, each with a space before, then white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
MOST, LONGEST = 700_000, 100  # parts kept, and their characters
GROUP = 1_500_000  # characters of texts whose new words are indexed together
_CODERS: dict[str, PairCoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: printable bytes are themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Kept:
    """Ids and decoded bytes by text."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.read: dict[str, bytes] = {}

    def put(self, text: str, ids: bytes, read: bytes) -> None:
        self.ids[text], self.read[text] = ids, read

    def bound(self, most: int, long: set[str]) -> None:
        """Empties itself above ``most`` texts; the long ones go in any case."""
        for kept in (self.ids, self.read):
            if len(kept) > most:
                kept.clear()
            for text in long:
                kept.pop(text, None)


class PairCoder:
    def __init__(self, path: str, most: int = MOST) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ids = model["model"]["vocab"]
        letters = byte_letters()
        self.single = {letters[c]: ids[c] for c in letters if c in ids}
        self.spelled = {i: bytes(map(letters.__getitem__, piece)) for piece, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.spelled |= {i: t.encode() for t, i in self.special.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.spelled}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.pairs = [(ids[a], ids[b], ids[a + b]) for a, b in merges]  # by rank
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.pairs)}
        latest = {made: rank for rank, (_, _, made) in enumerate(self.pairs)}
        if any(latest.get(part, -1) >= rank for (a, b), rank in self.ranks.items() for part in (a, b)):
            raise ValueError("a merge of this vocabulary can make a pair of a lower rank: ascending ranks don't give the library's ids")
        self.words = regex.compile(WORDS)
        self.white = re.compile(f"[{WHITE}]")
        self.idle = re.compile(rf" (?:[{WHITE}]|\Z)")  # a space before which no text may be cut
        self.cut = re.compile(f"(?= [^{WHITE}])")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.starts = {t[:2] for t in self.special}
        # ids, and the bytes they decode to: of a space and a part, of a part without a space before it, of a word
        self.known, self.first, self.coded = Kept(), Kept(), Kept()
        self.sound: set[str] = {chr(c) for c in range(128)}
        self.odd: set[str] = set()
        self.long: set[str] = set()  # parts and words too long to be kept after their group

    def merge(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of each word, by one index over all of them."""
        rank_of, single = self.ranks.get, self.single.__getitem__
        symbol: list[int] = []
        ends = []
        for word in words:
            symbol += map(single, word)
            ends.append(len(symbol))
            symbol.append(-1)  # stands between words; no pair has it
        n = len(symbol)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        index: list[list[int] | None] = [None] * len(self.pairs)  # by rank: positions of the pair's left symbol
        for k, rank in enumerate(map(rank_of, zip(symbol, islice(symbol, 1, None)))):
            if rank is not None:
                if (at := index[rank]) is None:
                    index[rank] = [k]
                else:
                    at.append(k)
        for rank, (left, right, made) in enumerate(self.pairs):  # what a merge adds has a higher rank
            if (positions := index[rank]) is None:
                continue
            index[rank] = None
            positions.sort()  # a list grows by several ranks; equal neighbours are taken from the left
            for k in positions:
                if symbol[k] != left or symbol[j := after[k]] != right:
                    continue  # a merge before has taken one of the two
                symbol[k], symbol[j] = made, -2
                after[k] = j = after[j]
                before[j] = k
                if (more := rank_of((made, symbol[j]))) is not None:
                    if (at := index[more]) is None:
                        index[more] = [k]
                    else:
                        at.append(k)
                if (j := before[k]) >= 0 and (more := rank_of((symbol[j], made))) is not None:
                    if (at := index[more]) is None:
                        index[more] = [j]
                    else:
                        at.append(j)
        out, low = [], 0
        for end in ends:
            out.append([s for s in symbol[low:end] if s >= 0])
            low = end + 1
        return out

    def classes_differ(self, text: str) -> bool:
        """Whether text has a character that the library doesn't class as the expression here does."""
        if text.isascii():
            return False
        letters = set(text)
        if fresh := letters - self.sound - self.odd:
            for c in fresh:
                kind = "a" if regex.match(r"\p{L}", c) else "1" if regex.match(r"\p{N}", c) else " " if self.white.match(c) else "."
                probe = f"{kind}{c}{kind} {c} {c}b"
                mine = [m.span() for m in self.words.finditer(probe)]
                theirs = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
                (self.sound if mine == theirs else self.odd).add(c)
        return bool(self.odd and letters & self.odd)

    def learn(self, parts: list[str], firsts: list[str]) -> None:
        """Keeps ids and decoded bytes of parts after a space, and of first parts."""
        split = [self.words.findall(" " + w) for w in parts] + [self.words.findall(w) for w in firsts]
        ids_of, read_of = self.coded.ids, self.coded.read
        words = list({w for s in split for w in s}.difference(ids_of))
        self.long.update(w for group in (parts, firsts, words) for w in group if len(w) > LONGEST)
        for word, ids in zip(words, self.merge([w.encode() for w in words]), strict=True):
            self.coded.put(word, b"".join([self.packed[i] for i in ids]), self.decode(ids).encode())
        for kept, names, of in ((self.known, parts, split), (self.first, firsts, split[len(parts) :])):
            for name, s in zip(names, of, strict=False):
                if len(s) == 1:
                    kept.put(name, ids_of[s[0]], read_of[s[0]])
                else:
                    kept.put(name, b"".join([ids_of[w] for w in s]), b"".join([read_of[w] for w in s]))

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False): bytes of no character become U+FFFD; ids beyond
        the vocabulary are passed over."""
        return b"".join([self.spelled.get(i, b"") for i in ids]).decode(errors="replace")

    def parts(self, text: str) -> list[str]:
        """Parts whose ids in turn are the text's; all but the first have lost a space."""
        if not self.idle.search(text):
            return text.split(" ")
        first, *rest = self.cut.split(text)
        return [first, *[w[1:] for w in rest]]

    def encode(self, texts: Sequence[str]) -> list[tuple[bytes, bytes, bool]]:
        """(little-endian 32-bit ids, decoded text in UTF-8, whether the library gave them) of each text."""
        out: list[tuple[bytes, bytes, bool]] = []
        low, size = 0, 0
        for high, text in enumerate(texts):
            size += len(text)
            if size >= GROUP or high + 1 == len(texts):
                out += self.encode_group(texts[low : high + 1])
                low, size = high + 1, 0
        return out

    def encode_group(self, texts: Sequence[str]) -> list[tuple[bytes, bytes, bool]]:
        plans: list[list[list[str] | int] | None] = []
        new: set[str] = set()
        new_first: set[str] = set()
        for text in texts:
            if self.classes_differ(text):
                plans.append(None)
                continue
            pieces = self.marks.split(text) if any(s in text for s in self.starts) else [text]
            plan: list[list[str] | int] = []
            for piece in pieces:
                if piece in self.special:
                    plan.append(self.special[piece])
                elif piece:
                    plan.append(parts := self.parts(piece))
                    new.update(parts[1:])
                    new_first.add(parts[0])
            plans.append(plan)
        self.learn(list(new.difference(self.known.ids)), list(new_first.difference(self.first.ids)))
        id_of, read_of = self.known.ids.__getitem__, self.known.read.__getitem__
        out = []
        for text, plan in zip(texts, plans, strict=True):
            if plan is None:
                ids = self.library.encode(text, add_special_tokens=False).ids
                out.append((b"".join([self.packed[i] for i in ids]), self.library.decode(ids, skip_special_tokens=False).encode(), True))
                continue
            coded, read = [], []
            for parts in plan:
                if isinstance(parts, int):
                    coded.append(self.packed[parts])
                    read.append(self.spelled[parts])
                else:
                    coded.append(self.first.ids[parts[0]])
                    read.append(self.first.read[parts[0]])
                    coded += map(id_of, islice(parts, 1, None))
                    read += map(read_of, islice(parts, 1, None))
            out.append((b"".join(coded), b"".join(read), False))
        for kept in (self.known, self.first, self.coded):
            kept.bound(self.most, self.long)
        self.long.clear()
        return out


def coder(name: str) -> PairCoder:
    if name not in _CODERS:
        _CODERS[name] = PairCoder(public_tokenizers.path(name) if "/" not in name else name)
    return _CODERS[name]


def encode_pairs(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array), decoded, by_library of every row. Null and empty texts have no ids and decode to "".

    Strings of special tokens in a text become their ids, as the library does. Rows that repeat are encoded as often as
    they come; no shuffle, and a text never leaves its row. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                made = pairs.encode([x or "" for x in part.column(1).to_pylist()])
                ids = pa.array([memoryview(i).cast("i") if i else [] for i, _, _ in made], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([t.decode() for _, t, _ in made], pa.string()), pa.array([b for _, _, b in made], pa.bool_())], names=["doc_id", "ids", "decoded", "by_library"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string, by_library boolean")


def pair_digests(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, by_library of encode_pairs(), digested where texts are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(vocabulary)
        for batch in batches:
            made = []
            for low in range(0, batch.num_rows, 512):
                for ids, text, by_library in pairs.encode([x or "" for x in batch.column(1).slice(low, 512).to_pylist()]):
                    made.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), by_library))
            counts, of_ids, of_texts, libraries = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()), pa.array(libraries, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "by_library"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, by_library boolean")
