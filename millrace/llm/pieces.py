"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

encode(): symbols of one text form a chain; an agenda holds adjacent pairs that the vocabulary knows, best score
first and leftmost among equals; taking a pair merges it and offers its new neighbours. Characters that no piece has
become bytes. A text is cut where no merge can reach across (before a run of spaces, and between two characters that
stand side by side in no piece), and the ids of the parts are kept in a bounded cache. Per Arrow batch, the parts that
it newly brings are held against the sentencepiece library, in both directions; where they differ, the batch is done
again by the library, and so are all later ones of that worker. A column says which rows those are.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
LONGEST, MOST = 40, 700_000  # characters of a cached part or word; how many of each are kept
FEW, NEVER = 24, float("-inf")  # characters of a part whose agenda is a plain list; score of no pair
_CODERS: dict[str, PieceCoder] = {}


class PieceCoder:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][3:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.last_odd = max([*self.silent, *self.of_byte])
        self.end = sp.eos_id()
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(SPACE in p.strip(SPACE) or (p.strip(SPACE) and p.endswith(SPACE)) for p in self.ids):
            raise ValueError("this vocabulary has pieces that go on after a space: texts cannot be cut at spaces")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.fresh: list[str] = []
        self.spelled: dict[str, str] = {}
        self.read: dict[str, str] = {}
        self.differs = False  # whether the library has ever been seen to give something else

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the agenda."""
        symbols = self.merge_few(part) if len(part) <= FEW else self.merge_many(part)
        out: list[int] = []
        for x in symbols:
            i = self.ids.get(x)
            out += [i] if i is not None else [self.byte[b] for b in x.encode()]
        return out

    def merge_few(self, part: str) -> list[str]:
        """Symbols of a short part: the agenda is a list of the pairs' scores beside the symbols."""
        score, symbols = self.score.get, list(part)
        agenda = [score(part[k : k + 2], NEVER) for k in range(len(part) - 1)]
        while agenda and (best := max(agenda)) is not NEVER:
            k = agenda.index(best)
            symbols[k : k + 2] = [made := symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = score(made + symbols[k + 1], NEVER)
            if k:
                agenda[k - 1] = score(symbols[k - 1] + made, NEVER)
        return symbols

    def merge_many(self, part: str) -> list[str]:
        """Symbols of a long part: the agenda is a heap, and pairs that have changed meanwhile are passed over."""
        n, score = len(part), self.score
        symbols: list[str] = list(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, k, k + 1, pair) for k in range(n - 1) if (s := score.get(pair := part[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, made = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(made) or after[left] != right:
                continue
            symbols[left], symbols[right] = made, ""
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                if (s := score.get(pair := made + symbols[nxt])) is not None:
                    heapq.heappush(agenda, (-s, left, nxt, pair))
            if (prev := before[left]) >= 0 and (s := score.get(pair := symbols[prev] + made)) is not None:
                heapq.heappush(agenda, (-s, prev, left, pair))
        return [x for x in symbols if x]

    def parts(self, chunk: str) -> list[str]:
        """The chunk, cut between characters that no piece has side by side; a short one before its last only."""
        if len(chunk) <= LONGEST:
            return [chunk[:-1], chunk[-1]] if len(chunk) > 1 and chunk[-2:] not in self.beside else [chunk]
        at = [k + 1 for k in range(len(chunk) - 1) if chunk[k : k + 2] not in self.beside]
        return [chunk[a:b] for a, b in zip([0, *at], [*at, len(chunk)], strict=True)]

    def look_up(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        for part in self.parts(chunk):
            if (got := self.known.get(part)) is None:
                got = tuple(self.merge(part))
                self.fresh.append(part)
                if len(part) <= LONGEST:
                    self.known[part] = got
            ids += got
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids without an end: as the library's encode(text) where it normalizes nothing but spaces."""
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for chunk in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            ids += known.get(chunk) or self.look_up(chunk)
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's decode(ids): without the leading space that encoding adds; wrong bytes become U+FFFD."""
        pieces, of_byte = self.pieces, self.of_byte
        if ids and min(ids) > self.last_odd:
            text = "".join([pieces[i] for i in ids])
            return text.removeprefix(SPACE).replace(SPACE, " ")
        out: list[str] = []
        run: list[bytes] = []
        for i in ids:
            if (b := of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(spelled(b"".join(run)))
                run = []
            if i not in self.silent:
                out.append(pieces[i])
        if run:
            out.append(spelled(b"".join(run)))
        text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ") if out and out[0].startswith(SPACE) else text.replace(SPACE, " ")

    def digits(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by spaces, decoded text) of a text with the end id, put together from its words."""
        words = text.split(" ")
        if not text or SPACE in text or "" in words:  # runs of spaces make pieces of their own
            ids = [*self.encode(text), self.end]
            return " ".join(map(str, ids)), self.decode(ids)
        spelled, read = self.spelled, self.read
        for word in set(words).difference(spelled):
            ids = self.look_up(SPACE + word)
            spelled[word], read[word] = " ".join(map(str, ids)), self.decode(ids)
        out = f"{' '.join(map(spelled.__getitem__, words))} {self.end}", " ".join(map(read.__getitem__, words))
        if len(spelled) > MOST:
            spelled.clear()
            read.clear()
        return out

    def by_library(self, text: str) -> tuple[list[int], str]:
        """(ids with the end, decoded text) as the library gives them."""
        ids = [*self.library.encode(text, num_threads=1), self.end]
        return ids, self.library.decode(ids, num_threads=1)

    def check(self) -> None:
        """Holds the newly met parts against the library, ids and decoded text, and notes if they differ; then bounds
        the cache."""
        fresh, self.fresh = self.fresh, []
        head = self.library.encode("\n", num_threads=1)
        for k in range(0, len(fresh), 20_000):
            asked = fresh[k : k + 20_000]
            given = self.library.encode(["\n" + part.replace(SPACE, " ") for part in asked], num_threads=1)
            read = self.library.decode(given)
            for part, ids, text in zip(asked, given, read, strict=True):
                mine = list(self.known.get(part) or self.merge(part))
                self.differs |= ids != head + mine or text != self.decode(ids)
        if len(self.known) > MOST:
            self.known.clear()


def spelled(run: bytes) -> str:
    """Bytes in UTF-8; each byte that belongs to no character is U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[k : k + size].decode())
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


def coder(model: str) -> PieceCoder:
    if model not in _CODERS:
        _CODERS[model] = PieceCoder(public_tokenizers.path(model) if "/" not in model else model)
    return _CODERS[model]


def encode_pieces(docs: DataFrame, *, model: str = "piece_bpe_32k.model", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array, the end id last), decoded, by_library. Null and empty texts are the end id alone and
    decode to "".

    Rows that repeat are encoded as often as they come; no shuffle, and a text never leaves its row. Other columns
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                if not pieces.differs:
                    ids = [[*pieces.encode(x), pieces.end] for x in texts]
                    decoded = [pieces.decode(x) for x in ids]
                    pieces.check()
                if pieces.differs:
                    ids, decoded = zip(*map(pieces.by_library, texts), strict=True) if texts else ((), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array([pieces.differs] * len(texts), pa.bool_())], names=["doc_id", "ids", "decoded", "by_library"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string, by_library boolean")


def piece_digests(docs: DataFrame, *, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, by_library of encode_pieces(), digested where texts are encoded."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def digest(ids: str, text: str) -> tuple[int, str, str]:
        return ids.count(" ") + 1, sha(ids), sha(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(model)
        for batch in batches:
            made = []
            if not pieces.differs:
                for x in batch.column(1):
                    made.append(digest(*pieces.digits(x.as_py() or "")))
                    if len(pieces.fresh) > 20_000:
                        pieces.check()
                pieces.check()
            if pieces.differs:
                made = [digest(" ".join(map(str, ids)), text) for ids, text in (pieces.by_library(x.as_py() or "") for x in batch.column(1))]
            counts, of_ids, of_texts = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string()), pa.array([pieces.differs] * len(made), pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "by_library"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, by_library boolean")
