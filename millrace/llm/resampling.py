"""Importance resampling towards a target corpus: weights from arrays, draws merged from sorted runs.

A first pass counts features per bucket in the documents and in the target, partly in each task. The gains of the
buckets form one array, and a second pass adds up the gains of each text's buckets, adds the noise of its id, and packs
its rows into sorted runs: a task gathers up to RUN eligible rows, sorts them and writes them in blocks of BLOCK.

Splitters, from a sample of the keys as a range partitioner takes it (they shape tasks, never results), cut the blocks
into ranges of the order. The ranges' exact sizes tell the first rank of each and in which one the draw ends. A task
takes the blocks of its range by the order of their first rows and merges them with a tournament tree, in which a block
takes part from its first row on, so it holds the blocks that overlap and no more. It hands out ranks until the draw is
full and passes the rest on unmerged; ranges behind the last draw are not shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS, LEAST_WORDS, SHARE, SALT = 10_000, 20, 10, "2024"  # features' buckets; words of an eligible text; percent drawn; of the noise
RUN, BLOCK = 200_000, 256  # rows of a sorted run and of a block
RANGE, MOST_RANGES, SAMPLE = 1_000_000, 4_000, 40_000  # rows of a range at least where there are many; ranges; sampled keys
MOST_WORDS = 500_000  # words whose buckets a worker keeps
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = ["score", "doc_id", "n_features", "weight"]
BLOCKS = "part string, head array<long>, score array<long>, doc_id array<long>, n_features array<long>, weight array<long>"


class Buckets:
    """Buckets of texts' features: runs of ``low`` to ``high`` consecutive words."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, int]:
        """(the features' buckets, how many words the text has)."""
        words = WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower()) if text else []
        out = []
        for n in range(self.low, self.high + 1):
            runs = words if n == 1 else [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            for run in set(runs).difference(self.known):
                self.known[run] = zlib.crc32(run.encode()) % BUCKETS
            out.append(np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs)))
        return np.concatenate(out), len(words)


def bucket_counts(texts: DataFrame, low: int, high: int) -> np.ndarray:
    """How often each bucket occurs in all texts; one column, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(low, high), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(buckets.of(x.as_py())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + float(BUCKETS)) / ((s + 1.0) * (t_all + float(BUCKETS))))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{SALT}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def order(score: int, doc_id: int | None, n_features: int) -> tuple[int, int, int, int]:
    """Higher scores first, then smaller ids, a null one before all, then fewer features."""
    return (-score, -1, 0, n_features) if doc_id is None else (-score, 0, doc_id, n_features)


def blocks_of(rows: list[tuple], part: str) -> Iterator[tuple]:
    """Rows (score, doc_id, n_features, weight) in blocks, each with its first row as head."""
    for low in range(0, len(rows), BLOCK):
        some = rows[low : low + BLOCK]
        yield (part, some[0], *zip(*some, strict=True))


def block_batch(blocks: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks, strict=True)) if blocks else [()] * 6
    kinds = [pa.string(), *[pa.list_(pa.int64())] * 5]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["part", "head", *NAMES])


def sorted_runs(docs: DataFrame, gain: np.ndarray, low: int, high: int) -> DataFrame:
    """Blocks of scored rows: part is ``run`` for eligible ones, sorted run by run, and ``rest`` for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(low, high)
        held: list[tuple] = []
        short: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n_words = buckets.of(text.as_py())
                weight = int(gain[found].sum())
                (held if n_words >= LEAST_WORDS else short).append((weight + noise(doc_id), doc_id, len(found), weight))
            if len(held) >= RUN:
                held.sort(key=lambda r: order(*r[:3]))
                yield block_batch(list(blocks_of(held, "run")))
                held = []
            if len(short) >= RUN:
                yield block_batch(list(blocks_of(short, "rest")))
                short = []
        held.sort(key=lambda r: order(*r[:3]))
        yield block_batch([*blocks_of(held, "run"), *blocks_of(short, "rest")])

    return docs.mapInArrow(run, BLOCKS)


class Tournament:
    """Winner tree over sorted blocks. Matches are played again only on a leaf's way to the root."""

    def __init__(self) -> None:
        self.leaves = 1
        self.keys: list[tuple | None] = [None, None]  # a heap-shaped tree: keys[1] wins; None loses to all
        self.sources: list[tuple[list[tuple], int]] = [([], 0)]
        self.free = [0]

    def play(self, leaf: int) -> None:
        keys, k = self.keys, (leaf + self.leaves) >> 1
        while k:
            a, b = keys[2 * k], keys[2 * k + 1]
            keys[k] = a if b is None or (a is not None and a <= b) else b
            k >>= 1

    def enter(self, rows: list[tuple]) -> None:
        """rows: sorted tuples (order, row)."""
        if not self.free:  # twice the leaves; every winner is found again
            old = self.keys[self.leaves :]
            self.free = list(range(2 * self.leaves - 1, self.leaves - 1, -1))
            self.sources += [([], 0)] * self.leaves
            self.keys = [None] * (2 * self.leaves) + old + [None] * self.leaves
            self.leaves *= 2
            for k in range(self.leaves - 1, 0, -1):
                a, b = self.keys[2 * k], self.keys[2 * k + 1]
                self.keys[k] = a if b is None or (a is not None and a <= b) else b
        leaf = self.free.pop()
        self.sources[leaf] = (rows, 0)
        self.keys[leaf + self.leaves] = (rows[0][0], leaf)
        self.play(leaf)

    def best(self) -> tuple | None:
        """Order of the row that comes next."""
        return self.keys[1][0] if self.keys[1] is not None else None

    def take(self) -> tuple:
        leaf = self.keys[1][1]
        rows, at = self.sources[leaf]
        row = rows[at][1]
        if at + 1 < len(rows):
            self.sources[leaf] = (rows, at + 1)
            self.keys[leaf + self.leaves] = (rows[at + 1][0], leaf)
        else:
            self.sources[leaf] = ([], 0)
            self.keys[leaf + self.leaves] = None
            self.free.append(leaf)
        self.play(leaf)
        return row

    def left(self) -> Iterator[tuple]:
        """Rows not taken yet, in no order."""
        for rows, at in self.sources:
            for _, row in rows[at:]:
                yield row


def rows_of(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    for score, doc_id, n, weight in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in NAMES], strict=True):
        yield list(zip(score, doc_id, n, weight, strict=True))


def splitters(runs: DataFrame, total: int) -> list[tuple]:
    """Bounds of ranges of the order: some ten times the shuffle partitions, more where ranges were over RANGE rows."""
    wanted = min(MOST_RANGES, max(10 * int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE)))
    keys = runs.select(F.inline(F.arrays_zip("score", "doc_id", "n_features"))).sample(min(1.0, SAMPLE / max(1, total)), seed=1).collect()  # some SAMPLE rows
    ordered = sorted({order(*k) for k in keys})
    return ordered[:: -(-len(ordered) // wanted)][1:] if ordered else []


def resample(docs: DataFrame, target: DataFrame, *, share: int = SHARE, low: int = 1, high: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; rank is null for rows not drawn.

    Null and empty texts have no features and weight 0; a null doc_id is hashed as empty text and comes before all in a
    tie. Rows that repeat are drawn one by one, and of rows with one id and score the one of fewer features comes first.
    An empty target leaves the counts of docs to decide; empty docs give no rows. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs.select("text"), low, high), bucket_counts(target.select("text"), low, high))
    packed = written(sorted_runs(docs.select("doc_id", "text"), gain, low, high), "resample-runs")
    runs = packed.filter("part = 'run'")
    total = runs.agg(F.coalesce(F.sum(F.size("score")), F.lit(0))).first()[0]
    draw = total * share // 100
    bounds = splitters(runs, total)

    def pieces(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
        """(range, rows) of a sorted block."""
        keys = [order(*r[:3]) for r in rows]
        at = 0
        first, last = bisect_left(bounds, keys[0]), bisect_left(bounds, keys[-1])
        for k in range(first, last + 1):
            end = bisect_right(keys, bounds[k], at) if k < last else len(rows)
            if end > at:
                yield k, rows[at:end]
            at = end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            for rows in rows_of(batch):
                for k, some in pieces(rows):
                    sizes[k] += len(some)
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[at])], names=["place", "n"])

    sizes = np.zeros(len(bounds) + 1, np.int64)
    for r in runs.select(*NAMES).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row a range
        sizes[r["place"]] = r["n"]
    before = np.cumsum(sizes) - sizes
    open_ranges = int((before < draw).sum()) if draw else 0  # ranges that hold drawn rows come first

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield block_batch([(f"{k:09d}" if k < open_ranges else "rest", some[0], *zip(*some, strict=True)) for rows in rows_of(batch) for k, some in pieces(rows)])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[str, list[tuple]]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), rows_of(batch), strict=True)

        for place, group in grouped(blocks()):
            rank = int(before[int(place)])
            for some in chunked(merged_until(group, draw - rank), 10_000):
                yield row_batch([r for r, _ in some], [rank + n if n else None for _, n in some])

    none = packed.filter("part = 'rest'") if open_ranges else packed
    plain = lambda df: df.select(F.inline(F.arrays_zip(*NAMES))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not open_ranges:
        return plain(none)
    drawn = written(runs.select(*NAMES).mapInArrow(cut, BLOCKS), "resample-pieces")
    head = F.col("head")
    waiting = drawn.filter("part <> 'rest'").repartition("part").sortWithinPartitions("part", -head[0], F.asc_nulls_first(head[1]), head[2])
    won = waiting.select("part", *NAMES).mapInArrow(ranked, "doc_id long, n_features long, weight long, score long, rank long")
    return won.unionByName(plain(drawn.filter("part = 'rest'"))).unionByName(plain(none))


def grouped(blocks: Iterator[tuple[str, list[tuple]]]) -> Iterator[tuple[str, Iterator[list[tuple]]]]:
    """(part, its blocks) of blocks that come part by part; each part must be read to its end."""
    ahead = next(blocks, None)
    while ahead is not None:
        part = ahead[0]

        def own() -> Iterator[list[tuple]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == part:
                rows = ahead[1]
                ahead = next(blocks, None)
                yield rows

        yield part, own()


def merged_until(blocks: Iterator[list[tuple]], wanted: int) -> Iterator[tuple[tuple, int]]:
    """(row, its place from 1) for the first ``wanted`` rows in order; the others follow with 0, unmerged."""
    tree, n = Tournament(), 0
    for rows in blocks:
        if n >= wanted:
            yield from ((r, 0) for r in rows)
            continue
        keyed = [(order(*r[:3]), r) for r in rows]
        while n < wanted and (best := tree.best()) is not None and best < keyed[0][0]:
            n += 1
            yield tree.take(), n
        tree.enter(keyed)
    while n < wanted and tree.best() is not None:
        n += 1
        yield tree.take(), n
    yield from ((r, 0) for r in tree.left())


def chunked(rows: Iterator, size: int) -> Iterator[list]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def row_batch(rows: list[tuple], ranks: list[int | None]) -> pa.RecordBatch:
    score, doc_id, n, weight = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc_id, n, weight, score, ranks)], names=["doc_id", "n_features", "weight", "score", "rank"])
