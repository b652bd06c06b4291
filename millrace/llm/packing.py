"""Packing: non-negative least squares over shallow length combinations.

Documents are cut into full windows and a remainder each. The histogram of remainder lengths goes to the driver (at
most one row a length of the window). Combinations of up to three length classes that fill a window are enumerated,
non-negative least squares finds how often each should be used to exhaust the histogram, and the rounded counts are
carried out. What is left is packed greedily at exact lengths, longest first; where nothing fits a gap, a piece is
cut to it. The plan holds ranges of ranks, not documents: Spark ranks the remainders of each length and looks up the
range that each rank falls into.
"""

from __future__ import annotations

import bisect
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table, shared_dir, small_side
from .word_ids import encoder

WINDOW, STEP, END_ID = 4096, 32, 2


def combinations(window_classes: int) -> list[tuple[int, ...]]:
    """All multisets of one to three classes that add up to the window."""
    n = window_classes
    return [(n,), *((a, n - a) for a in range(n // 2, 0, -1)), *((a, b, n - a - b) for a in range(1, n // 3 + 1) for b in range(a, (n - a) // 2 + 1))]


def nonnegative_least_squares(columns: list[tuple[int, ...]], target: np.ndarray) -> np.ndarray:
    """x >= 0 with least |A x - target|, where column j of A counts the classes of columns[j] (active sets)."""
    a = np.zeros((len(target), len(columns)))
    for j, classes in enumerate(columns):
        for c in classes:
            a[c, j] += 1
    x, active = np.zeros(len(columns)), np.zeros(len(columns), bool)
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * len(target)):
        gain = a.T @ (target - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= slack:
            break
        active[j] = True
        while True:
            best = np.zeros(len(x))
            best[active] = np.linalg.lstsq(a[:, active], target, rcond=None)[0]
            low = active & (best <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - best[low], 1e-300))
            x += step * (best - x)
            active &= x > slack * 1e-3
            x[~active] = 0
            if not active.any():
                break
        x = np.maximum(best, 0) if active.any() else x
    return x


class Stock:
    """Remainders by length still to be packed, as ranges (origin, start, low, high) of ranks."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.ranges: dict[int, deque] = {}
        self.count: dict[int, int] = {}
        self.lengths: list[int] = []
        for length, n in sorted(histogram.items()):
            self.add(length, (length, 0, 0, n))

    def add(self, length: int, given: tuple[int, int, int, int]) -> None:
        if not self.count.get(length):
            bisect.insort(self.lengths, length)
            self.count[length], self.ranges[length] = 0, deque()
        self.ranges[length].append(given)
        self.count[length] += given[3] - given[2]

    def take(self, length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        self.count[length] -= n
        while n:
            origin, start, low, high = self.ranges[length].popleft()
            if high - low > n:
                self.ranges[length].appendleft((origin, start, low + n, high))
                high = low + n
            n -= high - low
            yield origin, start, low, high
        if not self.count[length]:
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def at_most(self, length: int, used: dict[int, int]) -> int:
        """The largest length up to the given one with more in stock than used; 0 if there is none."""
        k = bisect.bisect_right(self.lengths, length) - 1
        while k >= 0 and self.count[self.lengths[k]] <= used.get(self.lengths[k], 0):
            k -= 1
        return self.lengths[k] if k >= 0 else 0


def plan(histogram: dict[int, int], *, window: int = WINDOW, step: int = STEP) -> list[dict]:
    """Ranges of ranks: origin (a remainder length), low, high, start, length, sequence (of rank low), slot."""
    stock, out, sequence = Stock(histogram), [], 0

    def put(taken, length: int, first: int, slot: int) -> None:
        for origin, start, low, high in taken:
            out.append({"origin": origin, "low": low, "high": high, "start": start, "length": length, "sequence": first, "slot": slot})
            first += high - low

    classes = lambda length: -(-length // step)
    target = np.zeros(window // step + 1)
    for length, n in histogram.items():
        target[classes(length)] += n
    if target.any():
        mixes = [m for m in combinations(window // step) if all(target[c] for c in m)]
        times = np.rint(nonnegative_least_squares(mixes, target)).astype(int) if mixes else []
        left = target.astype(int)
        for k in np.argsort(-np.asarray(times), kind="stable"):
            mix = mixes[k]
            n = int(min([times[k], *(left[c] // mix.count(c) for c in mix)]))
            if n < 1:
                continue
            for slot, c in enumerate(mix):
                left[c] -= n
                first, need = sequence, n
                for length in range(c * step, (c - 1) * step, -1):
                    if m := min(need, stock.count.get(length, 0)):
                        put(stock.take(length, m), length, first, slot)
                        first, need = first + m, need - m
            sequence += n
    while stock.lengths:
        used: dict[int, int] = {}
        chosen, gap, cut = [], window, 0
        while gap:
            length = stock.at_most(gap, used)
            if not length:
                cut = stock.at_most(window, used)
                break
            used[length] = used.get(length, 0) + 1
            chosen.append(length)
            gap -= length
        if cut:
            used[cut] = used.get(cut, 0) + 1
        n = min(stock.count[length] // m for length, m in used.items())
        for slot, length in enumerate(chosen):
            put(stock.take(length, n), length, sequence, slot)
        if cut:
            taken = list(stock.take(cut, n))
            put(taken, gap, sequence, len(chosen))
            for origin, start, low, high in taken:
                stock.add(cut - gap, (origin, start + gap, low, high))
        sequence += n
    return out


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """doc_id, n_tokens, ids (binary), part, full_before, rest, rank_in_part: written to the shared folder once.

    part is the writing task; full_before and rank_in_part count full windows and equal rests before a row in it.
    Both stand in the written files, so that they hold whichever task reads them, or reads them again.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, full = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        end, seen = np.array([end_id], "<u4").tobytes(), {}
        for batch in batches:
            rows = []
            for ids in encode([text or "" for text in batch.column(1).to_pylist()]):
                ids += end
                n = len(ids) // 4
                rest = n % window
                rows.append((n, ids, part, full, rest, seen.get(rest, 0)))
                full += n // window
                seen[rest] = seen.get(rest, 0) + 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids", "part", "full_before", "rest", "rank_in_part"])

    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary, part int, full_before long, rest int, rank_in_part long")
    path = f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pack(docs: DataFrame, *, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """A row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat are packed as documents of their own; documents of
    equal length are interchangeable, and which of them shares a sequence with which follows the order of the input.
    A null doc_id stays null. No rows give no pieces. Other columns are not looked at.
    """
    tokens = tokenized(docs, vocabulary, end_id, window)
    spark, full = docs.sparkSession, F.floor(F.col("n_tokens") / window)
    counts = tokens.groupBy("part", "rest").agg(F.count("*").alias("n")).unionByName(tokens.groupBy("part").agg(F.sum(full).alias("n")).select("part", F.lit(-1).alias("rest"), "n"))
    before = counts.select("part", F.col("rest").alias("of"), (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("before"))
    totals = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most window + 1 rows
    first = totals.pop(-1, 0)
    totals.pop(0, None)
    ranges = literal_table(spark, plan(totals, window=window, step=step), "origin: int, low: bigint, high: bigint, start: int, length: int, sequence: bigint, slot: int")
    rests, fulls = small_side(before.filter("of > 0"), 500_000), small_side(before.filter("of = -1").drop("of"), 500_000)
    ids_of = F.expr("substring(ids, int(4 * start + 1), int(4 * length))")
    windows = (
        tokens.filter(F.col("n_tokens") >= window)
        .join(fulls, "part")
        .select("doc_id", "n_tokens", "ids", (F.col("before") + F.col("full_before")).alias("sequence"), F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("k"))
        .select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids", "n_tokens", (F.col("sequence") + F.col("k")).alias("sequence_id"), F.lit(0).alias("slot"))
    )
    rank = F.col("before") + F.col("rank_in_part")
    ranked = tokens.filter("rest > 0").join(rests, (tokens["part"] == rests["part"]) & (F.col("rest") == F.col("of"))).select("doc_id", "n_tokens", "ids", "rest", rank.alias("rank"))
    placed = ranked.join(small_side(ranges, 500_000), (F.col("rest") == F.col("origin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))  # rows of the plan: some for each length, whatever the number of documents
    pieces = placed.select("doc_id", (full * window + F.col("start")).cast("long").alias("start"), F.col("length").cast("long").alias("length"), "ids", "n_tokens", (first + F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "slot")
    cut = lambda x: x.select("doc_id", "start", "length", ids_of.alias("ids"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "slot")
    return cut(windows).unionByName(cut(pieces))


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``offset``: the ids that stand before a piece in its sequence (which holds at most a window of pieces)."""
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
