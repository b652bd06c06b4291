"""Document fingerprints: SimHash with permuted block tables.

Terms are runs of five words (the whole text where it has fewer). A term's 64-bit hash votes on every bit, for it or
against, with a weight of one plus the logarithm of how often the text has the term; the signs of the sums are the
fingerprint. To find all fingerprints within a Hamming radius r, the bits are cut into r + 3 blocks: whichever r bits
differ, three blocks agree, so a table for each choice of three blocks, keyed by their bits, finds every pair.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_table, small_side, written

TERM, BITS, RADIUS, AGREE = 5, 64, 3, 3
MOST_WORDS, AT_ONCE = 500_000, 20_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes:
    """64-bit hashes of words, with a bounded cache in each Python worker."""

    def __init__(self, most: int = MOST_WORDS) -> None:
        self.known, self.most = {}, most

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode())
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def term_hashes(hashes: np.ndarray, size: int = TERM) -> np.ndarray:
    """A mixed hash of every run of ``size`` words; one of all words where there are fewer; none for no words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    x = hashes[: len(hashes) - size + 1].copy()
    for k in range(1, size):
        x = (x ^ (x >> np.uint64(29))) * MIX[1] + hashes[k : len(hashes) - size + 1 + k]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def simhash(text: str) -> int:
    """The fingerprint; 0 of a text without words."""
    terms, times = np.unique(term_hashes(WORDS.of(text.split())), return_counts=True)
    votes = np.zeros(BITS, np.float32)
    for k in range(0, len(terms), AT_ONCE):
        bits = np.unpackbits(terms[k : k + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        weights = 1 + np.log(times[k : k + AT_ONCE].astype(np.float32))
        votes += 2 * (weights @ bits.astype(np.float32)) - weights.sum()
    return int(np.packbits(votes > 1e-3, bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    """The cosine of the angle that the share of differing bits estimates, 0 where that is negative; 1 if equal."""
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / BITS))


def with_next(docs: DataFrame) -> DataFrame:
    """part, doc_id, text, only_next: rows dealt to parts by ranges of doc_id, each part sorted and closed.

    The order is that of doc_id, then a hash of the text, then the text. The row that follows a part's last one is
    there a second time (only_next), and the last part closes with the first row of all. One shuffle of the texts; the
    bounds are quantiles of doc_id. A doc_id (or null) that fills several quantiles is cut into as many ranges of the
    hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    tasks = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = 8 * tasks  # many small ranges a task even out its size
    bounds = rows.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    often = [{"value": v, "times": n} for v, n in Counter(bounds).items() if n > 1]
    hot = literal_table(spark, often, "value: bigint, times: int")
    sub = F.floor((F.shiftright("h", 44) + 2**19) * F.col("times") / 2**20) + 1  # the hash's first 20 bits, in order
    ranged = rows.withColumn("range", range_of(F.col("at"), sorted(set(bounds)))).join(F.broadcast(hot), F.col("at") == F.col("value"), "left")  # at most a row a part
    dealt = ranged.withColumn("part", F.shiftleft(F.col("range").cast("long"), 21) + F.coalesce(sub, F.lit(0))).drop("range", "value", "times")
    heads = dealt.groupBy("part").agg(F.min(F.struct("at", "h")).alias("head")).orderBy("part").collect()  # a row a part
    table = literal_table(spark, [{"of": r["part"], "head_at": r["head"]["at"], "head_h": r["head"]["h"], "previous": heads[k - 1]["part"]} for k, r in enumerate(heads)], "of: bigint, head_at: bigint, head_h: bigint, previous: bigint")
    known = dealt.join(F.broadcast(table), F.col("part") == F.col("of"))  # a row a part
    own, other = F.struct(F.col("part"), F.lit(False).alias("only_next")), F.struct(F.col("previous").alias("part"), F.lit(True).alias("only_next"))
    leads = (F.col("at") == F.col("head_at")) & (F.col("h") == F.col("head_h"))
    places = F.when(leads, F.array(own, other)).otherwise(F.array(own))
    both = known.select("at", "h", "doc_id", "text", F.explode(places).alias("place")).select("place.part", "at", "h", "doc_id", "text", "place.only_next")
    return both.repartition(tasks, "part").sortWithinPartitions("part", "only_next", "at", "h", "text")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the value, in two steps of about the root of their number each."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    chunks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    below = lambda array: F.size(F.filter(array, lambda b: b < value))
    lasts = F.from_json(F.lit(json.dumps([c[-1] for c in chunks[:-1]])), "array<bigint>")
    chunk = below(lasts)
    return chunk * width + below(F.get(F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>"), chunk))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the document's last half (floor) replaced by as many first characters of the next document in
    the order of doc_id, then a hash of the text; the first follows the last. Null doc_ids come first, null texts count as empty, a
    single document follows itself. Rows that repeat follow one another. Texts without words have the fingerprint 0.
    """
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def pair(row: tuple, follower: tuple) -> None:
            _, doc_id, text, mark = row
            n = len(text)
            edited = text[: n - n // 2] + follower[2][: n // 2]
            changed = simhash(edited)
            out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), f"{mark:016x}", f"{changed:016x}", likeness(mark, changed), likeness(mark, follower[3])))

        def made() -> pa.RecordBatch:
            rows = out[:]
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split(" ")[0] for c in columns.split(", ")]
            values = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for part, doc_id, text, only_next in zip(*(batch.column(k) for k in (0, 3, 4, 5)), strict=True):
                part, doc_id, text, only_next = part.as_py(), doc_id.as_py(), text.as_py(), only_next.as_py()
                row = (part, doc_id, text, simhash(text))
                if held and held[0] == part:
                    pair(held, row)
                held = None if only_next else row
            yield made()

    return with_next(docs).mapInArrow(run, columns)


def block_keys(fingerprint: Column, radius: int = RADIUS, agree: int = AGREE) -> list[Column]:
    """Of every choice of ``agree`` of radius + agree blocks: its number and the bits of those blocks."""
    blocks = radius + agree
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        keys.append(F.struct(F.lit(n).alias("table"), fingerprint.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return keys


def within_radius(marks: DataFrame, queries: DataFrame, *, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """mark, n_marks, n_docs: of each mark in queries(mark), the marks of marks(mark) within the radius, itself too.

    mark is a fingerprint as a long. Equal marks are counted first, so copies meet once. A pair of marks that several
    tables find counts in the first of them. Null marks are left out; empty tables give no rows.
    """
    index = marks.filter("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("n"))
    asked = queries.filter("mark IS NOT NULL").select("mark").distinct()
    tabled = index.select(F.col("mark").alias("other"), "n", F.explode(F.array(*block_keys(F.col("mark"), radius, agree))).alias("t")).select("other", "n", "t.table", "t.key")
    wanted = asked.select("mark", F.explode(F.array(*block_keys(F.col("mark"), radius, agree))).alias("t")).select("mark", "t.table", "t.key")
    differ = F.col("mark").bitwiseXOR(F.col("other"))
    agreeing = F.array(*[F.when(k["key"] == 0, k["table"]) for k in block_keys(differ, radius, agree)])
    # merged on purpose: the planner doesn't know that explode multiplies, and would broadcast the tables of all queries
    pairs = wanted.join(tabled.hint("merge"), ["table", "key"]).filter((F.bit_count(differ) <= radius) & (F.array_min(agreeing) == F.col("table")))
    return pairs.groupBy("mark").agg(F.count("*").alias("n_marks"), F.sum("n").alias("n_docs"))


def fingerprints_with_neighbours(docs: DataFrame, *, radius: int = RADIUS, one_in: int = 20) -> DataFrame:
    """fingerprint_documents() and, for ids divisible by ``one_in``, n_within: documents within the radius, itself too.

    Those are the queries of the search; the index holds every document. n_within is null for the others.
    """
    made = written(fingerprint_documents(docs), "fingerprints")
    low = F.conv(F.substring("fingerprint", 9, 8), 16, 10).cast("long")
    high = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long")
    marked = made.withColumn("mark", F.shiftleft(high, 32).bitwiseOR(low))
    asks = F.col("doc_id") % one_in == 0
    found = written(within_radius(marked.select("mark"), marked.filter(asks).select("mark"), radius=radius).select("mark", F.col("n_docs").alias("n_within")), "fingerprint-neighbours")
    joined = marked.join(small_side(found, 50_000), "mark", "left")
    return joined.withColumn("n_within", F.when(asks, F.col("n_within"))).drop("mark")
