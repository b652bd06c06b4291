"""A stored inverted index: batches add segments, words deal postings to buckets, keys to blocks; top-k skips blocks.

Under the index's folder: ``keys`` and ``postings`` by segment, the latter by bucket of the word's hash, and lists of the
segments that count. A row of postings is a word in a block of 2^bits neighbouring keys: their offsets there, sorted,
how often each has the word, how many there are and the highest count. A word in every document is many rows, of which
no task takes all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python import shares
from ..streaming.ingest import folders
from .relational import small_side

POSTINGS = "word string, block bigint, offsets array<smallint>, counts array<int>, n int, most int, segment string, bucket int"
LIST = "segment string, documents bigint, buckets int, bits int"
PLACED = "word string, block bigint, postings array<struct<offset: smallint, count: int>>"
#: Tokens that a task counts in one go; a longer document is counted alone.
AT_ONCE = 1 << 21
#: Blocks of keys that a task writes together are 2^ZONE neighbours.
ZONE = 6
#: Scores are rounded to six digits; bounds are compared with more slack than that.
SLACK = 1e-5


def counted(rows: DataFrame, bits: int, at_once: int = AT_ONCE) -> DataFrame:
    """word, block, postings of rows (key, words): sorted by offset, each key of the block once. A word and block have a
    row for each share of a batch that holds them, so neighbouring documents leave their task as lists, not one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in shares(pc.list_value_length(batch.column(1)), at_once):
                part = batch.slice(at, n)
                flat, row = part.column(1).flatten(), pc.list_parent_indices(part.column(1)).to_numpy()
                if flat.null_count:
                    row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                keys, place = np.unique(part.column(0).to_numpy(), return_inverse=True)
                pairs, count = np.unique(coded.indices.to_numpy().astype(np.int64) * len(keys) + place[row], return_counts=True)
                word, key = np.divmod(pairs, len(keys))
                key = keys[key]
                block = key >> bits
                first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])))
                offset = (key & ((1 << bits) - 1)).astype(np.int16)
                posting = pa.StructArray.from_arrays([pa.array(offset), pa.array(count.astype(np.int32))], names=["offset", "count"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)), pa.int32()), posting)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word[first])), pa.array(block[first]), lists], names=["word", "block", "postings"])

    return rows.mapInArrow(run, PLACED)


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """One row of postings for each ``by``: sorted by offset, counts of one offset added."""
    lists = rows.groupBy(*by).agg(F.collect_list("postings").alias("parts"))
    p = lists.select(*by, F.when(F.size("parts") == 1, F.get("parts", 0)).otherwise(F.sort_array(F.flatten("parts"))).alias("p"), (F.size("parts") > 1).alias("joined"))
    starts = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get(F.col("p"), i)["offset"] != F.get(F.col("p"), i - 1)["offset"]))
    at = p.select(*by, "p", F.when(F.col("joined"), starts).alias("at"))
    total = lambda i, k: F.reduce(F.slice("p", i + 1, F.coalesce(F.get(F.col("at"), k + 1), F.size("p")) - i), F.lit(0), lambda n, x: n + x["count"])
    added = F.transform("at", lambda i, k: F.struct(F.get(F.col("p"), i)["offset"].alias("offset"), total(i, k).alias("count")))
    return at.select(*by, F.when(F.size("at") < F.size("p"), added).otherwise(F.col("p")).alias("p"))


class TextIndex:
    """Documents by integer keys, found by words.

    A document is indexed once: a key that is known is left out of later batches, so a batch sent twice adds nothing.
    Rows of a batch that share a key are one document of all their words. Rows without a key are left out; a document
    without words counts as one. A segment counts from when a list names it, which is written last.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64, bits: int = 12):
        """``buckets`` and ``bits`` (at most 15) hold for a new index; one that exists keeps its own."""
        self.spark, self.path = spark, path
        held = self._list()
        self.buckets, self.bits = (held[0]["buckets"], held[0]["bits"]) if held else (buckets, bits)
        if not 0 <= self.bits <= 15:
            raise ValueError("offsets in a block are small integers: bits from 0 to 15")

    def _list(self) -> list:
        """Segments that count; a row a batch."""
        numbers = folders(self.spark, self.path, "list")
        return self.spark.read.schema(LIST).parquet(f"{self.path}/list={numbers[-1]}").collect() if numbers else []

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, key: str, tokens: Column) -> int:
        """Indexes documents that aren't known and returns how many those were."""
        held = self._list()
        segment = f"s{uuid.uuid4().hex}"
        number = F.col(key).cast("long")
        keys = docs.select(number.alias("key")).filter("key IS NOT NULL").distinct()
        if held:
            known = self.spark.read.schema("key bigint").parquet(*[f"{self.path}/keys/{r['segment']}" for r in held])
            keys = keys.join(known, "key", "left_anti")
        keys.write.parquet(f"{self.path}/keys/{segment}")
        new = self.spark.read.schema("key bigint").parquet(f"{self.path}/keys/{segment}")
        documents = new.count()
        if not documents:
            return 0
        mine = docs.filter(number.isNotNull())
        if held:  # before the texts are cut into words, should they be shuffled
            mine = mine.join(new.select(F.col("key").alias(segment)), number == F.col(segment), "left_semi")
        placed = counted(mine.select(number.alias("key"), tokens.alias("words")), self.bits)
        dealt = placed.select("*", self._bucket(F.col("word")).alias("bucket"), F.shiftright("block", ZONE).alias("zone")).repartition("bucket", "zone")
        lists = merged(dealt, "bucket", "zone", "word", "block")  # at most 2^bits
        out = lists.select("word", "block", F.col("p.offset").alias("offsets"), F.col("p.count").alias("counts"), F.size("p").alias("n"), F.array_max("p.count").alias("most"), F.lit(segment).alias("segment"), "bucket")
        out.sortWithinPartitions("bucket", "word", "block").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/postings")
        after = [*[tuple(r) for r in held], (segment, documents, self.buckets, self.bits)]
        self.spark.createDataFrame(after, LIST).coalesce(1).write.parquet(f"{self.path}/list={len(after)}")
        return documents

    def postings(self, words: list[str]) -> DataFrame:
        """Rows of the words; other buckets are no part of the scan."""
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        counts = rows.filter(F.col("segment").isin(*[r["segment"] for r in self._list()]))
        mine = reduce(or_, [F.col("bucket") == self._bucket(F.lit(w)) for w in words])
        return counts.filter(mine).filter(F.col("word").isin(*words))

    def bounds(self, rows: DataFrame, weight: Column) -> DataFrame:
        """segment, block, bound: no document of the block scores more."""
        return rows.groupBy("segment", "block").agg(F.sum(F.col("most") * weight).alias("bound"))

    def scores(self, rows: DataFrame, weight: Column) -> DataFrame:
        each = rows.select("block", weight.alias("weight"), F.explode(F.arrays_zip("offsets", "counts")).alias("p"))
        key = F.shiftleft("block", self.bits) + F.col("p.offsets")
        return each.groupBy(key.alias("key")).agg(F.round(F.sum(F.col("p.counts") * F.col("weight")), 6).alias("score"))

    def candidates(self, words: list[str], limit: int) -> tuple[DataFrame, Column] | None:
        """Postings of the words in blocks that may hold one of the first ``limit`` documents, and the words' weights.

        The blocks of the highest bounds are scored first; the last of the first ``limit`` scores there is one that the
        whole index reaches, so blocks whose bound lies below can't add to the result.
        """
        held = self._list()
        words = sorted({w for w in words if w is not None})
        if not held or not words:
            return None
        rows = self.postings(words)
        total = sum(r["documents"] for r in held)
        found = rows.groupBy("word").agg(F.ln(1 + F.lit(float(total)) / F.sum("n")).alias("weight")).collect()  # a row a query word
        if not found:
            return None
        weight = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r["word"], r["weight"])]), F.col("word"))
        bounds = self.bounds(rows, weight)
        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(limit)
        best = self.scores(rows.join(F.broadcast(first), ["segment", "block"], "left_semi"), weight).orderBy(F.desc("score")).limit(limit)  # first: limit rows
        n, least = best.agg(F.count("*"), F.min("score")).first()
        if n < limit:
            return rows, weight
        blocks = bounds.filter(F.col("bound") >= least - SLACK).select("segment", "block")
        return rows.join(small_side(blocks, 1_000_000), ["segment", "block"], "left_semi"), weight

    def search(self, words: list[str], limit: int) -> DataFrame:
        """key, score, descending, then by key: sum of tf ln(1 + N / df) over the words, each taken once."""
        if limit < 1 or (found := self.candidates(words, limit)) is None:
            return self.spark.createDataFrame([], "key bigint, score double")
        return self.scores(*found).orderBy(F.desc("score"), "key").limit(limit)
