"""Token counts: delta-maintained rollups.

A ledger is a folder of committed batches. A batch is a set of signed changes, already summed by source, language and
tokenizer version: inserts add, deletes take away, a revised count does both. Totals are the sum over all batches, so
batches may come in any order. A batch is written to a draft of its own; what commits it is one small file under the
batch's name that holds the draft's. Totals read the drafts that such files name, so a batch counts once whoever sends
it, and a draft whose committer was lost, or came second, never counts. The file is renamed into place without
overwriting: HDFS and the like do so atomically. Where renaming is not atomic (object stores) two senders at the same
moment may both be told that theirs was taken, but one file is left and one draft counts.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, shared_dir, small_side, written

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars", "n_copies", "copy_tokens"]  # copies: documents whose text another one has first
CHANGE = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(k, T.LongType()) for k in SUMS])
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


class Ledger:
    """Committed batches under ``path``; the default is a new folder in the cluster's shared one."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = (path or f"{shared_dir(spark).rstrip('/')}/token-ledger-{uuid.uuid4().hex}").rstrip("/")
        self._jvm, place = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self._place, self._conf = place, spark._jsc.hadoopConfiguration()
        self._fs = place(self.path).getFileSystem(self._conf)
        for folder in ("drafts", "batches"):
            self._fs.mkdirs(place(f"{self.path}/{folder}"))

    def _named(self, batch: str) -> str:
        """The batch's file; names of any length and characters have one of their own."""
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _taken(self, draft: str, batch: str) -> bool:
        """Whether the draft is now what the batch's name stands for; it is not if the name was there."""
        note = self._place(f"{self.path}/notes/{draft}")
        out = self._fs.create(note, True)
        out.write(f"{draft}\n".encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(note.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(note, self._place(self._named(batch)), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes(KEYS, SUMS; signed) under the batch's name. False if that name was committed before."""
        if self._fs.exists(self._place(self._named(batch))):
            return False
        draft = uuid.uuid4().hex
        summed = changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).filter(" OR ".join(f"{c} <> 0" for c in SUMS))
        summed.coalesce(1).write.parquet(f"{self.path}/drafts/draft={draft}")  # a row a source, language and version
        return self._taken(draft, batch)

    def totals(self) -> DataFrame:
        """KEYS and SUMS over all committed batches; groups that deletes have emptied are left out."""
        taken = self.spark.read.schema("draft string").text(f"{self.path}/batches").distinct()
        drafts = self.spark.read.schema(T.StructType([*CHANGE.fields, T.StructField("draft", T.StringType())])).parquet(f"{self.path}/drafts")
        every = drafts.join(small_side(taken, 500_000), "draft", "left_semi")
        return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter(" OR ".join(f"{c} <> 0" for c in SUMS))


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add counted(KEYS, n_tokens, n_chars; optional: rows, copies), a row a document and version or, with
    rows and copies, one for as many documents, of which that many are copies."""
    many = {c: F.col(c).cast("long") if c in counted.columns else F.lit(n).cast("long") for c, n in (("rows", 1), ("copies", 0))}
    each = counted.select(*KEYS, F.col("n_tokens").cast("long"), F.col("n_chars").cast("long"), *[v.alias(k) for k, v in many.items()])
    return each.select(*KEYS, F.col("rows").alias("n_docs"), (F.col("rows") * F.col("n_tokens")).alias("n_tokens"), (F.col("rows") * F.col("n_chars")).alias("n_chars"), F.col("copies").alias("n_copies"), (F.col("copies") * F.col("n_tokens")).alias("copy_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take the same away."""
    return inserts(counted).withColumns({c: -F.col(c) for c in SUMS})


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from old counts to new ones, also where source, language or version changed."""
    return deletes(old).unionByName(inserts(new))


@lru_cache(8)
def ranks(version: str):
    import tiktoken

    with open(public_tokenizers.path(f"{version}.tiktoken"), "rb") as lines:
        table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """doc_id, source, lang, n_chars, text_hash and a column n_<version> of token counts; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["RAYON_NUM_THREADS"] = "1"
        coders = [ranks(v) for v in versions]
        for batch in batches:
            counts = [[] for _ in coders]
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py()
                for n, coder in zip(counts, coders, strict=True):
                    n.append(len(coder.encode_ordinary(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(n, pa.int64()) for n in counts)], names=[*batch.schema.names[:-1], *(f"n_{v}" for v in versions)])

    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_hash"), text.alias("text"))
    return given.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, text_hash string, " + ", ".join(f"n_{v} long" for v in versions))


def per_version(counted: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """A row a document and version: KEYS, n_tokens, n_chars, and what else counted has."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"n_{v}").alias("n_tokens")) for v in versions]))
    return counted.select("*", each.alias("each")).select("*", "each.tokenizer", "each.n_tokens").drop("each", *[f"n_{v}" for v in versions])


def version_of(exact: DataFrame) -> str:
    """A name for what the rows of count_tokens() hold, whatever their order: the same rows have the same one."""
    row = F.xxhash64("doc_id", "source", "lang", "text_hash", *[c for c in exact.columns if c.startswith("n_")]).cast("decimal(38,0)")
    n, total = exact.agg(F.count("*"), F.sum(row)).first()
    return f"{n}:{total or 0}"


def rollup_documents(docs: DataFrame, *, versions: tuple[str, ...] = VERSIONS, ledger: Ledger | None = None) -> DataFrame:
    """Totals of all documents, by source, language and tokenizer version, kept by three batches of changes.

    Documents come in with the estimate of a token for four characters; exact counts revise it; documents whose text an
    earlier document has (smaller doc_id, then smaller source and language) are deleted and inserted again as copies,
    which n_copies and copy_tokens count beside the totals; and the revision is sent again, which changes nothing.
    Batches are named after what the rows hold: a ledger that is passed in takes other documents as further ones, and
    the same again as a repetition. Null sources and languages are groups of their own, null texts count as empty. Rows
    that repeat are copies of one another. An empty table adds nothing. Only doc_id, source, lang and text are looked at.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    exact = written(count_tokens(docs, versions), "token-counts")
    new = per_version(exact, versions)
    old = new.withColumn("n_tokens", F.ceil(F.col("n_chars") / 4))
    first = F.struct("doc_id", "source", "lang")
    # a text that a third of all rows share is one row a task before the first shuffle; the join's large side is split
    shared = written(exact.groupBy("text_hash").agg(F.min(first).alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "token-copies")
    counts = [f"n_{v}" for v in versions]
    each = hot_join(exact, shared, ["text_hash"], "rows").groupBy("text_hash", "first", "doc_id", "source", "lang", "n_chars", *counts).agg(F.count("*").alias("rows_here"))
    copied = each.withColumn("extra", F.col("rows_here") - F.when(first == F.col("first"), 1).otherwise(0)).filter("extra > 0")
    extra = per_version(copied, versions).withColumnRenamed("extra", "rows")
    name = version_of(exact)
    ledger.commit(f"load {name}", inserts(old))
    ledger.commit(f"exact counts {name}", revisions(old, new))
    ledger.commit(f"copies {name}", revisions(extra, extra.withColumn("copies", F.col("rows"))))
    ledger.commit(f"exact counts {name}", revisions(old, new))
    return ledger.totals()
