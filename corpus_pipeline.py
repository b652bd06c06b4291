"""Corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, for the documents that the stage keeps.

In all stages rows are told apart by doc_id and text (its hash), so rows that share a doc_id, or have none, keep their
own decisions. A null doc_id is a value like others. Columns beside COLUMNS are not looked at, whatever their names,
and don't come out. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_side, written
from millrace.llm.near_join import near_classes, text_key
from millrace.llm.packing import pack, with_offsets
from millrace.llm.pii import KINDS, find_pii
from millrace.llm.quality import quality_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def hashed(docs: DataFrame) -> DataFrame:
    """docs with text_hash, which tells rows that share a doc_id, or have none, apart; null text counts as empty."""
    return docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))


def same(names: list[str], prefix: str) -> Column:
    """Whether each column of names equals that of the prefixed name; nulls are equal."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. The verdict is that of a row's doc_id, text, language and source together.

    Null and empty texts fail the base rules and go; rows that repeat all go or all stay, as often as they come.
    """
    names = ["doc_id", "text_hash", "lang", "source"]
    known = hashed(docs)
    verdicts = written(quality_verdicts(known, carried=names[1:]).select(*names, "kept"), "stage-quality")
    gone = verdicts.filter(~F.coalesce("kept", F.lit(False))).select(*[F.col(c).alias(f"gone_{c}") for c in names]).distinct()
    return known.join(small_side(gone, 200_000), same(names, "gone_"), "left_anti").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The head (of the least doc_id, then text key) of each class of near duplicates; of rows that repeat it, one.

    Texts of the same words are near duplicates of one another, so one null or empty text stays of all. Rows of one
    doc_id with different texts are judged each for itself. A null doc_id counts as the least.
    """
    classes = written(near_classes(docs).select("doc_id", "text_key", ((F.coalesce("doc_id", F.lit(-(2**63))) == F.col("class_id")) & (F.col("text_key") == F.col("head_key"))).alias("head")), "stage-near")
    gone = classes.filter("NOT head").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    known = docs.select(*COLUMNS, text_key(F.col("text")).alias("text_key"))
    kept = known.join(small_side(gone, 200_000), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    twice = classes.filter("head").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    return (kept.dropDuplicates(["doc_id", "text_key"]) if twice.limit(1).count() else kept).select(*COLUMNS)


def redacted(text, spans):
    """text with each run of overlapping spans replaced by the name of the kind that starts it."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(state, span):
        fresh = F.struct(F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.get(names, span["kind"])).alias("out"), span["finish"].alias("at"))
        inside = F.struct(state["out"].alias("out"), F.greatest(state["at"], span["finish"]).alias("at"))
        return F.when(span["start"] >= state["at"], fresh).otherwise(inside)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.when(F.size(spans) == 0, text).otherwise(F.reduce(F.array_sort(spans), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of its kinds; n_chars follows where text changes.

    Null texts stay null and empty ones empty. Rows that repeat stay as often as they come, redacted alike.
    """
    names = ["doc_id", "text_hash"]
    known = hashed(docs)
    found = written(find_pii(known, carried=names[1:]).select(*[F.col(c).alias(f"found_{c}") for c in names], F.concat("base", "added").alias("spans")).filter(F.size("spans") > 0).dropDuplicates([f"found_{c}" for c in names]), "stage-pii")
    both = known.join(small_side(found, 200_000), same(names, "found_"), "left")
    text = F.coalesce("text", F.lit(""))
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    clean = both.withColumn("clean", F.when(F.col("text").isNotNull(), redacted(text, spans)))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.size(spans) > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, digest: bool = False) -> DataFrame:
    """Pieces of all documents in sequences, with their ids, or a digest instead: see pack(). Null and empty texts are
    the end id alone. The digest is taken before offsets are counted, so ids don't go through that shuffle."""
    pieces = pack(docs)
    return with_offsets(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids") if digest else pieces).drop("slot")


STAGES = [("quality", quality_stage), ("near_duplicates", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The Mahalanobis verdicts and token ids of the stages can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn; without the ids themselves, of which a digest stands for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir, digest=True)
