"""Incremental paths as streams: watermarked ingestion, deduplication, upserts, session of retries.

Each runs what is there and stops (availableNow); state and offsets live in the checkpoint folder given, so that the
next run goes on from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import keep_by
from ..operators.upserts import merge
from ..session import shared_dir


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, folder: str, schema, *, files: str = "*", per_trigger: int = 100) -> DataFrame:
    """A stream of a folder's Parquet files whose names fit; ``ts`` becomes a timestamp, as watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def append(rows: DataFrame, out: str, checkpoint: str) -> None:
    run(rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def fresh(rows: DataFrame, since: str, late: str = "1 hour") -> DataFrame:
    """Rows after the high-water mark; state for them is kept as long as rows may be late."""
    return rows.withWatermark("ts", late).filter(F.col("ts") > F.lit(since).cast("timestamp"))


def once(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state beyond it is dropped."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, by: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window."""
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), by, "n", "total")


def upsert(rows: DataFrame, key: list[str], order: str, out: str, checkpoint: str, *, keep_on_null: bool = False, buckets: int = 32) -> None:
    """Merges each micro-batch into the table under ``out``, which is cut into buckets by the key's hash.

    Only the buckets that a batch touches are written again, as a version named by the batch; a list of which version
    of each bucket counts (a row a bucket) is written last and makes the batch valid. A batch that is run again reads
    the list of the batch before and writes the same again, so a restart changes nothing. Versions that neither this
    list nor the one before names are removed. Within a batch the last row of a key by ``order`` counts.
    """
    spark = rows.sparkSession
    columns = rows.columns

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        last = keep_by(batch, key, F.col(order)).select(*columns).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = {r["bucket"] for r in last.select("bucket").distinct().collect()}  # at most a number a bucket
        before = versions(spark, out, number - 1)
        kept = stored(spark, out, {b: v for b, v in before.items() if b in touched}, rows.schema)
        both = merge(kept, last.drop("bucket"), key, keep_on_null=keep_on_null).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/version={number}")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(after.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{out}/list={number}")
        batch.unpersist()
        retire(spark, out, {*before.values(), *after.values()}, number)

    run(rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def folders(spark: SparkSession, out: str, kind: str) -> list[int]:
    """Numbers of the folders kind=number under out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))


def versions(spark: SparkSession, out: str, number: int) -> dict[int, int]:
    """The version of each bucket after a batch; the newest list at or before its number counts."""
    lists = [n for n in folders(spark, out, "list") if n <= number]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{out}/list={lists[-1]}").collect()} if lists else {}  # a row a bucket


def stored(spark: SparkSession, out: str, of: dict[int, int], schema) -> DataFrame:
    paths = [f"{out}/version={v}/bucket={b}" for b, v in sorted(of.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def retire(spark: SparkSession, out: str, used: set[int], number: int) -> None:
    """Removes versions that no list in use names, and lists before the last one."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in set(folders(spark, out, "version")) - used:
        if n < number:
            files.delete(place(f"{out}/version={n}"), True)
    for n in folders(spark, out, "list"):
        if n < number - 1:
            files.delete(place(f"{out}/list={n}"), True)


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The table after its last batch."""
    known = versions(spark, out, max(folders(spark, out, "list")))
    return stored(spark, out, known, spark.read.parquet(f"{out}/version={max(known.values())}").drop("bucket").schema)
