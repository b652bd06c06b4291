"""Helpers the operators share: tables in the cluster's shared folder, checked broadcasts, let-bindings."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import hot_join, small_side
from ..session import shared_dir

__all__ = ["hot_join", "let", "literal_table", "read_table", "shared_dir", "small_side", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: computed once, and without lineage to recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often a lambda in the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small constant table; fields: ``name type, ...``."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
