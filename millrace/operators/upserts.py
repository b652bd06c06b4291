"""Merges, inserts and replacements as joins. Results are written to a new place, never over what is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, key: Sequence[str], *, keep_on_null: bool) -> DataFrame:
    """target after a merge of source by key; columns of target.

    A matched row takes the source's columns, nulls too; with keep_on_null, a null leaves the target's value. Others
    are inserted. source must have one row a key. A null key matches nothing: such rows are inserted.
    """
    mine, theirs = target.withColumn("in_target", F.lit(True)).alias("t"), source.withColumn("in_source", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key]
    both = mine.join(theirs, on, "full_outer")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c))
        elif c not in source.columns:
            out.append(F.col(f"t.{c}").alias(c))
        elif keep_on_null:
            out.append(F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(F.col("in_source"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return both.select(*out)


def insert_missing(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """target with the rows of source whose key it doesn't have (the first of each key, by all columns)."""
    rest = [c for c in target.columns if c not in key]
    once = source.groupBy(*key).agg(F.min(F.struct(*rest)).alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in rest]) if rest else source.select(*key).distinct()
    return target.unionByName(once.join(target.select(*key), list(key), "left_anti").select(*target.columns))


def find_or_fill(target: DataFrame, source: DataFrame, key: Sequence[str], fill: Sequence[str], id_col: str) -> DataFrame:
    """target after find-or-insert by a null-safe key: found rows have their blank ``fill`` columns filled, others come
    in with ids after the largest. ``write_action`` tells kept, filled or inserted. source must have one row a key."""
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    blank = lambda c: F.nullif(F.trim(F.col(f"t.{c}")), F.lit(""))
    both = target.alias("t").join(source.alias("s").withColumn("in_source", F.lit(True)), same, "left")
    filled = [F.coalesce(blank(c), F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) if c in fill else F.col(f"t.{c}").alias(c) for c in target.columns]
    changed = F.lit(False)
    for c in fill:
        changed = changed | (blank(c).isNull() & F.col(f"s.{c}").isNotNull())
    kept = both.select(*filled, F.when(F.col("in_source") & changed, "filled").otherwise("kept").alias("write_action"))
    fresh = source.alias("s").join(target.alias("t"), same, "left_anti")
    numbered = with_next_ids(fresh, target, id_col, [c for c in key if c in source.columns])
    missing = [F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns if c not in source.columns and c != id_col]
    return kept.unionByName(numbered.select("*", *missing).select(*target.columns, F.lit("inserted").alias("write_action")))


def next_id(target: DataFrame, id_col: str) -> DataFrame:
    """One row: the number a sequence goes on from, at least 1."""
    return target.agg(F.greatest(F.coalesce(F.max(id_col), F.lit(0)) + 1, F.lit(1)).alias("next_id"))


def with_next_ids(rows: DataFrame, target: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """rows with ids after the largest of target, in the order given; numbers are dealt by hash ranges, not in one task."""
    from .relational import global_rank

    first = next_id(target, id_col).scalar()
    ranked = global_rank(rows.withColumn("spread", F.xxhash64(*order)), "spread", [F.col("spread"), *[F.col(c) for c in order]])
    return ranked.withColumn(id_col, (first + F.col("rank") - 1).cast("long")).drop("spread", "rank")


def replace_where(target: DataFrame, source: DataFrame, doomed: Column) -> DataFrame:
    """target without the rows that meet a row of source (aliases t and s) under ``doomed``, with source added."""
    left = target.alias("t").join(source.alias("s"), doomed, "left_anti")
    return left.unionByName(source.select(*target.columns))


def content_hash(columns: Sequence[str]) -> Column:
    """sha256 over the columns in order; strings are trimmed and white space collapsed, the null family is one value."""

    def canonical(c: str) -> Column:
        text = F.regexp_replace(F.trim(F.col(c).cast("string")), r"\s+", " ")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit("null"))

    return F.sha2(F.concat_ws("|", *[canonical(c) for c in columns]), 256)


def changes(current: DataFrame, previous: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """current with is_new and is_changed_<hash>, compared null-safely with the previous snapshot."""
    before = previous.select(F.col(key).alias("old_key"), *[F.col(h).alias(f"old_{h}") for h in hashes])
    both = current.join(before, F.col(key) == F.col("old_key"), "left")
    flags = [(~F.col(h).eqNullSafe(F.col(f"old_{h}"))).alias(f"is_changed_{h}") for h in hashes]
    return both.select(*current.columns, F.col("old_key").isNull().alias("is_new"), *flags)
