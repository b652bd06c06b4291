"""Joins with a checked number of partners, look-ups by several keys, and one row out of many."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def width(name: str, kind: T.DataType) -> Column:
    """Bytes that a column's value takes, roughly."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.octet_length(F.to_json(F.col(name)))
        return 16 + F.greatest(F.size(name), F.lit(0)) * 8 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1)
    return 16 + F.octet_length(F.col(name)) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(8)


def small_side(df: DataFrame, rows: int, *, megabytes: int = 64) -> DataFrame:
    """df, to be broadcast if it counts at most ``rows`` rows of ``megabytes`` in all; beyond that Spark shuffles both
    sides of the join. df should be a written or checkpointed table, or cheap to compute."""
    sizes = [F.coalesce(width(f.name, f.dataType), F.lit(8)).cast("long") for f in df.schema.fields]
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(reduce(add, sizes)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= megabytes << 20 else df


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, *, small: int = 200_000, hot: int = 1_000_000, common: int = 300_000) -> DataFrame:
    """rows joined to table(on, and n: how often rows have the key), without a task that takes all of a hot key.

    A small table is broadcast. Of a large one the keys with most rows are: those with ``hot`` rows and more, of which
    there are at most the number of rows over ``hot``, and others by powers of two while they are few (``common``);
    the rest meet in a shuffle. rows and table should be written or checkpointed tables.
    """
    side = small_side(table, small)
    if side is not table:
        return rows.join(side, on)
    powers = table.filter(F.col(n) < hot).groupBy(F.floor(F.log2(n)).cast("int").alias("p")).count().orderBy(F.desc("p")).collect()  # one a power of two
    for p, keys in powers:
        if keys > common:
            break
        common, hot = common - keys, min(hot, 2**p)
    heavy = F.broadcast(table.filter(F.col(n) >= hot))  # at most rows / hot keys and the common ones
    return rows.join(heavy, on).unionByName(rows.join(table.filter(F.col(n) < hot), on))


def keep_by(df: DataFrame, keys: Sequence[str], order: Column, *, last: bool = True) -> DataFrame:
    """One row a key: that of the largest (or smallest) order. Aggregates before it shuffles, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("kept")).select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest])


def latest_value(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """The value of the latest row of each key that has one; null where none has."""
    return df.groupBy(*keys).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), order)).alias(value))


def new_rows(incoming: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't known. Null keys are never known."""
    return incoming.join(known.select(*on).distinct(), list(on), "left_anti")


def one_to_one(facts: DataFrame, dims: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """facts with the columns of dims where the key has exactly one row there, and match_status for all.

    match_status is matched, ambiguous (several rows) or not_found (none, or a null key); columns are null but for
    matched. dims is counted per key before the join, so a key's many rows never multiply the facts.
    """
    counted = dims.groupBy(key).agg(F.count("*").alias("dim_rows"), *[F.first(c).alias(c) for c in columns])
    joined = facts.join(counted, key, "left")
    status = F.when(F.col("dim_rows") == 1, "matched").when(F.col("dim_rows") > 1, "ambiguous").otherwise("not_found")
    kept = [F.when(F.col("dim_rows") == 1, F.col(c)).alias(c) for c in columns]
    return joined.select(*facts.columns, *kept, status.alias("match_status"))


def any_key(facts: DataFrame, lookup: DataFrame, pairs: Sequence[tuple[Column, Column]], row: Sequence[str]) -> DataFrame:
    """Rows of facts (named by ``row``) that meet lookup on any pair of keys: an equi-join a pair, then distinct."""
    found = None
    for left, right in pairs:
        keys = lookup.select(right.alias("any_key")).filter("any_key IS NOT NULL").distinct()
        hit = facts.withColumn("any_key", left).join(keys, "any_key", "left_semi").select(*row)
        found = hit if found is None else found.unionByName(hit)
    return facts.join(found.distinct(), list(row), "left_semi")


def longest_prefix(texts: DataFrame, text: str, codes: DataFrame, name: str, code: str) -> DataFrame:
    """rows of texts that start with a name, with the code of the longest one, spaces aside, and the remainder.

    One equi-join on prefixes of the lengths that names have (a short list), instead of comparing all pairs.
    """
    bare = codes.select(F.replace(F.col(name), F.lit(" "), F.lit("")).alias("prefix"), F.col(code).alias("code")).filter("prefix <> ''").groupBy("prefix").agg(F.min("code").alias("code"))
    lengths = [r[0] for r in bare.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # at most the longest name's length of numbers
    given = texts.withColumn("bare_text", F.replace(F.col(text), F.lit(" "), F.lit("")))
    tried = given.withColumn("n", F.explode_outer(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).withColumn("prefix", F.expr("left(bare_text, n)"))
    hit = tried.filter(F.length("prefix") == F.col("n")).join(small_side(bare, 50_000), "prefix")
    best = hit.groupBy(*texts.columns, "bare_text").agg(F.max_by(F.struct("prefix", "code"), F.length("prefix")).alias("best"))
    return best.select(*texts.columns, F.col("best.code").alias("matched_code"), F.expr("substring(bare_text, length(best.prefix) + 1)").alias("remainder"))


def group_of_code(codes: DataFrame, code: str, name: str, upper: str, groups: DataFrame, group_code: str, group_name: str) -> DataFrame:
    """lookup (a code's name or the code itself), code, group: a code table joined to its groups, under both keys."""
    both = codes.join(groups.select(F.col(group_code).alias("g"), F.col(group_name).alias("group_name")), F.col(upper) == F.col("g"))
    return both.select(F.explode(F.array(F.col(code).cast("string"), F.col(name))).alias("lookup"), F.col(code).alias("code"), "group_name")


def global_rank(df: DataFrame, key: str, order: Sequence[Column], *, parts: int | None = None) -> DataFrame:
    """df with ``rank``: 1, 2, ... in the order given, whose first column is ``key``.

    Rows are sorted into ranges of the order (as many as shuffle partitions, up to 2000), numbered there and stored; a
    range's ranks go on from the sizes of those before it, so no task sees all rows. Only the sizes are gathered.
    """
    parts = parts or max(8, min(2000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(*order)
    numbered = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "ranks")  # the range and, in the lower 33 bits, the place there
    part = F.shiftright("place", 33)
    sizes = numbered.groupBy(part.alias("part")).count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    ranked = numbered.withColumn("part", part).join(F.broadcast(before), "part")  # a row a range
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "place", "before")


def quota(df: DataFrame, kind: str, priority: dict[str, int], order: str, *, cap: int, per_kind: int) -> DataFrame:
    """At most ``cap`` rows, kinds by priority, at most ``per_kind`` of each; rank from 1.

    Each kind is cut to its quota first (a bounded top-k), so the window over the rest sees few rows.
    """
    rank = F.coalesce(*[F.when(F.col(kind) == k, p) for k, p in priority.items()])
    parts = None
    for k in priority:
        part = df.filter(F.col(kind) == k).orderBy(order).limit(per_kind)
        parts = part if parts is None else parts.unionByName(part)
    ranked = parts.withColumn("pick_rank", F.row_number().over(Window.orderBy(rank, order)))
    return ranked.filter(F.col("pick_rank") <= cap)
