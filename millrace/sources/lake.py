"""The lake: Hive-partitioned CSV and JSON lines, read with explicit schemas and partition filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CODES, NEWS_ROW, RECIPE


def day_of() -> Column:
    """The date of a row's partition; null where a segment is no number or no date."""
    return F.expr("try_make_timestamp(try_cast(year AS INT), try_cast(month AS INT), try_cast(day AS INT), 0, 0, 0)").cast("date")


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def read_success(spark: SparkSession, root: str, process: str, *, information: str | None = None, since: str | None = None, prefix: str | None = None, schema: str = NEWS_ROW, form: str = "csv") -> DataFrame:
    """Rows of status=success under root/process=..., with their partition columns and _page_service.

    since: the earliest partition date; prefix: the service that file names begin with. Both prune before files are
    read, or by file name. Either information_cd= or category_cd= may name the kind of data. Broken files are skipped.
    """
    base = f"{root.rstrip('/')}/process={process}"
    reader = spark.read.schema(schema).option("basePath", root).option("ignoreCorruptFiles", "true").option("mode", "PERMISSIVE")
    if prefix:
        reader = reader.option("pathGlobFilter", f"{prefix}_*")
    reader = reader.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true") if form == "csv" else reader
    rows = reader.format(form).load(base)
    rows = rows.withColumn("_page_service", F.regexp_extract(file_name(), r"^(.*)_\d+(?:_\d+)?\.", 1))
    rows = rows.filter(F.col("status") == "success") if "status" in rows.columns else rows
    if information and "information_cd" in rows.columns:
        rows = rows.filter(F.coalesce("information_cd", F.lit(information)) == information)
    return rows.filter(day_of() >= F.lit(since).cast("date")) if since else rows


def write_partitioned(rows: DataFrame, root: str, by: list[str], *, form: str = "csv", mode: str = "append") -> None:
    """Writes under Hive partitions; files that are there are never overwritten."""
    writer = rows.write.mode(mode).partitionBy(*by)
    (writer.option("header", "true").option("escape", '"') if form == "csv" else writer).format(form).save(root)


#: Stage names of restaurant files and the process folders that they are kept in.
PROCESS_OF = {"candidate": "cleaning", "normalized": "cleaning", "image_validation": "cleaning", "load": "save", "retry": "failcheck", "reprocess": "failcheck", "drop": "failcheck", "warn": "failcheck"}


def lake_partition(stage: Column, code: Column) -> list[Column]:
    """process, category_cd and shop_cd of a stage and an input code: a shop code lies under the restaurant category."""
    process = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PROCESS_OF.items() for x in pair]), stage), stage)
    shop = code.startswith("SC")
    return [process.alias("process"), F.when(shop, "CA01").otherwise(code).alias("category_cd"), F.when(shop, code).alias("shop_cd")]


def information_of(rows: DataFrame, column: str = "information_cd", default: str = "IC02") -> str:
    """The commonest value of a column, the smallest among equals; the default for no rows."""
    found = rows.filter(F.col(column).isNotNull()).agg(F.mode(column, True)).first()
    return found[0] if found and found[0] is not None else default


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with the batch id that the file name holds; blank lines don't count."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("file_batch", F.regexp_extract(file_name(), r"(\d{8}_[A-Za-z0-9]+_\d+|\d{8}_\d+)", 1))


def read_codes(spark: SparkSession, path: str, group: str) -> DataFrame:
    """cd, name of a group's codes, trimmed and not empty; a byte order mark before the header doesn't matter."""
    rows = spark.read.schema(CODES).option("header", "true").option("enforceSchema", "true").csv(path)
    return rows.filter(F.trim("cd_upper") == group).select(F.trim("cd").alias("cd"), F.trim("name").alias("name")).filter("cd <> '' AND name <> ''")


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct non-blank values of a column in the order in which they come first."""
    return rows.filter(F.trim(column) != "").groupBy(column).agg(F.min(order).alias("at")).orderBy("at", column)


def menu_ingredients(rows: DataFrame, menu: str, ingredient: str, order: str) -> DataFrame:
    """menu, ingredients in input order. A missing table is an empty frame with these columns."""
    listed = rows.groupBy(menu).agg(F.sort_array(F.collect_list(F.struct(order, ingredient))).alias("x"))
    return listed.select(F.col(menu).alias("menu"), F.transform("x", lambda x: x[ingredient]).alias("ingredients"))


def recipe_ingredients(recipes: DataFrame, order: list[str]) -> DataFrame:
    """keyword, ingredient, recipe_url: of each keyword the ingredients of its first recipe that has any."""
    each = recipes.select(F.col("recipe_search_keyword").alias("keyword"), "recipe_url", *order, F.posexplode("ingredients").alias("pos", "i")).select("keyword", "recipe_url", F.struct(*order, "pos").alias("at"), F.trim("i.ingredient_name").alias("ingredient")).filter("keyword IS NOT NULL AND ingredient <> ''")
    first = each.groupBy("keyword").agg(F.min_by("recipe_url", "at").alias("first_url"))
    kept = each.join(first, "keyword").filter("recipe_url <=> first_url")
    return kept.groupBy("keyword", "ingredient", "recipe_url").agg(F.min("at").alias("at")).drop("at")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with file and line (the rows of a file are read in order)."""
    return spark.read.schema(RECIPE).json(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, content; text of .txt, .json and .csv whole, others as bytes decoded where they are UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.expr("try_validate_utf8(string(content))").alias("content"), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("kind"))


def json_rows(spark: SparkSession, payload: str, fields: str) -> DataFrame:
    """A JSON array of records as rows of the fields given (name: type, ...)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(payload), f"array<struct<{fields}>>")))


def seed_rows(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of a seed file: CSV with a header and doubled quotes. Filters on columns go down to the reader."""
    return spark.read.schema(fields).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_items(payload: Column, fields: str) -> Column:
    """Rows of the records in a column of JSON arrays, with the fields given (name: type, ...); others aren't read."""
    return F.inline(F.from_json(payload, f"array<struct<{fields}>>"))


def bound(spark: SparkSession, sql: str, args: dict | list | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised query over views that stand for the call only."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)


def jdbc(spark: SparkSession, url: str, source: str, *, split: tuple[str, int] | None = None, **options: str) -> DataFrame:
    """A database's table, or query in brackets with a name. Columns and filters used later go down to the database.

    split (a numeric column, parts) reads in that many parts by ranges between the column's least and largest value,
    which the database tells first; rows without a value are in the first part.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, **options)
    if split:
        column, parts = split
        low, high = reader.load().agg(F.min(column), F.max(column)).first()
        if low is not None and high > low:
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
    return reader.load()


def flagged_split(rows: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(success, fail) of one plan, without the flag."""
    marked = rows.withColumn("failed_row", F.coalesce(failed, F.lit(False)))
    return marked.filter("NOT failed_row").drop("failed_row"), marked.filter("failed_row").drop("failed_row")


def any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
