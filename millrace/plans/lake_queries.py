"""Lake sources and sinks: each query writes the driver's rows in a source's format and reads them again."""

from __future__ import annotations

import glob
import os
import tempfile
import zipfile
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.stores import zipped
from ..operators import records
from ..sources import lake
from ..streaming.ingest import place
from .base import Registry, table

registry = Registry()
query = registry.query
SINCE = "2024-01-15"


@query(f"""SELECT 'th_' || event_id AS thread, 'T "' || event_type || '", x' AS title, CAST(event_id % 100 AS INTEGER) AS view_count, value AS point
FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0 AND CAST(ts AS DATE) >= DATE '{SINCE}'""")
def lake_success(spark, sf_dir):
    """Hive partitions of CSV files by process, information, day and status; read from a day on, one kind of data."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.format_string('T "%s", x', "event_type").alias("title"), F.lit("c\nd").alias("content"), F.lit("https://x").alias("article_url"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.concat(F.lit("th_"), "event_id").alias("thread"),
        F.lit("CA07").alias("category_cd"), (F.col("event_id") % 100).cast("int").alias("view_count"), F.lit(0).alias("comment_count"), F.col("value").alias("point"), F.lit("me").alias("author"), F.lit(0).cast("long").alias("map_id"), F.lit(None).cast("string").alias("shop_cd"), F.lit(None).cast("string").alias("keywords"),
        F.lit("raw").alias("process"), F.when(F.col("event_id") % 3 == 0, "IC01").otherwise("IC02").alias("information_cd"), F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"), F.date_format("ts", "dd").alias("day"), F.when(F.col("event_id") % 5 == 0, "fail").otherwise("success").alias("status"),
    )
    root = place(spark, "lake")
    by = ["process", "information_cd", "year", "month", "day", "status"]
    lake.write_partitioned(rows.repartition("year", "month", "day"), root, by)
    return lake.read_success(spark, root, "raw", information="IC02", since=SINCE).select("thread", "title", "view_count", "point")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0")
def json_lines(spark, sf_dir):
    """JSON lines with blank lines between them."""
    rows = table(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.concat(F.to_json(F.struct("event_id", "event_type", "value")), F.lit("\n")).alias("value"))
    path = place(spark, "json-lines")
    rows.write.text(path)
    return lake.read_json_lines(spark, path, "event_id long, event_type string, value double").select("event_id", "event_type", "value")


@query("SELECT 'N' || n_nationkey AS cd, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 AND n_nationkey % 7 <> 0")
def code_table(spark, sf_dir):
    """A code table whose header begins with a byte order mark; blank codes go."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select(F.when(F.col("n_nationkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" N"), "n_nationkey")).alias("﻿cd"), F.concat("n_name", F.lit(" ")).alias("name"), F.lit("i").alias("cd_info"), F.concat(F.lit("R"), "r_regionkey").alias("cd_upper"))
    path = place(spark, "codes")
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return lake.read_codes(spark, path, "R1")


@query("SELECT CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS kind, min(o_orderkey) AS first_at FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1")
def first_seen_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("kind"), "o_orderkey")
    return lake.first_seen(rows, "kind", "o_orderkey").select("kind", F.col("at").alias("first_at"))


@query("SELECT p_type AS menu, string_agg(p_name, ',' ORDER BY p_partkey) AS ingredients FROM part GROUP BY 1")
def menu_multimap(spark, sf_dir):
    made = lake.menu_ingredients(table(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey")
    return made.select("menu", F.array_join("ingredients", ",").alias("ingredients"))


@query("""
WITH r AS (SELECT 'k' || o_custkey % 97 AS keyword, 'u' || o_orderkey AS url, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE ['i' || o_orderkey % 11, ' ', 'i' || o_orderkey % 13, 'i' || o_orderkey % 11] END AS xs FROM orders),
e AS (SELECT keyword, url, k, trim(unnest(xs)) AS ingredient FROM r),
f AS (SELECT keyword, arg_min(url, k) AS url FROM e WHERE ingredient <> '' GROUP BY 1)
SELECT DISTINCT e.keyword, e.ingredient, e.url AS recipe_url FROM e JOIN f ON e.keyword = f.keyword AND e.url = f.url WHERE ingredient <> ''""")
def recipe_first(spark, sf_dir):
    """Recipes as JSON lines; the first one of a keyword that has ingredients counts."""
    k = F.col("o_orderkey")
    named = lambda n: F.struct(F.concat(F.lit("i"), k % n).alias("ingredient_name"))
    some = F.array(named(11), F.struct(F.lit(" ").alias("ingredient_name")), named(13), named(11))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_custkey") % 97).alias("recipe_search_keyword"), F.concat(F.lit("u"), k).alias("recipe_url"), F.when(k % 4 == 0, F.slice(some, 1, 0)).otherwise(some).alias("ingredients"))
    path = place(spark, "recipes")
    rows.write.json(path)
    read = lake.read_recipes(spark, path).withColumn("at", F.substring("recipe_url", 2, 20).cast("long"))
    return lake.recipe_ingredients(read, ["at"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def bound_query(spark, sf_dir):
    return lake.bound(spark, "SELECT c_custkey, c_name FROM bound_customer WHERE c_acctbal > :low AND array_contains(:kinds, c_mktsegment)", {"low": 5000, "kinds": F.array(F.lit("BUILDING"), F.lit("MACHINERY"))}, bound_customer=table(spark, sf_dir, "customer"))


def database(spark, sf_dir) -> str:
    """Address of a database of the customers, a file in the shared folder that every JVM opens by itself.

    It stands for a server: Spark writes CSV parts there, the database imports them one by one on the driver's disk, and
    its closed files become an archive, stored without compression so that a page is read at its place.
    """
    folder = place(spark, "database")
    shared = urlparse(folder)
    if shared.scheme not in ("", "file"):
        raise ValueError("the database needs a shared folder that is mounted as files")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    fields = ["c_custkey", quoted("c_name"), "c_nationkey", "c_acctbal", quoted("c_mktsegment")]
    lines = F.array_join(F.array(*[F.col(f).cast("string") if isinstance(f, str) else f for f in fields]), ",", "")  # nothing stands for null
    table(spark, sf_dir, "customer").select(lines.alias("value")).write.text(f"{folder}/csv")
    with tempfile.TemporaryDirectory(prefix="millrace-") as place_of_files:
        url = f"jdbc:derby:{place_of_files}/customers"
        drivers = spark._jvm.java.sql.DriverManager
        c = drivers.getConnection(f"{url};create=true")
        c.createStatement().execute('CREATE TABLE customers ("c_custkey" BIGINT, "c_name" VARCHAR(64), "c_nationkey" INTEGER, "c_acctbal" DOUBLE, "c_mktsegment" VARCHAR(32))')
        load = c.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'CUSTOMERS', ?, ',', '\"', 'UTF-8', 0)")
        for part in sorted(glob.glob(f"{glob.escape(shared.path)}/csv/part-*")):
            load.setString(1, part)
            load.execute()
        c.createStatement().execute('CREATE INDEX by_key ON customers ("c_custkey")')
        c.close()
        try:
            drivers.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as closed:  # the database says by an error that it is closed
            if closed.java_exception.getSQLState() != "08006":
                raise
        archive = f"{shared.path}/customers.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_STORED) as z:
            for path in glob.glob(f"{place_of_files}/customers/**", recursive=True):
                z.write(path, os.path.relpath(path, place_of_files))
    return f"jdbc:derby:jar:({archive})customers"


@query("SELECT * FROM customer")
def database_scan(spark, sf_dir):
    """A whole table of a database, read in four parts by ranges of its key."""
    return lake.jdbc(spark, database(spark, sf_dir), "customers", split=("c_custkey", 4))


@query("SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def database_column(spark, sf_dir):
    """One column of a database's table; the filter and the choice of columns are the database's work."""
    return lake.jdbc(spark, database(spark, sf_dir), "customers").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 1000").select("c_name")


@query("SELECT n_name || chr(10) AS content, 'txt' AS kind FROM nation")
def document_files(spark, sf_dir):
    """A text file a nation, read whole."""
    path = place(spark, "files")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return lake.read_documents(spark, path).select("content", "kind")


@query("""SELECT c_custkey, c_custkey % 4 = 0 OR c_custkey % 10 = 3 AS failed FROM customer""")
def success_and_failure(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 10 != 3, F.col("c_mktsegment")).alias("b"))
    good, bad = lake.flagged_split(rows, lake.any_null("a", "b"))
    return good.select("c_custkey", F.lit(False).alias("failed")).unionByName(bad.select("c_custkey", F.lit(True).alias("failed")))


@query("""
WITH g AS (SELECT o_orderkey, ['candidate', 'load', 'retry', 'crawl'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS stage, ['SC01', 'CA02', 'SC06'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS code FROM orders)
SELECT CASE stage WHEN 'candidate' THEN 'cleaning' WHEN 'load' THEN 'save' WHEN 'retry' THEN 'failcheck' ELSE stage END AS process, CASE WHEN starts_with(code, 'SC') THEN 'CA01' ELSE code END AS category_cd, CASE WHEN starts_with(code, 'SC') THEN code END AS shop_cd, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def lake_partitions(spark, sf_dir):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % n).cast("int"))
    rows = table(spark, sf_dir, "orders").select(*lake.lake_partition(pick(("candidate", "load", "retry", "crawl"), 4), pick(("SC01", "CA02", "SC06"), 3)))
    return rows.groupBy("process", "category_cd", "shop_cd").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' a' || c_custkey END), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN c_name END), ''), nullif(trim(c_mktsegment), '')) AS filled FROM customer""")
def first_filled(spark, sf_dir):
    k = F.col("c_custkey")
    filled = S.first_filled(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" a"), k)), F.when(k % 2 == 0, F.col("c_name")), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", filled.alias("filled"))


@query("""
WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS t, list('http://x/' || o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 3 <> 0) AS u FROM orders GROUP BY 1),
z AS (SELECT o_custkey, unnest(range(1, least(len(t), len(coalesce(u, []))) + 1)) AS i, t, u FROM a)
SELECT o_custkey, t[i] AS title, u[i] AS url FROM z""")
def zip_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("t"), F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")))).alias("u"))
    urls = F.transform("u", lambda k: F.concat(F.lit("http://x/"), k))
    return rows.select("o_custkey", F.inline(zipped(("title", "url"), F.col("t"), urls)))


@query("""
WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Seoul ' || user_id WHEN 1 THEN 'Busan ' || user_id ELSE ' ' END AS address, CASE WHEN event_id % 3 <> 1 THEN 'S' || event_id END AS shop FROM events)
SELECT 'e' || event_id AS entity_id, address, shop, trim(concat_ws(' ', address, coalesce(shop, ''))) AS search_query, true AS is_retry FROM f WHERE trim(address) <> ''""")
def retry_targets(spark, sf_dir):
    """Targets of failures whose address stands in the reference or in the data."""
    k, address = F.col("event_id"), F.concat(F.when(F.col("event_id") % 3 == 0, "Seoul ").otherwise("Busan "), "user_id")
    ref = F.when(k % 3 == 0, F.create_map(F.lit("address_name"), address, F.lit("shop_name"), F.concat(F.lit("S"), k))).when(k % 3 == 2, F.create_map(F.lit("address_name"), F.lit(" "), F.lit("shop_name"), F.concat(F.lit("S"), k)))
    data = F.when(k % 3 == 1, F.to_json(F.struct(F.struct(F.struct(address.alias("address_name")).alias("entity_ref")).alias("metadata"))))
    fails = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), k).alias("entity_id"), ref.alias("entity_ref"), data.alias("data"), F.lit("TIMEOUT").alias("reason_code"))
    made = records.target_items(records.retry_targets(fails).withColumn("url", F.lit(None).cast("string")))
    return made.select("entity_id", "address", "shop", "search_query", "is_retry")


QUERIES, ORACLES = registry.queries, registry.oracles
