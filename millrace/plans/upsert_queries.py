"""Merges, idempotent inserts, replacements, change detection and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upserts as U
from .base import Registry, table

registry = Registry()
query = registry.query


def target_and_source(spark, sf_dir):
    """customer, and a later batch: its odd half with new balances (null for every fifth) and the suppliers as new rows."""
    customer = table(spark, sf_dir, "customer")
    again = customer.filter("c_custkey % 2 = 1").select("c_custkey", "c_name", (F.col("c_nationkey") + 1).alias("c_nationkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    fresh = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return customer, again.unionByName(fresh)


SOURCE = """
WITH src AS (
  SELECT c_custkey, c_name, c_nationkey + 1 AS c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT s_suppkey + 10000000, s_name, s_nationkey, s_acctbal, 'NEW' FROM supplier)"""


@query(SOURCE + """
SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey,
  CASE WHEN s.c_custkey IS NULL THEN t.c_name ELSE s.c_name END AS c_name, CASE WHEN s.c_custkey IS NULL THEN t.c_nationkey ELSE s.c_nationkey END AS c_nationkey,
  CASE WHEN s.c_custkey IS NULL THEN t.c_acctbal ELSE s.c_acctbal END AS c_acctbal, CASE WHEN s.c_custkey IS NULL THEN t.c_mktsegment ELSE s.c_mktsegment END AS c_mktsegment
FROM customer t FULL JOIN src s ON t.c_custkey = s.c_custkey""")
def merge_overwrite(spark, sf_dir):
    return U.merge(*target_and_source(spark, sf_dir), ["c_custkey"], keep_on_null=False)


@query(SOURCE + """
SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_nationkey, t.c_nationkey) AS c_nationkey,
  coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment
FROM customer t FULL JOIN src s ON t.c_custkey = s.c_custkey""")
def merge_coalesce(spark, sf_dir):
    return U.merge(*target_and_source(spark, sf_dir), ["c_custkey"], keep_on_null=True)


@query(SOURCE + " SELECT * FROM customer UNION ALL SELECT * FROM src WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = src.c_custkey)")
def insert_do_nothing(spark, sf_dir):
    return U.insert_missing(*target_and_source(spark, sf_dir), ["c_custkey"])


@query("""
SELECT n_nationkey AS code, n_name AS name FROM nation
UNION ALL SELECT code, name FROM (SELECT s_nationkey + 20 AS code, min(s_name) AS name FROM supplier GROUP BY 1) s WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.code)""")
def insert_natural_key(spark, sf_dir):
    target = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    source = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 20).alias("code"), F.col("s_name").alias("name"))
    return U.insert_missing(target, source, ["code"])


@query("""
WITH t AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS area, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS code FROM customer WHERE c_custkey < 400),
s AS (SELECT c_name AS name, c_nationkey AS area, 'FILL' AS code FROM customer WHERE c_custkey >= 300 AND c_custkey < 500)
SELECT CASE WHEN s.name IS NOT NULL AND trim(t.code) = '' THEN s.code ELSE t.code END AS code, t.name,
  CASE WHEN s.name IS NOT NULL AND trim(t.code) = '' THEN 'filled' ELSE 'kept' END AS write_action
FROM t LEFT JOIN s ON t.name IS NOT DISTINCT FROM s.name AND t.area IS NOT DISTINCT FROM s.area
UNION ALL SELECT s.code, s.name, 'inserted' FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name IS NOT DISTINCT FROM s.name AND t.area IS NOT DISTINCT FROM s.area)""")
def find_or_insert_fill(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    target = customer.filter("c_custkey < 400").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("area"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("code"))
    source = customer.filter("c_custkey >= 300 AND c_custkey < 500").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("area"), F.lit("FILL").alias("code"))
    return U.find_or_fill(target, source, ["name", "area"], ["code"], "id").select("code", "name", "write_action")


@query("""
WITH s AS (SELECT o_orderkey + 1000000 AS o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE s.o_custkey = o.o_custkey AND s.o_orderstatus = o.o_orderstatus AND (s.o_orderdate = o.o_orderdate OR o.o_orderdate < TIMESTAMP '1996-01-01'))
UNION ALL SELECT * FROM s""")
def replace_scope(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    source = orders.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)
    doomed = F.expr("s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND (s.o_orderdate = t.o_orderdate OR t.o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00')")
    return U.replace_where(orders, source, doomed)


@query("""
WITH cur AS (SELECT c_custkey, sha256(concat_ws('|', coalesce(nullif(regexp_replace(trim(c_name), '\\s+', ' ', 'g'), ''), 'null'), coalesce(CAST(c_nationkey AS VARCHAR), 'null'))) AS h FROM customer),
old AS (SELECT c_custkey, sha256(concat_ws('|', coalesce(nullif(regexp_replace(trim(c_name), '\\s+', ' ', 'g'), ''), 'null'), CAST(CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS VARCHAR))) AS h FROM customer WHERE c_custkey % 4 <> 0)
SELECT cur.c_custkey, old.c_custkey IS NULL AS is_new, cur.h IS DISTINCT FROM old.h AS is_changed_h FROM cur LEFT JOIN old USING (c_custkey)""")
def change_detection(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    hashed = lambda df: df.select("c_custkey", U.content_hash(["c_name", "c_nationkey"]).alias("h"))
    old = customer.filter("c_custkey % 4 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, 99).otherwise(F.col("c_nationkey")))
    return U.changes(hashed(customer), hashed(old), "c_custkey", ["h"]).select("c_custkey", "is_new", "is_changed_h")


@query("SELECT CAST(greatest(coalesce(max(o_orderkey), 0) + 1, 1) AS BIGINT) AS next_id FROM orders")
def sequence_next(spark, sf_dir):
    return U.next_id(table(spark, sf_dir, "orders"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'touch_only' ELSE 'update' END AS plan,
  CASE WHEN o_orderstatus = 'F' THEN false ELSE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END, true) END AS write_menu FROM orders""")
def change_plan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1)
    touch = F.col("o_orderstatus") == "F"
    return orders.select("o_orderkey", F.when(touch, "touch_only").otherwise("update").alias("plan"), F.when(touch, F.lit(False)).otherwise(F.coalesce(flag, F.lit(True))).alias("write_menu"))


@query("""WITH n AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000)
SELECT s_name, row_number() OVER (ORDER BY s_suppkey) > 0 AS numbered FROM n""")
def insert_with_ids(spark, sf_dir):
    fresh = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_name")
    made = U.with_next_ids(fresh, table(spark, sf_dir, "customer"), "c_custkey", ["s_name"])
    return made.select("s_name", (F.col("c_custkey") > 0).alias("numbered"))


QUERIES, ORACLES = registry.queries, registry.oracles
