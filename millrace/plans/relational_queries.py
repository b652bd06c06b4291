"""Candidate selection, joins with checked partners, one row out of many, gates and quotas.

Shops are customers, their addresses nations, posts and reviews orders; the clock is pinned to the last order's day.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .base import Registry, table

registry = Registry()
query = registry.query
TODAY = "2001-08-01"


@query("""
WITH last_post AS (SELECT o_custkey, max(o_orderdate) AS last_post FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
usable AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')),
candidates AS (
  SELECT o_custkey FROM usable GROUP BY o_custkey
  HAVING count(*) >= 5 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = usable.o_custkey AND CAST(p.o_orderdate AS DATE) = DATE '2001-08-01' AND p.o_orderpriority = '1-URGENT')),
picked AS (
  SELECT 'IC01' AS information_cd, u.o_custkey AS shop_id, u.o_orderkey AS row_id, u.o_orderdate AS created_at, u.o_totalprice AS score
  FROM usable u JOIN candidates c ON u.o_custkey = c.o_custkey LEFT JOIN last_post l ON u.o_custkey = l.o_custkey
  WHERE (l.last_post IS NULL OR l.last_post <= TIMESTAMP '2001-07-31') AND (l.last_post IS NULL OR u.o_orderdate > l.last_post)
  UNION ALL
  SELECT 'IC02', NULL, o.o_orderkey, o.o_orderdate, coalesce(o.o_totalprice, 1.0) FROM orders o
  WHERE o.o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1))
SELECT p.information_cd, p.shop_id, p.row_id, p.created_at, p.score, n.n_name AS area FROM picked p
LEFT JOIN customer c ON p.shop_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def candidate_groups(spark, sf_dir):
    orders, customer, nation, lineitem = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    last_post = urgent.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_post"))
    usable = orders.filter(F.col("o_orderstatus").isin("F", "O"))
    posted_today = urgent.filter(F.to_date("o_orderdate") == F.lit(TODAY).cast("date")).select("o_custkey")
    candidates = usable.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 5").join(posted_today, "o_custkey", "left_anti")
    shops = (
        usable.join(candidates.select("o_custkey"), "o_custkey")
        .join(last_post, "o_custkey", "left")
        .filter("last_post IS NULL OR (last_post <= TIMESTAMP_NTZ '2001-07-31 00:00:00' AND o_orderdate > last_post)")
        .select(F.lit("IC01").alias("information_cd"), F.col("o_custkey").alias("shop_id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"))
    )
    written = lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    news = orders.filter("o_orderstatus = 'P'").join(written, "o_orderkey", "left_anti").select(F.lit("IC02").alias("information_cd"), F.lit(None).cast("long").alias("shop_id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("created_at"), F.coalesce("o_totalprice", F.lit(1.0)).alias("score"))
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("shop_id"), F.col("n_name").alias("area"))
    return shops.unionByName(news).join(places, "shop_id", "left").select("information_cd", "shop_id", "row_id", "created_at", "score", "area")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_new_rows(spark, sf_dir):
    return R.new_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


ONE_TO_ONE = """
WITH s AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 6000 GROUP BY 1),
m AS (SELECT c_custkey, c_nationkey, CASE WHEN n = 1 THEN s.s_suppkey END AS s_suppkey,
  CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS match_status
  FROM customer LEFT JOIN s ON c_nationkey = s_nationkey)"""


def matched(spark, sf_dir):
    dims = table(spark, sf_dir, "supplier").filter("s_acctbal > 6000").withColumnRenamed("s_nationkey", "c_nationkey")
    return R.one_to_one(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), dims, "c_nationkey", ["s_suppkey"])


@query(ONE_TO_ONE + " SELECT c_custkey, c_nationkey, s_suppkey FROM m WHERE match_status = 'matched'")
def one_to_one_match(spark, sf_dir):
    return matched(spark, sf_dir).filter("match_status = 'matched'").drop("match_status")


@query(ONE_TO_ONE + " SELECT match_status, count(*) AS n FROM m WHERE match_status <> 'matched' GROUP BY 1")
def one_to_one_rejects(spark, sf_dir):
    return matched(spark, sf_dir).filter("match_status <> 'matched'").groupBy("match_status").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS orphans FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'en') d USING (doc_id) WHERE d.doc_id IS NULL")
def orphan_count(spark, sf_dir):
    known = table(spark, sf_dir, "documents").filter("lang <> 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(known, "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT o_orderkey, c_custkey AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def fk_sanitise(spark, sf_dir):
    valid = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").join(valid, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_custkey").alias("o_custkey"))


@query("""SELECT lookup, n.n_nationkey AS code, r.r_name AS group_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey,
  unnest([CAST(n.n_nationkey AS VARCHAR), n.n_name]) AS u(lookup)""")
def code_lookup_self_join(spark, sf_dir):
    return R.group_of_code(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", "r_name")


@query("""
WITH a AS (SELECT c_custkey, 'NATION_' || c_nationkey || ' street ' || c_custkey AS address FROM customer),
n AS (SELECT replace(n_name, ' ', '') AS prefix, min(n_nationkey) AS code FROM nation GROUP BY 1)
SELECT c_custkey, address, arg_max(code, length(prefix)) AS matched_code,
  substr(replace(address, ' ', ''), max(length(prefix)) + 1) AS remainder
FROM a JOIN n ON starts_with(replace(address, ' ', ''), prefix) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY c_custkey, address"))
def longest_prefix_match(spark, sf_dir):
    addresses = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), "c_nationkey", F.lit(" street "), "c_custkey").alias("address"))
    return R.longest_prefix(addresses, "address", table(spark, sf_dir, "nation"), "n_name", "n_nationkey")


@query("""
WITH k AS (SELECT s_suppkey, s_nationkey, s_name FROM supplier WHERE s_acctbal > 9000)
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM k WHERE k.s_suppkey = c.c_custkey)
  OR EXISTS (SELECT 1 FROM k WHERE replace(k.s_name, 'Supplier', 'Customer') || '|' || k.s_nationkey = c.c_name || '|' || c.c_nationkey)""")
def or_key_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000")
    name = F.concat_ws("|", "c_name", "c_nationkey")
    given = F.concat_ws("|", F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer")), F.col("s_nationkey"))
    return R.any_key(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), keys, [(F.col("c_custkey"), F.col("s_suppkey")), (name, given)], ["c_custkey"]).select("c_custkey")


@query("""
WITH d AS (SELECT lower(trim(p_name)) AS alias, count(DISTINCT p_brand) AS n, min(p_brand) AS brand FROM part WHERE p_size < 6 GROUP BY 1)
SELECT p.p_partkey, CASE WHEN n = 1 THEN brand END AS canonical, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'conflict' ELSE 'unresolved' END AS alias_status
FROM part p LEFT JOIN d ON lower(trim(p.p_name)) = d.alias""")
def dict_alias_conflict(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    alias = F.lower(F.trim("p_name"))
    entries = part.filter("p_size < 6").groupBy(alias.alias("alias")).agg(F.count_distinct("p_brand").alias("n"), F.min("p_brand").alias("brand"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "conflict").otherwise("unresolved")
    return part.withColumn("alias", alias).join(entries, "alias", "left").select("p_partkey", F.when(F.col("n") == 1, F.col("brand")).alias("canonical"), status.alias("alias_status"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC")
def distinct_on_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.keep_by(orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'view'")
def keep_last_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "event_id", "value")
    return R.keep_by(events, ["user_id"], F.col("event_id"))


@query("SELECT p_brand, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
def first_wins_dedup(spark, sf_dir):
    return R.keep_by(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name").withColumn("at", F.col("p_partkey")), ["p_brand"], F.col("at"), last=False).drop("at")


@query("""SELECT o_custkey, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS latest
FROM orders GROUP BY 1""")
def latest_non_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("latest", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return R.latest_value(orders, ["o_custkey"], "latest", F.struct("o_orderdate", "o_orderkey"))


@query("""SELECT c_custkey, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1
HAVING max(o_orderdate) IS NULL OR max(o_orderdate) <= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY ORDER BY last_seen ASC NULLS FIRST, c_custkey LIMIT 100""")
def stale_targets(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen"))
    both = table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.filter("last_seen IS NULL OR last_seen <= TIMESTAMP_NTZ '2001-08-01 00:00:00' - INTERVAL 30 DAYS").orderBy(F.asc_nulls_first("last_seen"), "c_custkey").limit(100).select("c_custkey", "last_seen")


@query("SELECT event_type, coalesce(max(ts), TIMESTAMP '2024-01-31' - INTERVAL 90 DAY) AS watermark FROM events WHERE starts_with(event_type, 'c') OR starts_with(event_type, 'v') GROUP BY 1")
def watermark_max(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(F.col("event_type").startswith("c") | F.col("event_type").startswith("v"))
    return events.groupBy("event_type").agg(F.coalesce(F.max("ts"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 90 DAYS")).alias("watermark"))


@query("""WITH w AS (SELECT user_id, max(ts) AS threshold FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id, e.user_id, e.ts FROM events e JOIN w USING (user_id) WHERE e.ts > w.threshold""")
def watermark_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    marks = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("threshold"))
    return events.join(marks, "user_id").filter("ts > threshold").select("event_id", "user_id", "ts")


@query("""SELECT source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS positive_ratio FROM documents JOIN labels USING (doc_id)
GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) >= 0.7""")
def positive_ratio_gate(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ratio = F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))
    return both.groupBy("source").agg(F.count("*").alias("n"), ratio.alias("ratio")).filter("n >= 5 AND ratio >= 0.7").select("source", "n", F.round("ratio", 6).alias("positive_ratio"))


@query("SELECT event_type, value AS mode_value, n FROM (SELECT event_type, v AS value, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, v) AS r FROM (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1")
def mode_by_group(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("v")).agg(F.count("*").alias("n"))
    best = counts.groupBy("event_type").agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("low"))).alias("mode_value"), F.max("n").alias("n"))
    return best


@query("""
WITH k AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'RETRY' WHEN 'F' THEN 'UPDATE' ELSE 'NEW' END AS target FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o_orderkey) AS t FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY CASE target WHEN 'RETRY' THEN 0 WHEN 'UPDATE' THEN 1 ELSE 2 END, o_orderkey) AS pick_rank FROM r WHERE t <= 60)
SELECT o_orderkey, target, pick_rank FROM p WHERE pick_rank <= 100""")
def quota_fill(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "P", "RETRY").when(F.col("o_orderstatus") == "F", "UPDATE").otherwise("NEW")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("target"))
    return R.quota(rows, "target", {"RETRY": 0, "UPDATE": 1, "NEW": 2}, "o_orderkey", cap=100, per_kind=60)


@query("SELECT c_custkey, lpad(CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS VARCHAR), 3, '0') AS shard FROM customer")
def shard_assign(spark, sf_dir):
    ranked = R.global_rank(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", [F.col("c_custkey")])
    return ranked.select("c_custkey", F.lpad(F.floor((F.col("rank") - 1) / 100).cast("string"), 3, "0").alias("shard"))


@query("""SELECT event_id, user_id, coalesce(event_type <> before AND floor(value) <> floor(amount), false) AS suspicious FROM (
  SELECT *, lag(event_type) OVER w AS before, lag(value) OVER w AS amount FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def suspicious_login(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = table(spark, sf_dir, "events").withColumns({"before": F.lag("event_type").over(w), "amount": F.lag("value").over(w)})
    odd = (F.col("event_type") != F.col("before")) & (F.floor("value") != F.floor("amount"))
    return seen.select("event_id", "user_id", F.coalesce(odd, F.lit(False)).alias("suspicious"))


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.quality IS NULL OR l.toxic IS NULL) AND d.lang <> 'en' ORDER BY d.doc_id LIMIT 200")
def pending_work(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.filter("(quality IS NULL OR toxic IS NULL) AND lang <> 'en'").orderBy("doc_id").limit(200).select("doc_id", "lang")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'CA07' ELSE 'CA01' END AS category_cd, CASE lang WHEN 'en' THEN 'IC02' ELSE 'IC01' END AS information_cd,
 CASE WHEN lang <> 'en' THEN CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END ELSE 'positive' END AS sentimental,
 CASE WHEN lang <> 'en' THEN CAST(toxic AS DOUBLE) ELSE coalesce(CAST(toxic AS DOUBLE), n_chars / 1000.0, 1.0) END AS score
FROM documents LEFT JOIN labels USING (doc_id)""")
def category_case(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    news = F.col("lang") == "en"
    label = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    toxic = F.col("toxic").cast("double")
    return both.select("doc_id", F.when(news, "CA07").otherwise("CA01").alias("category_cd"), F.when(news, "IC02").otherwise("IC01").alias("information_cd"), F.when(news, "positive").otherwise(label).alias("sentimental"), F.when(news, F.coalesce(toxic, F.col("n_chars") / 1000.0, F.lit(1.0))).otherwise(toxic).alias("score"))


@query("""SELECT CASE WHEN n.n_nationkey IS NULL THEN 'REFERENCE_INTEGRITY_VIOLATION' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'UNDEFINED_CODE_DETECTED' ELSE 'success' END AS outcome, count(*) AS n
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) n ON c_nationkey = n.n_nationkey GROUP BY 1""")
def reference_integrity(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").filter("n_regionkey <> 4")
    both = table(spark, sf_dir, "customer").join(codes, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    outcome = F.when(F.col("n_nationkey").isNull(), "REFERENCE_INTEGRITY_VIOLATION").when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "UNDEFINED_CODE_DETECTED").otherwise("success")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(100).select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, round(sqrt(pow(p_size - 25, 2) + pow(p_retailprice - 1000, 2)), 4) AS distance FROM part
WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL AND sqrt(pow(p_size - 25, 2) + pow(p_retailprice - 1000, 2)) <= 40 ORDER BY distance, p_partkey LIMIT 50""")
def radius_sort(spark, sf_dir):
    near = F.sqrt(F.pow(F.col("p_size") - 25, F.lit(2)) + F.pow(F.col("p_retailprice") - 1000, F.lit(2)))
    rows = table(spark, sf_dir, "part").filter("p_size IS NOT NULL AND p_retailprice IS NOT NULL").withColumn("d", near).filter("d <= 40")
    return rows.select("p_partkey", F.round("d", 4).alias("distance")).orderBy("distance", "p_partkey").limit(50)


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders)")
def global_row_numbers(spark, sf_dir):
    return R.global_rank(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [F.col("o_orderkey")])


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY 1, 2 HAVING count(*) >= 3")
def distinct_from_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").eqNullSafe("F")).groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).filter("n >= 3")


@query("""SELECT kind, id FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey = 3
 UNION SELECT 'customer', c_custkey FROM customer WHERE c_acctbal > 9000)""")
def distinct_union(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    parts = (named(customer.filter("c_nationkey = 3"), "customer", "c_custkey"), named(table(spark, sf_dir, "supplier").filter("s_nationkey = 3"), "supplier", "s_suppkey"), named(customer.filter("c_acctbal > 9000"), "customer", "c_custkey"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("SELECT batch, lpad(CAST(max(CAST(seq AS BIGINT)) + 1 AS VARCHAR), 3, '0') AS next_sequence FROM (SELECT strftime(o_orderdate, '%Y%m%d') AS batch, CAST(o_orderkey % 100 AS VARCHAR) AS seq FROM orders) GROUP BY 1")
def next_batch_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("batch"), F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), (F.col("o_orderkey") % 100).cast("string")).alias("batch_id"))
    last = F.element_at(F.split("batch_id", "_"), -1)
    return rows.groupBy("batch").agg(F.lpad((F.max(last.try_cast("long")) + 1).cast("string"), 3, "0").alias("next_sequence"))


@query("SELECT c_custkey AS c_custkey, coalesce(n, 0) AS n_orders, c_mktsegment AS category FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY coalesce(n, 0) DESC, c_custkey LIMIT 100")
def popular_sort(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    both = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("c_mktsegment").alias("category")).orderBy(F.desc("n_orders"), "c_custkey").limit(100)


QUERIES, ORACLES = registry.queries, registry.oracles
