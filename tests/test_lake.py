"""Reading and writing the lake, and streams over it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.sources import lake
from millrace.streaming import ingest


@pytest.fixture()
def root(tmp_path):
    def put(path, text):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")

    head = "title,content,article_url,created_at,thread,category_cd,information_cd,view_count,comment_count,point,author,map_id,shop_cd,keywords\n"
    line = lambda thread: f'"t, ""q""",c,https://x,2026-05-20 10:00:00,{thread},CA07,,1,2,1.5,me,0,,\n'
    put("process=raw/information_cd=IC02/year=2026/month=05/day=20/status=success/geeknews_113045.csv", head + line("g_1") + line("g_2"))
    put("process=raw/information_cd=IC02/year=2026/month=05/day=21/status=success/pytorch_113045.csv", head + line("p_1"))
    put("process=raw/information_cd=IC02/year=2026/month=04/day=01/status=success/geeknews_113045.csv", head + line("g_0"))
    put("process=raw/information_cd=IC02/year=2026/month=05/day=20/status=fail/geeknews_113046.csv", head + line("bad"))
    put("process=raw/information_cd=IC02/year=abc/month=05/day=20/status=success/geeknews_113047.csv", head + line("odd"))
    put("codes.csv", "﻿cd,name,cd_info,cd_upper\nLA01, 서울 ,x,LA00\nLA02,,x,LA00\nSC01,한식,x,SC00\n")
    put("recipes.jsonl", '{"recipe_search_keyword": "k", "recipe_url": "u1", "ingredients": []}\n{"recipe_search_keyword": "k", "recipe_url": "u2", "ingredients": [{"ingredient_name": "파"}, {"ingredient_name": "파"}]}\n\n{"recipe_search_keyword": "k", "recipe_url": "u3", "ingredients": [{"ingredient_name": "무"}]}\n')
    return str(tmp_path)


def test_read_success(spark, root):
    since = lake.read_success(spark, root, "raw", since="2026-05-01")
    assert sorted(r["thread"] for r in since.collect()) == ["g_1", "g_2", "p_1"]
    one = lake.read_success(spark, root, "raw", since="2026-05-01", prefix="geeknews").filter("thread = 'g_1'").first()
    assert (one["title"], one["_page_service"]) == ('t, "q"', "geeknews")


def test_codes_and_recipes(spark, root):
    assert [tuple(r) for r in lake.read_codes(spark, f"{root}/codes.csv", "LA00").collect()] == [("LA01", "서울")]
    made = lake.recipe_ingredients(lake.read_recipes(spark, f"{root}/recipes.jsonl"), ["file", "line"])
    assert [tuple(r) for r in made.select("ingredient", "recipe_url").collect()] == [("파", "u2")]


def test_write_and_split(spark, tmp_path):
    rows = spark.createDataFrame([("a", "SC01", "candidate"), ("b", "CA02", "load"), (None, "SC02", "x")], "t string, code string, stage string")
    good, bad = lake.flagged_split(rows, lake.any_null("t"))
    assert good.count() == 2 and bad.count() == 1
    placed = rows.select("t", *lake.lake_partition(F.col("stage"), F.col("code")))
    lake.write_partitioned(placed, f"{tmp_path}/out", ["process", "category_cd"], form="json")
    lake.write_partitioned(placed, f"{tmp_path}/out", ["process", "category_cd"], form="json")
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == 6 and {r["process"] for r in back.collect()} == {"cleaning", "save", "x"}


def test_small_sources(spark, tmp_path):
    assert lake.information_of(spark.createDataFrame([("IC02",), ("IC01",), ("IC01",), ("IC02",)], "information_cd string")) == "IC01"
    assert lake.information_of(spark.createDataFrame([], "information_cd string")) == "IC02"
    assert [tuple(r) for r in lake.json_rows(spark, '[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]', "a: int, b: string").collect()] == [(1, "x"), (None, "y")]
    assert lake.bound(spark, "SELECT id FROM numbers WHERE id > :low", {"low": 7}, numbers=spark.range(10)).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "d" / "b.pdf").write_bytes(b"\xff\xfe")
    assert sorted((r["kind"], r["content"]) for r in lake.read_documents(spark, f"{tmp_path}/d").collect()) [1] == ("txt", "hello")
    seen = spark.createDataFrame([(1, "b"), (2, " "), (3, "a"), (4, "b")], "n int, c string")
    assert [r["c"] for r in lake.first_seen(seen, "c", "n").collect()] == ["b", "a"]


def test_upsert_stream_goes_on(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(k, v, dt.datetime(2026, 1, 1)) for k, v in x], "id long, v string, ts timestamp_ntz")
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows((1, "a"), (2, "b")).write.parquet(f"{folder}/x")
    schema = rows().schema

    def go():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder).select("id", "v", F.lit(1).alias("seq"))
        ingest.upsert(stream, ["id"], "seq", out, state, keep_on_null=True)
        return sorted(tuple(r) for r in ingest.newest(spark, out).select("id", "v").collect())

    assert go() == [(1, "a"), (2, "b")]
    rows((2, "c"), (3, None)).write.parquet(f"{folder}/y")
    assert go() == [(1, "a"), (2, "c"), (3, None)]


def test_database_does_the_filtering(spark, sf_dir):
    from millrace.plans import lake_queries

    one = lake_queries.database_column(spark, sf_dir)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "*GreaterThan(c" in plan and "ReadSchema: struct<c_name:string>" in plan
    assert lake_queries.database_scan(spark, sf_dir).rdd.getNumPartitions() == 4


def test_database_is_seen_by_executors_of_their_own(spark, sf_dir, tmp_path):
    import subprocess
    import sys

    script = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.executor.memory", "1g").getOrCreate()
import __spark_entry__
for name in ("database_scan", "database_column"):
    made, folder = __spark_entry__.queries()[name](spark, {sf_dir!r}), {str(tmp_path)!r}
    made.write.parquet(f"{{folder}}/{{name}}")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=300)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert sorted(spark.read.parquet(f"{tmp_path}/database_scan").collect()) == sorted(customers.collect())
    assert sorted(spark.read.parquet(f"{tmp_path}/database_column").collect()) == sorted(customers.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 1000").select("c_name").collect())


def test_database_keeps_odd_values(spark, tmp_path):
    from millrace.plans import lake_queries

    rows = [(1, None, 1, 0.1, "a"), (2, "", None, -1e-300, ""), (3, ' x, "y" ', 3, None, "line\nbreak"), (4, "a\\", 4, 1e300, '\\"'), (None, "값", 5, 1 / 3, "\t")]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(map(tuple, lake_queries.database_scan(spark, str(tmp_path)).collect()), key=str) == sorted(rows, key=str)
