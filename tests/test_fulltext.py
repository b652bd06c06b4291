"""The stored inverted index against a count of all words of all documents."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.fulltext import TextIndex, counted, merged
from millrace.plans import graph_queries

from .compare import both

SCHEMA = "id bigint, text string"


def brute(texts, asked, limit):
    """texts: {key: list of words}."""
    counts = {k: Counter(ws) for k, ws in texts.items()}
    df = {w: sum(w in c for c in counts.values()) for w in set(asked)}
    made = {k: sum(c[w] * math.log(1 + len(texts) / df[w]) for w in sorted(set(asked)) if w in c) for k, c in counts.items() if any(w in c for w in asked)}
    return sorted(((k, round(s, 6)) for k, s in made.items()), key=lambda p: (-p[1], p[0]))[:limit]


def rows(df):
    return [(r["key"], r["score"]) for r in df.collect()]


def close(made, due):
    return [k for k, _ in made] == [k for k, _ in due] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(made, due, strict=True))


def words():
    return F.split("text", " ")


def test_query_equals_sql(spark, sf_dir):
    made, due = both(spark, sf_dir, graph_queries.fulltext_index, graph_queries.ORACLES["fulltext_index"])
    assert made == due and made


def test_random_batches_equal_a_full_count(spark, tmp_path):
    pick = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = {k: [vocabulary[min(int(pick.expovariate(0.4)), 11)] for _ in range(pick.randrange(1, 9))] for k in pick.sample(range(-300, 300), 120)}
    keys = sorted(texts)
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=4, bits=3)
    for part in (keys[:50], keys[30:90], keys[90:]):  # the second batch repeats twenty documents
        index.add(spark.createDataFrame([(k, " ".join(texts[k])) for k in part], SCHEMA), "id", words())
    again = TextIndex(spark, f"file://{tmp_path}/index")
    assert (again.buckets, again.bits) == (4, 3)
    for asked, limit in ((["w0", "w3"], 5), (["w11", "w10", "w9"], 40), (["w1", "w1", "none"], 3), (["w0", "w1", "w2"], 1000)):
        assert close(rows(again.search(asked, limit)), brute(texts, asked, limit))


def test_nulls_repeats_empty_and_unknown(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert rows(index.search(["a"], 5)) == []
    none = spark.createDataFrame([], SCHEMA)
    assert index.add(none, "id", words()) == 0
    given = [(1, "a b"), (1, "a"), (2, None), (None, "a"), (3, ""), (4, "b " * 20_000 + "a"), (5, "c")]
    docs = spark.createDataFrame(given, SCHEMA).withColumn("word", F.lit("x")).withColumn("bucket", F.lit(1))
    assert index.add(docs, "id", words()) == 5
    assert index.add(docs, "id", words()) == 0
    assert index.add(spark.createDataFrame([(1, "c c c"), (6, "c")], SCHEMA), "id", words()) == 1
    texts = {1: ["a", "b", "a"], 2: [], 3: [""], 4: ["b"] * 20_000 + ["a"], 5: ["c"], 6: ["c"]}
    for asked in (["a"], ["a", "b"], ["c"]):
        assert close(rows(index.search(asked, 5)), brute(texts, asked, 5))  # 5 and 6 tie
    assert rows(index.search(["none"], 5)) == rows(index.search([], 5)) == rows(index.search([None], 5)) == rows(index.search(["a"], 0)) == []
    with pytest.raises(ValueError):
        TextIndex(spark, f"file://{tmp_path}/other", bits=16)


def test_blocks_below_the_top_are_skipped(spark, tmp_path):
    texts = {k: ["common"] + ["rare"] * (k % 97 == 0) + ["filler"] * 3 for k in range(2000)}
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=8, bits=4)
    index.add(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], SCHEMA), "id", words())
    found, _ = index.candidates(["common", "rare"], 5)
    blocks = found.select("block").distinct().count()
    assert blocks == len({k >> 4 for k in range(0, 2000, 97)}) < index.postings(["common", "rare"]).select("block").distinct().count() == 125
    assert close(rows(index.search(["common", "rare"], 5)), brute(texts, ["common", "rare"], 5))


def test_a_question_reads_its_own_buckets(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=8)
    index.add(spark.createDataFrame([(k, f"w{k}") for k in range(200)], SCHEMA), "id", words())
    mine = spark.range(1).select(F.pmod(F.xxhash64(F.lit("w7")), F.lit(8))).first()[0]
    for file in (tmp_path / "index" / "postings").rglob("*.parquet"):
        if f"bucket={mine}" not in file.parts:
            file.write_bytes(b"unreadable")
    assert close(rows(index.search(["w7"], 5)), [(7, round(math.log(201), 6))])


def test_bounds_need_no_lists(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=8)
    index.add(spark.createDataFrame([(1, "a")], SCHEMA), "id", words())
    read = lambda df: df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "offsets" in read(index.scores(index.postings(["a"]), F.lit(1.0)))
    assert "offsets" not in read(index.bounds(index.postings(["a"]), F.lit(1.0)))


def test_neighbours_leave_their_task_as_lists(spark):
    texts = [(k, [f"w{k % 3}", "all", "all", None]) for k in range(-8, 56)] + [(3, ["all", "w9"]), (70, None), (71, [])]
    rows = spark.createDataFrame(texts, "key bigint, words array<string>").coalesce(1)
    wanted = Counter((w, k) for k, ws in texts for w in ws or () if w is not None)
    blocks = {(w, k >> 4) for w, k in wanted}
    for at_once, shares in ((1 << 21, 1), (16, 17), (1, 67)):
        made = counted(rows, 4, at_once).collect()
        assert len(made) == len(blocks) if shares == 1 else len(blocks) < len(made) <= 4 * len(texts)
        assert all([p["offset"] for p in r["postings"]] == sorted({p["offset"] for p in r["postings"]}) for r in made)
        joined = merged(counted(rows, 4, at_once), "word", "block").collect()
        assert {(r["word"], (r["block"] << 4) + p["offset"]): p["count"] for r in joined for p in r["p"]} == wanted
        assert len(joined) == len(blocks) and sum(len(r["p"]) for r in joined) == len(wanted)
