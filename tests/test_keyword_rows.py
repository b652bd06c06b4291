"""Windows and postings counted in their row, and joins that shuffle rare keys alone."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import keywords as K
from millrace.operators import relational as R


def test_windows_are_summed_up_in_their_row(spark):
    given = spark.createDataFrame([(1, "b a c a".split()), (2, ["x", "y"]), (3, ["x"]), (4, None)], "k int, w array<string>")
    made = sorted(tuple(r) for r in given.select("k", F.inline(K.window_summary(F.col("w")))).collect())
    assert made == [(1, 2, 3, "c a", 2), (1, 3, 2, "b a c", 1), (2, 2, 1, "x y", 0)]


def test_postings_count_in_the_row_and_merge_documents_of_many_rows(spark):
    texts = [(1, "b a b", "a"), (2, "c", "x"), (1, "b d", "d"), (None, "e", ""), (None, "e f", "f"), (4, None, None)]
    rows = spark.createDataFrame(texts, "k int, t string, title string")
    made = K.postings(rows, "k", F.split("t", " "), F.col("title")).select("k", F.inline("terms"))
    wanted: Counter = Counter()
    titled = {}
    for k, t, title in texts:
        for w in (t or "").split():
            wanted[k, w] += 1
            titled[k, w] = max(titled.get((k, w), 0), int(w in title))
    assert {(r["k"], r["term"]): (r["tf"], r["in_title"]) for r in made.collect()} == {x: (n, titled[x]) for x, n in wanted.items()}


def test_common_keys_are_broadcast_until_there_are_too_many(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.col("id") % 20).otherwise(F.col("id")).alias("k"), "id").checkpoint()
    table = rows.groupBy("k").agg(F.count("*").alias("n")).checkpoint()
    made = R.hot_join(rows, table, ["k"], "n", small=10, common=30)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "(n#" in plan and ">= 64)" in plan  # the 20 keys of 100 rows, not the 1,000 of one
    assert made.count() == 3000 and made.agg(F.sum("n")).first()[0] == 2000 * 100 + 1000


def test_chunks_of_a_few_texts_at_a_time(spark):
    from millrace.functions import python as P

    texts = [(k, t) for k, t in enumerate([None, "", "short", "word " * 300, "x" * 500, "one\n\ntwo " * 60])]
    rows = spark.createDataFrame(texts, "k long, t string").coalesce(1)
    made = sorted(tuple(r) for r in P.recursive_chunks(rows, "k", "t", texts=2).collect())
    assert made == [(k, n, p) for k, t in texts if t is not None for n, p in enumerate(P.split_recursively(t))]


def test_phrases_of_texts_and_no_table_of_a_whole_task(spark):
    pick = random.Random(4)
    text = lambda: "".join(pick.choices([*"abbé\u00a0", " ", "\t", "\n", "\r", "\x0b", "\f"], k=pick.randrange(25)))
    texts = [text() for _ in range(300)] + [None, "", " ", "a b " * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    for width, at_once in ((1, 64), (2, 1 << 24), (2, 64), (3, 1), (4, 1 << 24)):
        wanted: Counter = Counter()
        for t in texts:
            w = [x for x in re.split("[ \t\n\x0b\f\r]+", t or "") if x]
            wanted.update(" ".join(w[k : k + width]) for k in range(len(w) - width + 1))
        made = K.phrase_counts(rows, F.col("t"), width, at_once=at_once)
        assert {r["phrase"]: r["n"] for r in made.collect()} == wanted
    plan = K.phrase_counts(rows, F.col("t"), 2)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange hashpartitioning(phrase") < plan.index("MapInArrow")  # from the last step to the first
    assert "HashAggregate" not in plan[plan.index("Exchange") :]
