"""Keywords by their morphemes: costs of a dictionary, signals, groups with the merge guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import word_tokenizer
from ..operators import grouping, keywords, morphology
from .base import Registry, table

registry = Registry()
query = registry.query

#: A small dictionary of forms and tags, and the parts of the keywords that orders are given.
FORMS = (
    ("음식", "NNG"), ("서비스", "NNG"), ("가격", "NNG"), ("분위기", "NNG"), ("방문", "NNG"), ("의사", "NNG"), ("맛", "NNG"), ("최고", "NNG"), ("재", "XPN"),
    ("친절", "NNG"), ("친절", "XR"), ("만족", "XR"), ("맛있", "VA"), ("좋", "VA"), ("가", "VV"), ("있", "VV"), ("자주", "MAG"), ("하", "XSA"), ("하", "XSV"),
    ("이", "VCP"), ("이", "JKS"), ("가", "JKS"), ("도", "JX"), ("다", "EF"), ("고", "EC"),
)
SUBJECTS, PREDICATES = ("음식이", "서비스가", "가격도", "분위기가", "재방문 의사", "자주"), ("맛있다", "친절하다", "좋다", "최고이다", "있다", "만족하다", "가고 좋다")
CHOSEN = lambda names, at: "CASE " + " ".join(f"WHEN {at} = {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
PHRASE = f"{CHOSEN(SUBJECTS, f'o_custkey % {len(SUBJECTS)}')} || ' ' || {CHOSEN(PREDICATES, f'o_orderkey % {len(PREDICATES)}')}"
FORM_ROWS = ", ".join(f"('{f}', '{t}')" for f, t in FORMS)


def dictionary(spark):
    return spark.sql(f"SELECT * FROM VALUES {FORM_ROWS} AS t(form, tag)")


def costs(spark, sf_dir):
    return morphology.dictionary_costs(dictionary(spark), table(spark, sf_dir, "orders").select(F.expr(PHRASE).alias("text")))


@query(f"""
WITH f(form, tag) AS (VALUES {FORM_ROWS}), w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split({PHRASE}, ' ')) AS word FROM orders) GROUP BY 1),
d AS (SELECT form, count(*) AS tags FROM f GROUP BY 1),
c AS (SELECT form, tags, coalesce((SELECT sum(n * len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, length(d.form)) = d.form))) FROM w), 0) AS n FROM d)
SELECT form, tag, round(ln(tags) - ln((n + 1) / (SELECT sum(n + 1) FROM c)), 6) AS cost FROM f JOIN c USING (form)""")
def morpheme_costs(spark, sf_dir):
    """What each form of a dictionary costs in the keywords' lattice."""
    return costs(spark, sf_dir).select("form", "tag", F.round("cost", 6).alias("cost"))


@query()
def keyword_signals(spark, sf_dir):
    """The predicates, actions, nouns and topics of each order's keyword."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(PHRASE).alias("keyword"))
    found = rows.select("o_orderkey", "keyword", morphology.signals_of(costs(spark, sf_dir))(F.col("keyword")).alias("s"))
    return found.select("o_orderkey", "keyword", *[F.array_join(f"s.{k}", ",").alias(k) for k in ("predicates", "actions", "nouns", "topics")])


@query()
def guarded_groups(spark, sf_dir):
    """Each status's keywords in groups, where containment joins only what the guard lets merge."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.expr(PHRASE).alias("keyword"), "o_totalprice")
    counts = rows.groupBy("o_orderstatus", "keyword").agg(F.count("*").alias("batch_count"), F.round(F.sum("o_totalprice")).alias("score_sum"))
    signals = morphology.signals_of(costs(spark, sf_dir))
    return grouping.group_keywords(counts, "o_orderstatus", {}, word_tokenizer, signals=signals)


TAG = "CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'SN' WHEN regexp_matches(x, '^[A-Z]') THEN 'NNP' WHEN length(x) <= 3 THEN 'SL' ELSE 'NNG' END"
PAIR_LIST = ", ".join(f"'{a} {b}'" for a, b in keywords.PHRASE_TAGS)


@query(f"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: x <> '' AND x NOT IN ('and', 'the')) AS w FROM conversations),
t AS (SELECT conv_id, turn, w, list_transform(w, lambda x: {TAG}) AS g FROM w),
p AS (SELECT conv_id, turn, unnest(list_concat(w, list_concat(
  list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN g[i] || ' ' || g[i + 1] IN ({PAIR_LIST}) THEN w[i] || ' ' || w[i + 1] END), lambda p: p IS NOT NULL AND length(p) <= {keywords.MOST_PHRASE}),
  list_filter(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), lambda p: length(p) <= {keywords.MOST_PHRASE})))) AS phrase FROM t)
SELECT phrase, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM p GROUP BY 1""")
def tagged_phrases(spark, sf_dir):
    """Candidate phrases of conversations: words, pairs of tags that may stand together, runs of three."""
    words = F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda x: x != "")
    tag = lambda x: F.when(x.rlike("^[0-9]+$"), "SN").when(x.rlike("^[A-Z]"), "NNP").when(F.length(x) <= 3, "SL").otherwise("NNG")
    tokens = table(spark, sf_dir, "conversations").select("conv_id", F.transform(words, lambda x: F.struct(x.alias("form"), tag(x).alias("tag"))).alias("tokens"))
    phrases = tokens.select("conv_id", F.explode(keywords.tagged_phrases(F.col("tokens"), ("and", "the"))).alias("phrase"))
    return phrases.groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


QUERIES, ORACLES = registry.queries, registry.oracles
