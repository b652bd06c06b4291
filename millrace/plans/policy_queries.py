"""Failure policy, dispatch, questions in plain language, and the functions that need Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import python as P
from ..models import hash_scorer, word_tokenizer
from ..operators import dictionaries as D
from ..operators import grouping, keywords, nlq, policy, spans
from .base import Registry, table

registry = Registry()
query = registry.query
REASONS = (*policy.RULES, "SOMETHING_NEW")
SQL_RULES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in policy.RULES.items()) + ") AS rules(reason_code, base)"
FAILS = f"f AS (SELECT event_id, ({list(REASONS)})[CAST(event_id % {len(REASONS)} AS INTEGER) + 1] AS reason_code, CAST(floor(value) AS INTEGER) % 8 AS retries FROM events)"
ACTION = f"CASE WHEN coalesce(base, 'WARN') = 'RETRY' AND retries >= 5 THEN CASE WHEN reason_code IN {policy.LAST_DROP} THEN 'DROP' ELSE 'WARN' END ELSE coalesce(base, 'WARN') END"


def fails(spark, sf_dir):
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("event_id") % len(REASONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", reason.alias("reason_code"), (F.floor("value").cast("int") % 8).alias("retries"))
    return rows.withColumn("action", policy.action(F.col("reason_code"), F.col("retries")))


@query(f"WITH {FAILS} SELECT event_id, f.reason_code, {ACTION.replace('reason_code IN', 'f.reason_code IN')} AS action FROM f LEFT JOIN {SQL_RULES} ON f.reason_code = rules.reason_code")
def fail_classify(spark, sf_dir):
    return fails(spark, sf_dir).select("event_id", "reason_code", "action")


@query(f"""WITH {FAILS}, a AS (SELECT {ACTION.replace('reason_code IN', 'f.reason_code IN')} AS action FROM f LEFT JOIN {SQL_RULES} ON f.reason_code = rules.reason_code)
SELECT action, CASE action WHEN 'RETRY' THEN DATE '2026-05-21' ELSE DATE '2026-05-20' END AS day, count(*) AS n FROM a GROUP BY 1""")
def dispatch_partitions(spark, sf_dir):
    day = policy.queue_day(F.col("action"), F.lit("2026-05-20").cast("date"))
    return fails(spark, sf_dir).groupBy("action", day.alias("day")).agg(F.count("*").alias("n"))


#: Questions.
QUESTIONS = ("강남 중국집 추천 면은 싫어", "GPT 업데이트 뉴스", "조용한 카페 가격", "판교 맛집이랑 AI 뉴스 같이", "안녕하세요", "삼성 vs 애플 비교 기사", "시끄러운 식당 말고", "gpt")
SQL_QUESTION = f"q AS (SELECT c_custkey, ({list(QUESTIONS)})[CAST(c_custkey % {len(QUESTIONS)} AS INTEGER) + 1] AS t FROM customer)"


def sql_holds(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


DOMAIN = f"CASE WHEN {sql_holds(nlq.RESTAURANT_WORDS)} AND {sql_holds(nlq.NEWS_WORDS)} THEN 'mixed' WHEN {sql_holds(nlq.RESTAURANT_WORDS)} THEN 'restaurant' WHEN {sql_holds(nlq.NEWS_WORDS)} THEN 'it_news' ELSE 'unknown' END"
INTENT = f"""CASE WHEN domain = 'mixed' AND contains(t, '같이') THEN 'concept_bridge_search'
  WHEN domain = 'restaurant' THEN CASE WHEN {sql_holds(nlq.EXCLUSION_WORDS)} THEN 'restaurant_exclusion_search' WHEN {sql_holds(nlq.PRICE_WORDS)} THEN 'restaurant_price_filter' ELSE 'restaurant_recommendation' END
  WHEN domain = 'it_news' THEN CASE WHEN {sql_holds(nlq.COMPARISON_WORDS)} THEN 'news_comparison' WHEN {sql_holds(nlq.EVENT_WORDS)} THEN 'news_event_search' ELSE 'news_summary' END ELSE 'clarification_required' END"""


def questions(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("c_custkey") % len(QUESTIONS) + 1).cast("int"))
    return nlq.understood(table(spark, sf_dir, "customer").select("c_custkey", text.alias("t")), "t")


@query(f"WITH {SQL_QUESTION}, d AS (SELECT *, {DOMAIN} AS domain FROM q) SELECT c_custkey, domain, {INTENT} AS intent FROM d")
def nl_domain_intent(spark, sf_dir):
    return questions(spark, sf_dir).select("c_custkey", "domain", "intent")


@query(f"WITH {SQL_QUESTION} SELECT c_custkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_holds(ws)}{' AND ' + sql_holds(nlq.DISLIKE_WORDS) if needs else ''} THEN '{k}={v}{'-' if neg else ''}' END" for k, v, ws, needs, neg in nlq.SLOTS) + "], lambda x: x IS NOT NULL), ',') AS slots FROM q")
def slot_extract(spark, sf_dir):
    named = F.transform("slots", lambda s: F.concat(s["label"], F.lit("="), s["value"], F.when(s["negative"], "-").otherwise("")))
    return questions(spark, sf_dir).select("c_custkey", F.array_join(named, ",").alias("slots"))


@query(f"""WITH {SQL_QUESTION}, r(t, template) AS (VALUES ('{QUESTIONS[0]}', 'restaurant_menu_exclude_ingredient'), ('{QUESTIONS[1]}', 'news_tech_event_search'))
SELECT c_custkey, r.template, CASE WHEN r.template IS NULL THEN 'clarification_required' ELSE 'validated' END AS status FROM q LEFT JOIN r USING (t)""")
def template_select(spark, sf_dir):
    return questions(spark, sf_dir).select("c_custkey", "template", "status")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title,
  len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS links FROM pages""")
def html_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.article_page(F.col("html"))["title"].alias("title"), F.size(H.links(F.col("html"))).cast("long").alias("links"))


@query()
def menu_similarity(spark, sf_dir):
    """Distinct menu pairs are compared once; the confidence is 0.5 + 0.3 ratio + 0.2 where a rule fits."""
    name = D.menu_name(F.expr("CASE p_partkey % 5 WHEN 0 THEN '매콤 직화 제육 정식 2인' WHEN 1 THEN '김치 찌개 특' WHEN 2 THEN '시그니처 한상' ELSE p_name END"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("canonical", D.menu_rule(F.col("name")))
    bare = F.replace(F.col("name"), F.lit(" "), F.lit(""))
    pairs = rows.filter("canonical IS NOT NULL").select("name", "canonical").distinct().withColumn("ratio", P.sequence_ratio(bare, F.col("canonical")))
    both = rows.join(pairs, ["name", "canonical"], "left")
    confidence = F.round(F.when(F.col("canonical").isNull(), 0.0).otherwise(0.5 + 0.3 * F.col("ratio") + 0.2), 2)
    return both.select("p_partkey", "name", "canonical", confidence.alias("confidence"), D.menu_state(confidence).alias("status"))


@query()
def recursive_chunk(spark, sf_dir):
    return P.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


SCORE = lambda text: f"(CAST('0x' || left(sha256({text}), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"
WITH_IT = lambda text: f"CASE WHEN label = 'positive' THEN {SCORE(text)} ELSE 1 - {SCORE(text)} END"
AGAINST = lambda text: f"CASE WHEN label = 'positive' THEN 1 - {SCORE(text)} ELSE {SCORE(text)} END"
CONTRARY = f"{AGAINST('t')} > {WITH_IT('t')} AND {AGAINST('t')} >= {spans.OPPOSITE} AND ({AGAINST('t')} - {WITH_IT('t')} >= {spans.MARGIN} OR {AGAINST('t')} >= {spans.HIGH})"
APART = lambda a, b: f"({a}.start + {a}.width <= {b}.start OR {b}.start + {b}.width <= {a}.start)"


@query(rf"""
WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, text FROM documents JOIN labels USING (doc_id)),
t AS (SELECT doc_id, label, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[.。]', ' ', 'g'), '[^\s0-9A-Za-z가-힣]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
  lambda x: x <> '' AND length(x) <= 15) AS w FROM r),
n AS (SELECT doc_id, label, w, width, unnest(range(0, len(w) - width + 1)) AS start FROM t, (VALUES (2), (3)) AS v(width)),
s AS (SELECT doc_id, label, width, start, array_to_string(w[start + 1:start + width], ' ') AS span FROM n),
k AS (SELECT doc_id, label, width, start, span, {WITH_IT('span')} AS score FROM s WHERE length(span) <= {spans.MOST_CHARS} AND {WITH_IT('span')} >= {AGAINST('span')}
  AND len(list_filter(string_split(span, ' '), lambda t: regexp_matches(t, '{spans.SHAPED}') AND length(t) <= {spans.SHAPED_LENGTH} AND {CONTRARY})) = 0),
b AS (SELECT doc_id, span, min(start) AS start, any_value(width) AS width, any_value(score) AS score FROM k GROUP BY doc_id, span),
l AS (SELECT a.* FROM b a WHERE a.width = 3 OR NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = a.doc_id AND c.width = 3 AND a.start BETWEEN c.start AND c.start + 1 AND a.score <= c.score + {spans.EPS})),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, width DESC, start) AS rank FROM l),
p1 AS (SELECT * FROM o WHERE rank = 1),
p2 AS (SELECT o.doc_id, arg_min(o, o.rank) AS p FROM o JOIN p1 ON o.doc_id = p1.doc_id AND {APART('o', 'p1')} GROUP BY o.doc_id),
p3 AS (SELECT o.doc_id, arg_min(o, o.rank) AS p FROM o JOIN p1 ON o.doc_id = p1.doc_id AND {APART('o', 'p1')} JOIN p2 ON o.doc_id = p2.doc_id AND {APART('o', 'p2.p')} GROUP BY o.doc_id)
SELECT r.doc_id, coalesce('#' || p1.span, '') || coalesce('#' || p2.p.span, '') || coalesce('#' || p3.p.span, '') AS keywords
FROM r LEFT JOIN p1 ON r.doc_id = p1.doc_id LEFT JOIN p2 ON r.doc_id = p2.doc_id LEFT JOIN p3 ON r.doc_id = p3.doc_id""")
def span_keywords(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = both.select("doc_id", "text", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return spans.span_keywords(rows, "doc_id", "text", "label", hash_scorer)


@query()
def greedy_group(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality = 1")
    words = F.filter(word_tokenizer(F.col("text")), lambda w: F.length(w) > 3)
    counts = keywords.keyword_counts(both, "source", words, F.col("n_chars") / 1000.0).filter("batch_count >= 2")
    return grouping.group_keywords(counts, "source", {"that": "this", "this": "this"}, word_tokenizer)


@query("""WITH d AS (SELECT source, doc_id, -ln((CAST('0x' || left(md5('seed|' || doc_id), 8) AS BIGINT) + 1) / 4294967297.0) / greatest(n_chars, 0.01) AS draw FROM documents)
SELECT source, doc_id, draw_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) AS draw_rank FROM d) WHERE draw_rank <= 5""")
def weighted_sample(spark, sf_dir):
    return keywords.weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", F.col("doc_id"), F.col("n_chars"), 5, "seed").select("source", "doc_id", "draw_rank")


@query("SELECT c_custkey, c_name FROM customer ORDER BY CAST('0x' || left(md5('seed|' || c_custkey), 8) AS BIGINT), c_custkey LIMIT 200")
def reservoir_sample(spark, sf_dir):
    return keywords.reservoir(table(spark, sf_dir, "customer"), F.col("c_custkey"), 200, "seed").select("c_custkey", "c_name")


QUERIES, ORACLES = registry.queries, registry.oracles
