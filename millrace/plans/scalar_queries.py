"""Functions of text, time and numbers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions import text as S
from ..operators import dictionaries as D
from ..operators import policy
from .base import Registry, table

registry = Registry()
query = registry.query


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(text || chr(8203) || chr(160) || chr(10) || chr(10) || '  x', '[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(160), ' '), '\n+', chr(10), 'g'), '[ \t]+', ' ', 'g') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    given = F.concat("text", F.lit("​ \n\n  x"))
    return docs(spark, sf_dir).select("doc_id", S.clean(given).alias("cleaned"))


@query("""
WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS u,
  replace(replace(replace(replace(replace(repeat(url || ' <"title"> ', 12), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t0 FROM pages),
f AS (SELECT page_id, '<a href="' || u || '">' AS head, regexp_replace(t0, '\\s+$', '') AS t FROM e),
r AS (SELECT page_id, head, t, 500 - length(head) - 4 AS room FROM f)
SELECT page_id, head || CASE WHEN length(t) <= room THEN t ELSE left(t, room - 1) || '…' END || '</a>' AS link FROM r""")
def anchor_html(spark, sf_dir):
    title = F.expr("repeat(concat(url, ' <\"title\"> '), 12)")
    return table(spark, sf_dir, "pages").select("page_id", S.anchor(F.col("url"), title).alias("link"))


@query(r"""SELECT doc_id, CASE WHEN len(w) > 0 THEN '#' || array_to_string(w, '#') ELSE '' END AS tags, len(w) AS n FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '')[1:15] AS w FROM documents)""")
def hashtags_roundtrip(spark, sf_dir):
    words = F.slice(F.array_remove(F.split(F.regexp_replace("text", r"\s+", " "), " "), ""), 1, 15)
    made = docs(spark, sf_dir).select("doc_id", S.hashtags(words).alias("tags"))
    return made.select("doc_id", "tags", F.size(S.parse_hashtags(F.col("tags"))).cast("long").alias("n"))


@query("""SELECT event_id, props FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN 'N/A' WHEN 2 THEN '  ' WHEN 3 THEN ' - ' ELSE props END AS props FROM events)
WHERE props NOT IN ('', '-', 'N/A') AND regexp_replace(props, '\\s', '', 'g') <> ''""")
def placeholder_filter(spark, sf_dir):
    odd = F.when(F.col("event_id") % 5 == 0, "-").when(F.col("event_id") % 5 == 1, "N/A").when(F.col("event_id") % 5 == 2, "  ").when(F.col("event_id") % 5 == 3, " - ").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", odd.alias("props"))
    return rows.filter(F.col("props").isNotNull() & ~F.col("props").isin("", "-", "N/A") & (F.regexp_replace("props", r"\s", "") != ""))


MENTIONS = "CASE doc_id % 9 WHEN 0 THEN 'OpenAI and NVIDIA: ' WHEN 1 THEN 'ms. ' WHEN 2 THEN 'items, 삼성전자 ' WHEN 3 THEN 'GPT-5 update by 구글, k8s cloud ' WHEN 4 THEN 'pineapple reactjs attack ' ELSE '' END || text"


def mentions():
    return F.expr(MENTIONS)


def sql_flag(alias: str, text: str = "t") -> str:
    if alias.isascii():
        return f"regexp_matches(lower({text}), '(^|[^a-z0-9]){alias}([^a-z0-9]|$)')"
    return f"contains(lower({text}), '{alias}')"


def sql_names(entries) -> str:
    items = ", ".join(f"CASE WHEN {' OR '.join(sql_flag(a) for a in aliases)} THEN '{name}' END" for name, aliases in entries)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {sql_names([(n, a) for n, _, a in D.COMPANIES])} AS companies, replace({sql_names([(f'#{n}#{k}', a) for n, k, a in D.COMPANIES])}, ',', '') AS tags FROM (SELECT doc_id, {MENTIONS} AS t FROM documents)")
def company_match(spark, sf_dir):
    text = docs(spark, sf_dir).select("doc_id", mentions().alias("t"))
    named = text.select("doc_id", D.companies(F.col("t")).alias("names"))
    return named.select("doc_id", F.array_join("names", ",").alias("companies"), D.tags_of(F.col("names")).alias("tags"))


@query("SELECT doc_id, " + ", ".join(f"{sql_names(list(t.items()))} AS {k}" for k, t in D.TERMS.items()) + f" FROM (SELECT doc_id, {MENTIONS} AS t FROM documents)")
def term_match(spark, sf_dir):
    text = docs(spark, sf_dir).select("doc_id", mentions().alias("t"))
    found = text.select("doc_id", D.all_terms(F.col("t")).alias("found"))
    return found.select("doc_id", *[F.array_join(D.of_kind(F.col("found"), k), ",").alias(k) for k in D.TERMS])


@query("SELECT o_orderkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{k}:{w}' END" for k, ws in D.SIGNALS.items() for w in ws) + "], lambda x: x IS NOT NULL), ',') AS signals FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '신제품 출시 발표' WHEN 1 THEN '해킹 유출 사고' WHEN 2 THEN '투자 및 인수' ELSE o_orderpriority END AS t FROM orders)")
def action_signals(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 4 == 0, "신제품 출시 발표").when(F.col("o_orderkey") % 4 == 1, "해킹 유출 사고").when(F.col("o_orderkey") % 4 == 2, "투자 및 인수").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.signals(text), ",").alias("signals"))


MENU = "CASE p_partkey % 6 WHEN 0 THEN '매콤 직화 제육 정식 2인' WHEN 1 THEN '수제 김치 찌개(소)' WHEN 2 THEN 'BEST 크림 파스타!' WHEN 3 THEN '불고기덮밥 곱빼기' ELSE p_name || ' 12' END"


def sql_menu(text: str) -> str:
    for word in D.MENU_NOISE:
        text = f"replace({text}, '{word}', ' ')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({text}, '[0-9]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, name, CASE " + " ".join("WHEN " + " AND ".join(f"contains(replace(name, ' ', ''), '{w}')" for w in ws) + f" THEN '{c}'" for ws, c in D.MENU_RULES) + f" END AS canonical FROM (SELECT p_partkey, {sql_menu(MENU)} AS name FROM part)")
def menu_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", D.menu_name(F.expr(MENU)).alias("name"))
    return rows.select("p_partkey", "name", D.menu_rule(F.col("name")).alias("canonical"))


@query(r"SELECT c_custkey, coalesce(try_cast(regexp_replace(CASE WHEN c_custkey % 10 = 0 THEN 'free' ELSE c_name || ' won' END, '[^0-9]', '', 'g') AS INTEGER), 0) AS price FROM customer")
def price_digits(spark, sf_dir):
    given = F.when(F.col("c_custkey") % 10 == 0, "free").otherwise(F.concat("c_name", F.lit(" won")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.digits_to_int(given).alias("price"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN 'http://x/' || c_custkey ELSE ' ' END), ''),
  CASE WHEN c_custkey % 3 = 1 THEN replace(c_name, ' ', '') || '|' || replace(c_mktsegment, ' ', '') END, CAST(c_custkey AS VARCHAR)) AS dedup_key FROM customer""")
def dedup_key(spark, sf_dir):
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("http://x/"), "c_custkey")).otherwise(" ")
    name = F.when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.dedup_key(url, name, F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("dedup_key"))


@query(r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300) AS summary FROM documents")
def summary300(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.summary(F.col("text")).alias("summary"))


@query(r"""
WITH v AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '기억에 남 다음에 또 기억에 남 ' WHEN 1 THEN '여기에 ' WHEN 2 THEN '한 번쯤 잘 어울렸 기분 좋게 만족스러운 ' ELSE '' END || text AS post FROM documents),
f AS (SELECT *, regexp_replace(post, '\s+', ' ', 'g') AS flat, trim(regexp_replace(regexp_replace(regexp_replace(post, '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS seen FROM v)
SELECT doc_id, CASE WHEN contains(post, '여기에') THEN 'BANNED_TOKEN' WHEN contains(flat, '기억에 남 다음에 또 기억에 남') THEN 'REPEATED_CLICHE'
  WHEN contains(flat, '한 번쯤 잘 어울렸 기분 좋게 만족스러운') THEN 'TOO_MANY_CLICHES'
  WHEN length(seen) < 180 OR len(list_filter(regexp_split_to_array(seen, '[.!?。！？]+|\n+'), lambda s: length(trim(s)) >= 8)) < 3 THEN 'TOO_SHORT' END AS issue FROM f""")
def quality_gate(spark, sf_dir):
    post = F.expr("CASE doc_id % 7 WHEN 0 THEN '기억에 남 다음에 또 기억에 남 ' WHEN 1 THEN '여기에 ' WHEN 2 THEN '한 번쯤 잘 어울렸 기분 좋게 만족스러운 ' ELSE '' END || text")
    return docs(spark, sf_dir).select("doc_id", policy.quality_issue(post).alias("issue"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS seen FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.visible(F.col("html")).alias("seen"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query(r"SELECT page_id, 'web_' || coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1)) AS thread FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.thread_id(F.replace(F.col("url"), F.lit("page="), F.lit("id=")), F.lit("web")).alias("thread"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN now - INTERVAL 3 HOUR WHEN 1 THEN now WHEN 2 THEN now - to_days(CAST(30 * (event_id % 11) AS INTEGER)) WHEN 3 THEN now - INTERVAL 14 DAY WHEN 4 THEN now - to_seconds(event_id) END AS at
FROM events, (SELECT TIMESTAMP '2026-05-20 12:00:00' AS now)""")
def rel_time(spark, sf_dir):
    said = F.expr("CASE event_id % 6 WHEN 0 THEN '3 points by user 3시간전 | 댓글 1개' WHEN 1 THEN '방금' WHEN 2 THEN concat(event_id % 11, '개월 전') WHEN 3 THEN '2주전' WHEN 4 THEN concat(event_id, '초전') ELSE '알수없음' END")
    return table(spark, sf_dir, "events").select("event_id", dates.relative_time(said, F.expr("TIMESTAMP_NTZ '2026-05-20 12:00:00'")).alias("at"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate END AS at FROM orders""")
def try_ts(spark, sf_dir):
    said = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'yesterday' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.any_format(said, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '1970-01-01T00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders")
def iso_or_epoch(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_or_epoch(said).alias("iso"))


@query("SELECT c_custkey, CAST('0x' || left(sha256(c_name), 8) AS BIGINT) % 7 AS pick FROM customer")
def stable_pick(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_pick(F.col("c_name"), 7).alias("pick"))


@query("""SELECT o_orderkey, nullif(o_custkey % 5, 0) AS map_id, CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_totalprice END AS point,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS INTEGER) END, 0) AS n FROM orders""")
def null_numeric(spark, sf_dir):
    said = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' ELSE string(o_totalprice) END")
    count = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN string(o_orderkey) ELSE 'x' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.null_if_zero(F.col("o_custkey") % 5).alias("map_id"), numbers.finite(said).alias("point"), numbers.int_or_zero(count).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'positive' ELSE 'negative' END AS label,
  round(1.0 / (1.0 + exp(-abs(o_totalprice - 250000) / 100000)), 6) AS score FROM orders""")
def softmax_label(spark, sf_dir):
    label, score = numbers.softmax_label((F.col("o_totalprice") - 250000) / 100000, F.lit(0.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), F.round(score, 6).alias("score"))


@query("""SELECT c_custkey, trim(string_split(CASE c_custkey % 3 WHEN 0 THEN '10.0.0.' || c_custkey || ', 1.1.1.1' WHEN 1 THEN ' 10.1.1.1 ' ELSE '9.9.9.9' END, ',')[1]) AS ip FROM customer""")
def client_ip(spark, sf_dir):
    forwarded = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('10.0.0.', c_custkey, ', 1.1.1.1') WHEN 1 THEN ' 10.1.1.1 ' END")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.trim(F.split(forwarded, ",")[0]), F.lit("9.9.9.9")).alias("ip"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'EMPTY_TITLE' WHEN 1 THEN 'EMPTY_CONTENT' WHEN 2 THEN 'MISSING_REQUIRED_FIELD' END AS reason_code FROM documents""")
def malformed_rows(spark, sf_dir):
    title, content = F.when(F.col("doc_id") % 4 == 0, " \t ").otherwise("t"), F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("text"))
    required = F.when(F.col("doc_id") % 4 != 2, F.col("source"))
    return docs(spark, sf_dir).select("doc_id", policy.malformed(title, content, [required, F.col("lang")]).alias("reason_code"))


QUERIES, ORACLES = registry.queries, registry.oracles
