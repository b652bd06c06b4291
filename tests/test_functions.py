"""Column functions on single values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, html, numbers, python, vectors
from millrace.functions import text as S
from millrace.operators import dictionaries as D
from millrace.operators import policy


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("a​b", "ab"), ("x y", "x y"), ("a\n\n\nb", "a\nb"), ("a  \t  b", "a b"), (None, None), ("", "")],
)
def test_clean(spark, given, wanted):
    assert value(spark, S.clean(text(given))) == wanted


def test_anchor(spark):
    made = value(spark, S.anchor(text("https://example.com/path"), text("<제목> " * 200)))
    assert made.startswith('<a href="https://example.com/path">') and made.endswith("…</a>") and len(made) <= 500
    assert value(spark, S.anchor(text(" "), text("t"))) == "" and value(spark, S.anchor(text(None), text("t"))) == ""
    assert value(spark, S.anchor(text("u" * 600), text("t"))) == "u" * 500
    assert "&quot;" in value(spark, S.anchor(text('a"b'), text(None)))


def test_image_tag(spark):
    assert value(spark, S.image_tag(text("u"), text("a<b"))) == '<img src="u" alt="a&lt;b" />'


def test_hashtags(spark):
    assert value(spark, S.hashtags(F.array(F.lit("맛있어요"), F.lit("가성비 좋아요")))) == "#맛있어요#가성비 좋아요"
    assert value(spark, S.hashtags(F.array().cast("array<string>"))) == ""
    assert value(spark, S.parse_hashtags(text("#a# b  c ##"))) == ["a", "b c"] and value(spark, S.parse_hashtags(text(None))) == []


def test_span_text(spark):
    assert value(spark, S.span_text(text("맛있어요!!! 가격도."))) == "맛있어요 가격도"
    assert value(spark, S.span_tokens(text("맛있어요 ㅠ 또 방문"))) == ["맛있어요", "또", "방문"]


@pytest.mark.parametrize(("given", "hours"), [("3시간전", 3), ("방금", 0), ("3 points by user 6시간전 | 댓글 1개", 6), ("2일 전", 48), ("1개월전", 720), ("1년 전", 8760)])
def test_relative_time(spark, given, hours):
    now = dt.datetime(2026, 5, 20, 12)
    assert value(spark, dates.relative_time(text(given), F.lit("2026-05-20 12:00:00").cast("timestamp_ntz"))) == now - dt.timedelta(hours=hours)


@pytest.mark.parametrize("given", ["알수없음", "", None])
def test_relative_time_of_nothing(spark, given):
    assert value(spark, dates.relative_time(text(given), F.lit("2026-05-20 12:00:00").cast("timestamp_ntz"))) is None


def test_dates(spark):
    assert value(spark, dates.utc_naive(text("2026-05-20T06:30:08.822Z"))) == dt.datetime(2026, 5, 20, 6, 30, 8, 822000)
    assert value(spark, dates.utc_naive(text("x"))) is None
    assert value(spark, dates.iso_or_epoch(text(" "))) == "1970-01-01T00:00:00" and value(spark, dates.iso_or_epoch(text("2026-05-20 10:00:00"))) == "2026-05-20T10:00:00"
    assert value(spark, dates.bootstrap(F.lit("2026-05-20 12:00:00").cast("timestamp_ntz"))) == dt.datetime(2026, 2, 19)


def test_numbers(spark):
    assert value(spark, numbers.finite(text("NaN"))) is None and value(spark, numbers.finite(text("Infinity"))) is None and value(spark, numbers.finite(text("1.5"))) == 1.5
    assert value(spark, numbers.int_or_zero(text("x"))) == 0 and value(spark, numbers.null_if_zero(F.lit(0))) is None
    label, score = numbers.softmax_label(F.lit(1.0), F.lit(1.0))
    assert value(spark, label) == "positive" and value(spark, score) == 0.5
    assert 0.9 <= value(spark, numbers.hash_uniform(text("k"), low=0.9, high=1.1)) < 1.1


def test_vectors(spark):
    array = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, vectors.normalised(array(3, 4))) == [0.6, 0.8] and value(spark, vectors.normalised(array(0, 0))) == [0.0, 0.0]
    assert value(spark, vectors.cosine(array(1, 0), array(0, 1))) == 0.0 and value(spark, vectors.cosine(array(0, 0), array(1, 1))) == 0.0


def test_companies(spark):
    assert value(spark, D.companies(text("OpenAI and NVIDIA announce"))) == ["OpenAI", "NVIDIA"]
    assert value(spark, D.company_tags(text("Anthropic and OpenAI, Microsoft"))) == "#OpenAI#ai_company#Anthropic#ai_company#Microsoft#bigtech"
    assert value(spark, D.companies(text("items pineapple"))) == [] and value(spark, D.company_tags(text("nothing"))) == ""


def test_news_terms(spark):
    line = "OpenAI GPT update improves cloud security Microsoft and Kubernetes"
    assert value(spark, D.terms(text(line), "technology")) == ["gpt", "kubernetes"]
    assert value(spark, D.terms(text(line), "company")) == ["openai", "microsoft"]
    assert value(spark, D.terms(text(line), "event")) == ["update"] and value(spark, D.terms(text(line), "topic")) == ["cloud", "security"]
    assert value(spark, D.signals(text("신제품 출시"))) == ["RELEASE:출시"]


def test_menu(spark):
    assert value(spark, D.menu_rule(D.menu_name(text("매콤 직화 제육 정식 2인")))) == "제육볶음"
    assert value(spark, D.menu_rule(D.menu_name(text("시그니처 한상")))) is None
    assert value(spark, D.menu_state(F.lit(0.88))) == "NORMALIZED" and value(spark, D.menu_state(F.lit(0.5))) == "LOW_CONFIDENCE"
    assert value(spark, S.digits_to_int(text("12,000원"))) == 12000 and value(spark, S.digits_to_int(text("무료"))) == 0


def test_keys_and_answers(spark):
    assert value(spark, S.dedup_key(text(" "), text("가 나"), text("서울 1"), text("e"))) == "가나|서울1"
    assert value(spark, S.dedup_key(text(None), text(None), text("x"), text("e"))) == "e"
    assert value(spark, S.thread_id(text("https://x.io/topic?id=12#a"), text("geeknews"))) == "geeknews_12"
    assert value(spark, S.thread_id(text("https://x.io/t/name/34"), text("pytorch"))) == "pytorch_34"
    assert value(spark, S.json_block(text('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}' and value(spark, S.json_block(text("none"))) is None
    assert value(spark, S.without_thinking(text("<think>hm</think>\n결과: 좋다"))) == "좋다"
    assert value(spark, S.required_part(text("a"), text("b"))) == "a\nb" and value(spark, S.required_part(text("ab"), text("b"))) == "ab"
    assert value(spark, S.fixed_chunks(text("x" * 380), 200, 20)) == ["x" * 200, "x" * 200] and value(spark, S.fixed_chunks(text(""), 200, 20)) == [""]


@pytest.mark.parametrize(("reason", "retries", "wanted"), [("NETWORK_ERROR", 0, "RETRY"), ("TIMEOUT", 5, "DROP"), ("SELECTOR_MISMATCH", 9, "REPROCESS"), ("OTHER", 0, "WARN"), (None, 0, "WARN"), ("NOT_FOUND", None, "DROP")])
def test_policy(spark, reason, retries, wanted):
    assert value(spark, policy.action(text(reason), F.lit(retries).cast("int"))) == wanted


def test_queue_day(spark):
    today = F.lit("2026-05-20").cast("date")
    assert value(spark, policy.queue_day(F.lit("RETRY"), today)) == dt.date(2026, 5, 21) and value(spark, policy.queue_day(F.lit("DROP"), today)) == dt.date(2026, 5, 20)


def test_quality_issue(spark):
    good = "이 집은 국물이 깊고 면이 쫄깃해서 자주 찾게 되는 곳입니다. " * 8
    assert value(spark, policy.quality_issue(text(good))) is None
    assert value(spark, policy.quality_issue(text(good + "여기에"))) == "BANNED_TOKEN"
    assert value(spark, policy.quality_issue(text(good + "기억에 남 기억에 남"))) == "REPEATED_CLICHE"
    assert value(spark, policy.quality_issue(text("짧다."))) == "TOO_SHORT"


def test_pages(spark):
    page = '<title>T</title><h1>A <b>B</b></h1><script type="application/ld+json">{"name": "가게", "aggregateRating": {"ratingValue": "4.5"}}</script><a class="x" href="/u">l</a>'
    made = value(spark, html.store_page(text(page)))
    assert (made["name"], made["rating"]) == ("가게", 4.5)
    assert value(spark, html.tag_text(text(page), "h1")) == "A B" and value(spark, html.links(text(page))) == ["/u"]
    assert value(spark, html.store_page(text("")))["name"] == "Unknown"


def test_python_functions(spark):
    assert abs(value(spark, python.sequence_ratio(text("abcd"), text("bcde"))) - 0.75) < 1e-9 and value(spark, python.sequence_ratio(text(None), text("x"))) is None
    pieces = python.split_recursively("aaa bbb " * 60 + "\n\n" + "c" * 450)
    assert all(len(p) <= 200 for p in pieces) and "".join(pieces).count("c") >= 450
    assert python.split_recursively("") == [] and python.split_recursively("short") == ["short"]
