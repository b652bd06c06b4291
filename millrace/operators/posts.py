"""Generated posts: cleaning, required parts, rows and vector documents, and a bounded generation loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..schemas import INFORMATION_RESTAURANT, POST_DEFAULT, STATUS_ACTIVE
from .upserts import with_next_ids

TITLE, TAG = 100, 100
#: Hosts that stand for no real address; words of lines that aren't part of a post.
RESERVED_HOSTS = ("example.com", "example.org", "example.net", "localhost", "127.0.0.1")
RESERVED_ENDS = (".example", ".invalid", ".localhost", ".test")
META_WORDS = ("글자수", "키워드", "요구사항", "프롬프트", "작성지침")
#: Introductions that models write.
INTRODUCTIONS = (r"(?is)^\s*(?:assistant|ai|answer|final|답변|본문|게시글|출력)\s*[:：]\s*", r"(?is)^\s*(?:여기 있습니다|작성했습니다|완성했습니다|아래와 같습니다)\s*[:：]?\s*")


def without_introduction(c: Column) -> Column:
    for _ in range(3):
        for pattern in INTRODUCTIONS:
            c = F.regexp_replace(c, pattern, "")
    return S.strip_all(c)


def without_reserved_urls(c: Column) -> Column:
    hosts = "|".join(S._quoted(h) for h in RESERVED_HOSTS)
    ends = "|".join(S._quoted(e) for e in RESERVED_ENDS)
    return S.strip_all(F.regexp_replace(c, rf"""(?i)https?://(?:(?:{hosts})|[^\s/:"'<>]+(?:{ends}))(?=[/:?#\s"'<>]|$)[^\s"'<>]*""", ""))


def without_meta_lines(c: Column) -> Column:
    """Without lines that hold two or more words of META_WORDS, white space aside."""

    def kept(line):
        bare = F.regexp_replace(line, r"\s+", "")
        return sum((F.when(F.contains(bare, F.lit(w)), 1).otherwise(0) for w in META_WORDS), F.lit(0)) < 2

    return S.strip_all(F.array_join(F.filter(F.split(c, "\n"), kept), "\n"))


def cleaned(c: Column) -> Column:
    """A model's answer as a post."""
    return without_meta_lines(without_reserved_urls(without_introduction(S.without_thinking(c))))


def with_required(post: Column, image: Column, link: Column) -> Column:
    """post with the image and the link at its end, unless it has them."""
    tag = F.when(F.lower(image).startswith("<img"), image).otherwise(S.image_tag(image, F.lit("")))
    pictured = F.when(S.blank(image).isNotNull() & ~F.contains(post, image), F.concat(post, F.lit("\n\n"), tag)).otherwise(post)
    return F.when(S.blank(link).isNotNull() & ~F.contains(pictured, link), F.concat(pictured, F.lit("\n\n"), link)).otherwise(pictured)


def post_rows(results: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ids to append, rejects with reason) of results(title, post, keywords, information_cd, map_id, shop_id, crawling_id)."""
    title = F.left(S.strip_all(F.element_at(F.split(S.strip_all(F.coalesce("title", F.lit(""))), "\n"), 1)), F.lit(TITLE))
    made = results.select("*", title.alias("post_title"), S.strip_all(F.coalesce("post", F.lit(""))).alias("content"))
    restaurant = F.col("information_cd") == INFORMATION_RESTAURANT
    reason = F.when((F.col("post_title") == "") | (F.col("content") == ""), "EMPTY").when(restaurant & F.col("shop_id").isNull(), "NO_SHOP").when(~restaurant & F.col("crawling_id").isNull(), "NO_ARTICLE")
    judged = made.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(F.col("post_title").alias("title"), "content", F.left(F.array_join("keywords", "# "), F.lit(TAG)).alias("tag"), "information_cd", "map_id", "shop_id", "crawling_id", F.lit(POST_DEFAULT).alias("post_cd"), F.lit(STATUS_ACTIVE).alias("status_cd"))
    return with_next_ids(good, posts, "post_id", ["crawling_id", "shop_id", "title"]), judged.filter("reason IS NOT NULL").select("title", "reason")


def vector_documents(posts: DataFrame, rows: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """document, embedding and metadata of posts(post_id, shop_id, content, keywords), with the rows that each used."""
    used = rows.groupBy("shop_id").agg(F.sort_array(F.collect_list("crawling_id")).alias("used_crawling_ids"), F.max(F.coalesce(F.col("crawling_created_at").cast("string"), F.col("created_dt").cast("string"), F.lit(""))).alias("latest_crawling_created_at"))
    both = posts.join(used, "shop_id", "left")
    meta = F.struct("post_id", "shop_id", "used_crawling_ids", "latest_crawling_created_at", F.left(F.array_join("keywords", " #"), F.lit(TAG)).alias("tag"))
    return both.select("post_id", F.col("content").alias("document"), embed(F.col("content")).alias("embedding"), meta.alias("metadata"))


def generate(prompts: DataFrame, prompt: str, model: Callable[[Column], Column], judge: Callable[[Column], Column], again: Callable[[Column, Column], Column], *, rounds: int = 1) -> DataFrame:
    """prompts with post and issue: made, judged, and made anew at most ``rounds`` times where the judge objects."""
    out = prompts.withColumn("post", cleaned(model(F.col(prompt))))
    out = out.withColumn("issue", judge(F.col("post")))
    for _ in range(rounds):
        out = out.withColumn("post", F.when(F.col("issue").isNull(), F.col("post")).otherwise(cleaned(model(again(F.col(prompt), F.col("issue"))))))
        out = out.withColumn("issue", judge(F.col("post")))
    return out


def script_statements(c: Column) -> Column:
    """The statements of a script, cut at semicolons, blank ones dropped."""
    return F.array_remove(F.transform(F.split(c, ";"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), "")
