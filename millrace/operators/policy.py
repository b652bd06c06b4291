"""Failures: rules from reason to action, the retry limit, queues by day, and gates with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as S

MOST_RETRIES = 5
#: Action of each reason; reasons that end in DROP when retries run out.
RULES = {
    "NETWORK_ERROR": "RETRY", "TIMEOUT": "RETRY", "PROXY_ERROR": "RETRY", "SELECTOR_MISMATCH": "REPROCESS", "BOT_DETECTED": "RETRY",
    "INVALID_URL": "DROP", "NOT_RESTAURANT_ENTITY": "DROP", "NOT_FOUND": "DROP", "CONFLICTING_DEDUP_SIGNALS": "WARN",
    "UNDEFINED_CODE_DETECTED": "REPROCESS", "REFERENCE_INTEGRITY_VIOLATION": "REPROCESS", "DB_CONSTRAINT_VIOLATION": "WARN",
    "INVALID_DATA_FORMAT": "WARN", "AMBIGUOUS_MENU_NAME": "WARN", "LOW_CONFIDENCE_MENU_NORMALIZATION": "WARN",
    "REVIEW_CANDIDATE_MENU_NORMALIZATION": "WARN", "RECIPE_SEARCH_EMPTY": "WARN", "RECIPE_SELECTOR_MISMATCH": "REPROCESS",
    "INGREDIENT_PARSE_FAILED": "REPROCESS", "INGREDIENT_NORMALIZATION_FAILED": "REPROCESS", "KAG_GRAPH_BUILD_FAILED": "REPROCESS",
}
LAST_DROP = ("NETWORK_ERROR", "TIMEOUT", "PROXY_ERROR", "BOT_DETECTED")
#: Fixed values of the quality gate.
BANNED = ("[장소 이름]", "[여기에 식당 이름]", "[참고]", "**[참고]**", "여기에", "xxxxx")
CLICHES = ("좋은 시간을 보냈", "만족스러웠", "만족스러운", "기분 좋게", "다음에 또", "다시 찾고 싶은", "추천하고 싶은", "한 번쯤", "잘 어울렸", "인상적이었", "기억에 남", "매력적이었")
LEAST_CHARS, LEAST_SENTENCES, SENTENCE_CHARS, MOST_CLICHES, REPEATED = 180, 3, 8, 4, 2


def rules(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])).alias("reason_code", "base_action"))


def action(reason: Column, retries: Column, most: int = MOST_RETRIES) -> Column:
    """The action of a reason: WARN where no rule has it; a RETRY past the limit is DROP or WARN."""
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), reason), F.lit("WARN"))
    spent = (base == "RETRY") & (F.coalesce(retries, F.lit(0)) >= most)
    return F.when(spent, F.when(reason.isin(*LAST_DROP), "DROP").otherwise("WARN")).otherwise(base)


def queue_day(act: Column, today: Column) -> Column:
    """Retries go to the next day's queue, everything else to today's."""
    return F.when(act == "RETRY", F.date_add(today, 1)).otherwise(today)


def malformed(title: Column, content: Column, required: list[Column]) -> Column:
    """Reason why an article can't be used, or null."""
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.coalesce(F.trim(c.cast("string")), F.lit("")) == "")
    empty = lambda c: F.coalesce(S.strip_all(c), F.lit("")) == ""
    return F.when(missing, "MISSING_REQUIRED_FIELD").when(empty(title), "EMPTY_TITLE").when(empty(content), "EMPTY_CONTENT")


def quality_issue(post: Column, *, banned=BANNED, cliches=CLICHES) -> Column:
    """The first reason against a generated text: banned words, repeated or too many clichés, too short; else null."""
    flat = F.regexp_replace(post, r"\s+", " ")

    def times(text: Column) -> Column:
        """How often each phrase stands in the text, by what the text loses with it."""
        return F.array(*[F.when(F.contains(text, F.lit(c)), ((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / len(c)).cast("int")).otherwise(0) for c in cliches])

    # the text and the counts are bound once a row; few texts hold any phrase at all
    counts = F.get(F.transform(F.array(flat), times), 0)
    many = F.size(F.filter(counts, lambda t: t > 0))
    repeated = F.size(F.filter(counts, lambda t: t >= REPEATED))
    bad = sum((F.when(F.contains(post, F.lit(b)), 1).otherwise(0) for b in banned), F.lit(0))
    seen = S.visible(post)
    short = (F.length(seen) < LEAST_CHARS) | (F.size(S.sentences(seen, SENTENCE_CHARS)) < LEAST_SENTENCES)
    return F.when(bad > 0, "BANNED_TOKEN").when(repeated > 0, "REPEATED_CLICHE").when(many >= MOST_CLICHES, "TOO_MANY_CLICHES").when(short, "TOO_SHORT")
