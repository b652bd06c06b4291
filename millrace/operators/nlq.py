"""Questions in plain language: domain, intent, slots and the graph template they select. All are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionaries import any_of

#: Words of domains, intents and slots; slots that intents need; templates.
RESTAURANT_WORDS = ("맛집", "식당", "중국집", "카페", "밥집", "메뉴", "음식", "회식", "혼밥", "배달", "가격", "강남", "홍대")
NEWS_WORDS = ("뉴스", "기사", "GPT", "AI", "클라우드", "보안", "업데이트", "투자", "규제", "삼성", "애플", "OpenAI", "Microsoft", "Google")
EXCLUSION_WORDS = ("싫어", "싫은", "말고", "제외", "빼줘", "안 들어간", "피하고 싶어")
PRICE_WORDS = ("1만원", "2만원", "저렴한", "가격", "가성비")
COMPARISON_WORDS = ("비교", "vs", "경쟁", "차이")
EVENT_WORDS = ("업데이트", "사고", "규제", "투자", "출시")
DISLIKE_WORDS = ("싫", "말고", "제외", "빼줘")
#: (label, value, words of which one must stand, dislike needed, negative)
SLOTS = (
    ("Menu", "중국음식", ("중국집", "중국음식"), False, False),
    ("Menu", "카페", ("카페",), False, False),
    ("Ingredient", "면", ("면",), True, True),
    ("Tag", "조용한", ("조용한",), False, False),
    ("Tag", "시끄러운", ("시끄러운",), True, True),
    ("Technology", "gpt", ("GPT",), False, False),
    ("Event", "업데이트", ("업데이트",), False, False),
    ("Concept", "판교", ("판교",), False, False),
)
REQUIRED = {"restaurant_exclusion_search": (("Menu", False), ("Ingredient", True)), "news_event_search": (("Technology", False), ("Event", False)), "concept_bridge_search": (("Concept", False),)}
TEMPLATES = {("restaurant", "restaurant_exclusion_search"): "restaurant_menu_exclude_ingredient", ("it_news", "news_event_search"): "news_tech_event_search"}


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text, case and all."""
    return any_of([F.contains(text, F.lit(w)) for w in words])


def domain(text: Column) -> Column:
    food, news = holds(text, RESTAURANT_WORDS), holds(text, NEWS_WORDS)
    return F.when(food & news, "mixed").when(food, "restaurant").when(news, "it_news").otherwise("unknown")


def intent(text: Column, of: Column) -> Column:
    food = F.when(holds(text, EXCLUSION_WORDS), "restaurant_exclusion_search").when(holds(text, PRICE_WORDS), "restaurant_price_filter").otherwise("restaurant_recommendation")
    news = F.when(holds(text, COMPARISON_WORDS), "news_comparison").when(holds(text, EVENT_WORDS), "news_event_search").otherwise("news_summary")
    return F.when((of == "mixed") & F.contains(text, F.lit("같이")), "concept_bridge_search").when(of == "restaurant", food).when(of == "it_news", news).otherwise("clarification_required")


def slots(text: Column) -> Column:
    """Array of (label, value, negative), in the order of SLOTS."""
    dislike = holds(text, DISLIKE_WORDS)
    each = [F.when(holds(text, words) & (dislike if needs else F.lit(True)), F.struct(F.lit(kind).alias("label"), F.lit(value).alias("value"), F.lit(negative).alias("negative"))) for kind, value, words, needs, negative in SLOTS]
    return F.array_compact(F.array(*each))


def slot_value(found: Column, kind: str, negative: bool) -> Column:
    """The first slot's value of a kind; null if there is none."""
    return F.get(F.transform(F.filter(found, lambda s: (s["label"] == kind) & (s["negative"] == negative)), lambda s: s["value"]), F.lit(0))


def missing_slot(of: Column, found: Column) -> Column:
    """The first slot that the intent needs and the question lacks; null if none."""
    out = F.lit(None).cast("string")
    for name, needs in REQUIRED.items():
        lacking = F.coalesce(*[F.when(slot_value(found, kind, negative).isNull(), kind) for kind, negative in needs])
        out = F.when(of == name, lacking).otherwise(out)
    return out


def understood(questions: DataFrame, text: str) -> DataFrame:
    """questions with domain, intent, slots, status and template: clarification_required where a slot or template lacks."""
    q = questions.withColumn("domain", domain(F.col(text)))
    q = q.withColumn("intent", intent(F.col(text), F.col("domain"))).withColumn("slots", slots(F.col(text)))
    template = F.coalesce(*[F.when((F.col("domain") == d) & (F.col("intent") == i), t) for (d, i), t in TEMPLATES.items()])
    lacking = missing_slot(F.col("intent"), F.col("slots"))
    ready = lacking.isNull() & template.isNotNull()
    return q.withColumns({"missing": lacking, "template": F.when(ready, template), "status": F.when(ready, "validated").otherwise("clarification_required")})
