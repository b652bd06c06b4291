"""Dictionaries matched against texts: companies, news terms, action signals, menus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alias_index import matcher

#: Companies (name, type, aliases) in the order in which matches are listed.
COMPANIES = (
    ("OpenAI", "ai_company", ("openai", "chatgpt 개발사")),
    ("Anthropic", "ai_company", ("anthropic", "claude 개발사")),
    ("Google", "bigtech", ("google", "구글", "alphabet")),
    ("Microsoft", "bigtech", ("microsoft", "ms", "마이크로소프트")),
    ("Apple", "bigtech", ("apple", "애플")),
    ("NVIDIA", "semiconductor", ("nvidia", "엔비디아")),
    ("Samsung", "semiconductor", ("samsung", "삼성", "삼성전자")),
)
#: Terms of news by kind, with their aliases.
TERMS = {
    "technology": {"gpt": ("gpt", "chatgpt"), "llm": ("llm", "large language model", "large-language-model"), "pytorch": ("pytorch", "torch"), "kubernetes": ("kubernetes", "k8s"), "react": ("react", "reactjs"), "typescript": ("typescript", "ts")},
    "company": {"openai": ("openai",), "microsoft": ("microsoft",), "google": ("google",), "apple": ("apple",), "nvidia": ("nvidia",), "anthropic": ("anthropic", "claude")},
    "event": {"update": ("update", "updated", "업데이트"), "release": ("release", "released", "launch", "launched", "출시", "공개"), "investment": ("investment", "invest", "funding", "투자"), "security_incident": ("breach", "incident", "attack", "보안사고", "침해"), "regulation": ("regulation", "regulatory", "policy", "규제"), "acquisition": ("acquisition", "acquire", "merger", "인수", "합병")},
    "topic": {"ai": ("ai", "artificial intelligence", "인공지능"), "cloud": ("cloud", "클라우드"), "security": ("security", "보안"), "open_source": ("open source", "open-source", "opensource", "오픈소스"), "developer_tool": ("developer tool", "devtool", "개발도구", "개발 도구")},
}
#: Signals of action.
SIGNALS = {"RELEASE": ("출시", "배포", "릴리즈"), "ANNOUNCEMENT": ("공개", "발표"), "BUSINESS_DEAL": ("인수", "합병", "제휴"), "INVESTMENT": ("투자",), "SECURITY_RISK": ("해킹", "유출", "취약점")}
#: Words that menu names lose, the words that make a menu, thresholds of its state.
MENU_NOISE = ("매콤", "직화", "수제", "프리미엄", "시그니처", "대표", "인기", "best", "BEST", "정식", "세트", "한상", "1인", "2인", "런치", "디너", "곱빼기", "대", "중", "소")
MENU_RULES = ((("제육",), "제육볶음"), (("김치", "찌개"), "김치찌개"), (("된장", "찌개"), "된장찌개"), (("크림", "파스타"), "크림파스타"), (("불고기", "덮밥"), "불고기덮밥"))
NORMALIZED_FROM, REVIEW_FROM = 0.88, 0.70


def listed(flags: list[tuple[str, Column]]) -> Column:
    """The names whose flag is true, in the order given."""
    return F.filter(F.array(*[F.when(flag, name) for name, flag in flags]), lambda x: x.isNotNull())


def any_of(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def companies(text: Column, table=COMPANIES) -> Column:
    """Names of the companies that the text mentions, in the order of the table."""
    return matcher([(name, aliases) for name, _, aliases in table])(text)


def tags_of(names: Column, table=COMPANIES) -> Column:
    """#name#type of each of companies(); empty without one."""
    kinds = F.create_map(*[F.lit(x) for name, kind, _ in table for x in (name, f"#{name}#{kind}")])
    return F.array_join(F.transform(names, lambda n: F.element_at(kinds, n)), "")


def company_tags(text: Column, table=COMPANIES) -> Column:
    return tags_of(companies(text, table), table)


def all_terms(text: Column) -> Column:
    """kind:code of the news terms of all kinds that the text has."""
    return matcher([(f"{kind}:{code}", aliases) for kind, codes in TERMS.items() for code, aliases in codes.items()])(text)


def of_kind(found: Column, kind: str) -> Column:
    """The codes of a kind in all_terms()."""
    return F.transform(F.filter(found, lambda x: F.startswith(x, F.lit(f"{kind}:"))), lambda x: F.substring(x, len(kind) + 2, 1000))


def terms(text: Column, kind: str) -> Column:
    """Codes of the news terms of a kind that the text has."""
    return of_kind(all_terms(text), kind)


def signals(text: Column) -> Column:
    """type:word of every signal in the text, case and all."""
    return listed([(f"{kind}:{word}", F.contains(text, F.lit(word))) for kind, words in SIGNALS.items() for word in words])


def menu_name(c: Column) -> Column:
    """A menu's name without noise words (one after the other), digits and punctuation."""
    for word in MENU_NOISE:
        c = F.replace(c, F.lit(word), F.lit(" "))
    c = F.regexp_replace(F.regexp_replace(c, r"[0-9]+", " "), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def menu_rule(name: Column) -> Column:
    """The canonical menu of the first rule whose words all stand in the name, spaces aside; else null."""
    bare = F.replace(name, F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    for words, canonical in reversed(MENU_RULES):
        held = F.lit(True)
        for w in words:
            held = held & F.contains(bare, F.lit(w))
        out = F.when(held, canonical).otherwise(out)
    return out


def menu_state(confidence: Column) -> Column:
    return F.when(confidence >= NORMALIZED_FROM, "NORMALIZED").when(confidence >= REVIEW_FROM, "REVIEW_CANDIDATE").otherwise("LOW_CONFIDENCE")
