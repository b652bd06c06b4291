"""Dictionaries, components and groups: against plain forms, and at sizes where the plain forms fail."""

import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import alias_index, grouping, merging, morphology
from millrace.operators import components as C
from millrace.operators import similarity


def by_expressions(entries, text):
    low = text.lower()
    holds = lambda a: re.search(rf"(?<![a-z0-9]){re.escape(a.lower())}(?![a-z0-9])", low) if a.isascii() else a.lower() in low
    return [code for code, aliases in entries if any(holds(a) for a in aliases)]


def test_aliases_equal_regular_expressions(spark):
    rng = random.Random(1)
    alias = lambda: "".join(rng.choices(["a", "b", "ab", "1", " ", "-", "가", "나", "A"], k=rng.randint(1, 4))) or "a"
    entries = [(f"c{k}", [alias() for _ in range(rng.randint(1, 3))]) for k in range(60)]
    texts = ["".join(rng.choices(["a", "b", "B", "1", " ", "-", ".", "가", "나", "é"], k=rng.randint(0, 25))) for _ in range(800)] + [None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    made = {r["k"]: r["found"] for r in rows.select("k", alias_index.matcher(entries)(F.col("t")).alias("found")).collect()}
    assert made == {k: by_expressions(entries, t or "") for k, t in enumerate(texts)}
    assert alias_index.AliasIndex([]).find("a") == []


def test_cost_does_not_grow_with_aliases():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(6, 12)))
    text = " ".join(word() for _ in range(200_000))
    took = []
    for n in (20, 20_000):
        index = alias_index.AliasIndex([(f"c{k}", (word(), f"{word()} {word()}", f"가{word()}")) for k in range(n)])
        times = []
        for _ in range(5):
            began = time.process_time()
            index.find(text)
            times.append(time.process_time() - began)
        took.append(min(times))
    assert took[1] < 1.5 * took[0], took


def by_search(edges):
    of = defaultdict(set)
    for a, b in edges:
        if a != b:
            of[a].add(b)
            of[b].add(a)
    label = {}
    for node in sorted(of):
        if node not in label:
            label[node], todo = node, [node]
            while todo:
                for x in of[todo.pop()]:
                    if x not in label:
                        label[x] = node
                        todo.append(x)
    return label


@pytest.mark.parametrize("n", [0, 30, 3000])
def test_components_equal_a_search(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(10_000, k) for k in range(10_001, 10_001 + n)] + [(-k, -k - 1) for k in range(1, n // 30)]
    made = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == by_search(edges)


def test_components_of_a_long_path_and_of_names(spark):
    order = list(range(100_000))
    random.Random(3).shuffle(order)
    made = C.components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
    assert made.agg(F.count("*"), F.max("label")).first() == (100_000, 0)
    named = C.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x"), ("z", "y")], "a string, b string"))
    assert {tuple(r) for r in named.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}


@pytest.mark.parametrize("chunk", [7, 1000])
def test_nearest_equals_all_pairs(spark, chunk):
    rng = random.Random(4)
    rows = [(k % 4, k if k < 190 else 5, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(9, 900, [1.0] * 8), (9, 901, None), (None, 902, [1.0] * 8)]
    made = {r["key"]: r["nearest"] for r in similarity.nearest(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v", chunk=chunk).collect()}
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    wanted = defaultdict(lambda: None)
    for g, k, v in rows:
        for h, j, w in rows:
            if g is not None and g == h and k != j and v and w:
                wanted[k] = max(wanted[k] or -2, sum(a * b for a, b in zip(unit(v), unit(w))))
    assert set(made) == {k for _, k, _ in rows} and all((made[k] is None) == (wanted[k] is None) and (made[k] is None or abs(made[k] - wanted[k]) < 2e-6) for k in made)


DICTIONARY = [("맛", "NNG"), ("맛있", "VA"), ("있", "VV"), ("친절", "NNG"), ("친절", "XR"), ("하", "XSA"), ("하", "XSV"), ("하", "VV"), ("다", "EF"), ("고", "EC"), ("은", "JX"), ("은", "ETM"), ("이", "JKS"), ("이", "VCP"), ("가", "JKS"), ("음식", "NNG"), ("서비스", "NNG"), ("좋", "VA"), ("재", "XPN"), ("방문", "NNG"), ("의사", "NNG"), ("자주", "MAG"), ("가", "VV"), ("최고", "NNG"), ("음", "NNG"), ("식", "XSN")]


def lattice(spark):
    texts = spark.createDataFrame([("음식이 맛있다 서비스가 좋고 친절하다",), ("재방문 의사 있다 최고이다 자주 가다",), (None,), ("맛은 좋다 친절한",)], "text string")
    costs = morphology.dictionary_costs(spark.createDataFrame(DICTIONARY, "form string, tag string"), texts)
    return costs, morphology.Lattice(morphology.entries_of(costs))


def test_best_path_equals_enumeration(spark):
    import math

    costs, known = lattice(spark)
    counts = {f: sum(w.count(f) for w in "음식이 맛있다 서비스가 좋고 친절하다 재방문 의사 있다 최고이다 자주 가다 맛은 좋다 친절한".split()) for f, _ in DICTIONARY}
    whole = sum(n + 1 for n in counts.values())
    tags = {f: sum(g == f for g, _ in DICTIONARY) for f, _ in DICTIONARY}
    assert all(abs(r["cost"] - (math.log(tags[r["form"]]) - math.log((counts[r["form"]] + 1) / whole))) < 1e-9 for r in costs.collect())

    def paths(word, at=0, before=""):
        if at == len(word):
            yield 0.0
        else:
            for end, tag, cost in known.edges(word, at):
                for rest in paths(word, end, tag):
                    yield cost + morphology.MISPLACED * morphology.misplaced(before, tag) + rest

    rng = random.Random(6)
    for _ in range(300):
        word = "".join(rng.choices(["맛", "있", "다", "친절", "하", "음식", "이", "가", "고", "a", "1", "!", "갑"], k=rng.randint(1, 5)))
        cost, morphemes = known.word(word)
        assert abs(cost - min(paths(word))) < 1e-9 and "".join(f for f, _ in morphemes) == word
    assert known.word("갑" * 30_000)[0] > 0 and known.morphemes("") == []


def test_signals_of_keywords(spark):
    costs, known = lattice(spark)
    wanted = {
        "음식이 맛있다": (["맛있다"], [], ["음식"], ["음식"]), "서비스가 친절하다": (["친절하다"], ["친절하다"], ["서비스"], ["서비스"]),
        "재방문 의사 있다": (["재방문의사_있다"], [], ["방문", "의사"], ["방문"]), "최고이다": (["최고이다"], [], ["최고"], []),
        "자주 가다": (["가다"], ["자주가다"], [], []), "음식 서비스": (["음식서비스"], ["음식서비스"], ["음식", "서비스"], []), "": ([], [], [], []),
    }
    rows = spark.createDataFrame([(k,) for k in [*wanted, None]], "k string")
    made = {r["k"]: tuple(r["s"]) for r in rows.select("k", morphology.signals_of(costs)(F.col("k")).alias("s")).collect()}
    drop_noun = lambda s: (s[0], s[1], [n for n in s[2] if n != "친절"], s[3])
    assert {k: drop_noun(v) for k, v in made.items()} == wanted | {None: ([], [], [], [])}


def test_guard_of_sets_equals_guard_of_columns(spark):
    rng = random.Random(7)
    some = lambda: rng.sample(["ab", "abc", "b", "cd", "cde", "f"], rng.choice((0, 0, 1, 2)))
    pairs = [[[some() for _ in merging.KINDS] for _ in "ab"] for _ in range(600)]
    kind = morphology.SIGNALS
    rows = spark.createDataFrame([(k, tuple(a), tuple(b)) for k, (a, b) in enumerate(pairs)], f"k int, a {kind}, b {kind}")
    made = {r["k"]: r["fits"] for r in rows.select("k", merging.may_merge(F.col("a"), F.col("b")).alias("fits")).collect()}
    sets = lambda x: {k: set(v) for k, v in zip(merging.KINDS, x)}
    assert made == {k: merging.fits(sets(a), sets(b)) for k, (a, b) in enumerate(pairs)} and 50 < sum(made.values()) < 550


def sequential_groups(rows):
    """Each keyword against all groups in turn, without look-ups; vectors are (1, 0) or (0, 1) and so near or far."""
    groups = []
    for keyword, words, parts, canonicals, signals, kind, vector in sorted(rows, key=lambda r: r[0]):
        held = lambda g: any(len(x) >= 2 and len(y) >= 2 and x != y and (x in y or y in x) for x in parts for y in g["parts"])
        found = next((g for g in groups if canonicals & g["canonicals"]), None) or next((g for g in groups if words & g["words"]), None)
        found = found or next((g for g in groups if held(g) and merging.fits(signals, g["signals"])), None)
        if found is None:
            far = []
            for n, g in enumerate(groups):
                total = [sum(v[k] for v in g["vectors"]) for k in range(2)]
                most = grouping.NEAR if not (words and g["words"]) else grouping.NEAR_STRICT if kind == g["kind"] == "general" else -1
                distance = 1 - sum(a * b for a, b in zip(vector, total)) / sum(x * x for x in total) ** 0.5
                far += [(distance, n)] * (distance <= most)
            found = groups[min(far)[1]] if far else None
        if found is None:
            groups.append(found := {"keywords": [], "words": set(), "parts": set(), "canonicals": set(), "vectors": [], "kind": kind, "signals": {k: set() for k in merging.KINDS}})
        found["keywords"].append(keyword)
        found["vectors"].append(vector)
        found["kind"] = kind if found["kind"] == "unknown" else found["kind"]
        for name, more in (("words", words), ("parts", parts), ("canonicals", canonicals)):
            found[name] |= more
        for k in merging.KINDS:
            found["signals"][k] |= signals[k]
    return sorted(",".join(g["keywords"]) for g in groups)


def test_groups_equal_the_sequential_form():
    from types import SimpleNamespace

    rng = random.Random(8)
    guarded = 0
    for _ in range(80):
        word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 5)))
        some = lambda: set(rng.sample(["ab", "abc", "x", "cd"], rng.choice((0, 1, 1, 2))))
        rows = []
        for k in range(25):
            signals = {x: some() for x in merging.KINDS}
            words, kind = grouping.signature(signals, {"ab"}) if k % 2 else ({word()} if k % 3 else set(), "unknown")
            rows.append((f"k{k:03d}", {f"{w}{rng.randint(0, 2)}" for w in words}, {word() for _ in range(rng.randint(0, 2))}, set(rng.sample("pqrstuvwxyz", rng.choice((0, 0, 0, 1)))), signals, kind, rng.choice(((1.0, 0.0), (0.0, 1.0), (0.6, 0.8)))))
        groups = grouping.Groups()
        for k, w, p, c, s, kind, v in rows:
            groups.add(SimpleNamespace(keyword=k, words=w, parts=p, canonicals=c, signals=s, kind=kind, vector=v, batch_count=1, score_sum=1.0))
        assert sorted(",".join(k) for k in groups.keywords) == sequential_groups(rows)
        guarded += sequential_groups([(*r[:4], {x: set() for x in merging.KINDS}, *r[5:]) for r in rows]) != sequential_groups(rows)
    assert guarded > 10
    assert grouping.signal_parts({"predicates": {"최고이다"}, "actions": set(), "nouns": {"맛"}}) == {"최고이다", "최고", "맛"}


def test_signals_of_orders(spark, sf_dir):
    from millrace.plans import keyword_queries

    made = {r["keyword"]: (r["predicates"], r["actions"], r["nouns"], r["topics"]) for r in keyword_queries.keyword_signals(spark, sf_dir).collect()}
    assert made["음식이 맛있다"] == ("맛있다", "", "음식", "음식") and made["서비스가 최고이다"] == ("최고이다", "", "서비스,최고", "서비스")
    assert made["자주 가고 좋다"] == ("가다,좋다", "자주가다", "", "") and made["재방문 의사 있다"] == ("재방문의사_있다", "", "방문,의사", "방문")
    assert made["분위기가 만족하다"] == ("만족하다", "만족하다", "분위기", "분위기")
    groups = keyword_queries.guarded_groups(spark, sf_dir).collect()
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert sum(r["batch_count"] for r in groups) == counts and all(r["representative"] in r["keywords"].split(",") for r in groups)
