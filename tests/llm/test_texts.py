"""Personal data, fingerprints, near duplicates, page texts, and the pipeline."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import near_join, page_text, pii, simhash
from millrace.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, class_id string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "clash", "clash") for k, t in rows], DOCS)


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans(spark):
    texts = [None, "", "a@b.c, x@y", "1.2.3.4.5 999.1.1.1 001.002.003.004", "4111 1111-1111 1111 and 4111111111111112", "+1 (988) 555-2485. +1 2", "é@ü.de a@b.de +49 30 1234567", "1" * 40, "\n9\n", "@@@", "9" * 5000]
    for r in pii.pii_digests(documents(spark, [*enumerate(texts), (1, ""), (None, "a@b.cc")])).collect():
        text = "a@b.cc" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        wanted = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(wanted.encode()).hexdigest() and (r["n_added"] or r["spans"] == wanted)
        assert (r["n_email"], r["n_phone"]) == (wanted.count("email"), wanted.count("phone"))
    assert pii.pii_digests(documents(spark, [])).count() == 0


def test_discovery(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(k, f"{word()} {word()} call me at +1 ({200 + k}) 555-{1000 + k} {word()} v{k}9{k}x") for k in range(30)]
    rows += [(100 + k, f"{word()} call me at 555-{2000 + k}-ext {word()}") for k in range(5)] + [(200 + k, f"{word()} code ab12{k}45 {word()}") for k in range(20)]
    made = {r["doc_id"]: r for r in pii.pii_digests(documents(spark, rows)).collect()}
    assert all(made[100 + k]["n_added"] == 1 and made[100 + k]["n_phone"] == 0 for k in range(5))
    assert sum(r["n_added"] for r in made.values()) == 5
    start = rows[30][1].index("555-")
    assert made[100]["spans"] == f"phone:{start}:{start + 12}"


def brute_scores(places, rounds, support, sure, combined, unknown, rare):
    """{instance: (kind, score)} by dictionaries over places(kind, instance, patterns)."""
    kinds = defaultdict(set)
    for k, i, _ in places:
        kinds[i].add(k)
    elsewhere = {i: min(x for x in ks if x >= 0) for i, ks in kinds.items() if min(ks) < 0 <= max(ks)}
    edges = {}
    for k, i, ps in places:
        for p in ps:
            edges[p, i] = max(k, edges.get((p, i), -99))
    of = defaultdict(dict)
    for (p, i), k in edges.items():
        of[p][i] = elsewhere.get(i, k) if k < 0 else k
    of = {p: x for p, x in of.items() if len(x) >= support}
    believed = {}
    for _ in range(rounds):
        doubt = defaultdict(dict)
        for members in of.values():
            seeded = [k for k in members.values() if k >= 0]
            for kind in range(4):
                mine = {i: 1.0 for i, k in members.items() if k == kind} | {i: believed[i][1] for i, k in members.items() if k < 0 and i in believed and believed[i][0] == kind}
                unlike = [i for i, k in members.items() if k < 0 and not (-1 - k) >> kind & 1]
                against = len(seeded) - seeded.count(kind) + unknown * len(set(unlike) - set(mine))
                like = len(members) - len(seeded) - len(unlike)
                if mine and len(mine) * rare >= like and (score := sum(mine.values()) / (1 + len(mine) + against)) >= combined:
                    for i, k in members.items():
                        if k < 0:
                            doubt[i][kind] = doubt[i].get(kind, 1.0) * (1 - score)
        best = {i: max(((1 - d, -k) for k, d in x.items())) for i, x in doubt.items()}
        believed = {i: (-k, s) for i, (s, k) in best.items() if s >= sure}
    return believed | {i: (k, 1.0) for i, k in elsewhere.items()}


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    places = []
    for _ in range(3000):
        i = rng.randrange(400)
        home, like = i % 7, -1 - (1 << i % 4 if i % 5 else 0)
        kind = like if i >= 150 else (i % 4 if rng.random() < 0.95 or i % 9 else like)
        places.append((kind, i, [home * 40 + i % 4 * 10 + rng.randrange(3) if rng.random() < 0.9 else rng.randrange(280) for _ in range(rng.randint(0, 4))]))
    frame = spark.createDataFrame(places, "kind int, instance long, patterns array<bigint>")
    for rounds, support, sure, combined, unknown, rare in ((3, 3, 0.8, 0.6, 0.5, 16), (1, 3, 0.5, 0.5, 0.5, 2), (4, 2, 0.5, 0.3, 0.1, 1)):
        wanted = brute_scores(places, rounds, support, sure, combined, unknown, rare)
        made = {r["instance"]: (r["kind"], r["score"]) for r in pii.discovered(frame, rounds=rounds, support=support, sure=sure, combined=combined, unknown=unknown, rare=rare).collect()}
        assert {i: k for i, (k, _) in made.items()} == {i: k for i, (k, _) in wanted.items()} and len(wanted) > 5
        assert all(abs(made[i][1] - wanted[i][1]) < 1e-9 for i in wanted)


@pytest.mark.parametrize(("n_seeds", "n_unseen"), [(100, 25), (60, 60), (50, 100), (25, 100)])
def test_unseen_identifiers_may_outnumber_seeds(spark, n_seeds, n_unseen):
    """The review's mix: other spellings in the contexts of seeds, at ratios from 4:1 to 1:4, with decoys elsewhere."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(3, 8)))
    around = lambda mid: f"{' '.join(word() for _ in range(8))} {mid} {' '.join(word() for _ in range(8))}"
    rows, planted = [], {}
    for k in range(n_seeds):
        rows += [(len(rows), around(f"please phone us on +49 30 {1000000 + 7 * k} during")), (len(rows) + 1, around(f"reach me at {word()}{k}@mail.org or write"))]
    for k in range(n_unseen):
        for kind, form, odd in (("phone", "please phone us on {} during", f"030 {2000000 + 7 * k}"), ("email", "reach me at {} or write", f"user{k}@intranet" if k % 2 else f"user{k}[at]mail.com")):
            text = around(form.format(odd))
            planted[len(rows)] = f"{kind}:{text.index(odd)}:{text.index(odd) + len(odd)}"
            rows.append((len(rows), text))
    rows += [(len(rows) + k, around(f"{word()} {word()}{k} and {k * 37} of {1000000 + k} or 030 {3000000 + k}")) for k in range(300)]
    made = {r["doc_id"]: r for r in pii.pii_digests(documents(spark, rows)).collect()}
    right = sum(made[k]["spans"] == x for k, x in planted.items())
    added = sum(r["n_added"] for r in made.values())
    assert right >= 0.9 * len(planted) and right >= 0.9 * added, (right, len(planted), added)


def test_seeds_of_random_texts():
    rng = random.Random(22)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "b.c", "@", "@x.y", ".", "-", " ", "1", "22.3", "+", "4111 1111 1111 1111", "é", "_", "%"], k=rng.randint(0, 25)))
        found = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.seeds(text))
        assert found == base_spans(text), text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "q" * 1_000_000 + "@", "q" * 1_000_000 + "@a.b", "a@" * 500_000, "1." * 500_000, "+1 " * 300_000, "a.b@c." * 150_000, " 12345" * 160_000])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    found = pii.seeds(text)
    assert time.process_time() - began < 1
    pii.others(text, found)
    assert time.process_time() - began < 8


def test_planted_identifiers_are_found(spark):
    """Unseen identifiers in contexts of seeds, beside as many that stand elsewhere: precision and recall."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(3, 8)))
    around = lambda mid: f"{' '.join(word() for _ in range(9))} {mid} {' '.join(word() for _ in range(9))}"
    contexts = {"email": ("write to {} for details", "contact : {} ( office )"), "phone": ("call us on {} today", "mobile number {} only"), "card": ("charged card {} on file", "pay with {} now please"), "ip": ("request from {} was denied", "host at {} went down")}
    seed = {"email": lambda k: f"{word()}{k}@mail.{word()}.org", "phone": lambda k: f"+49 30 {1000000 + k}", "ip": lambda k: f"10.{k % 250}.{k // 250}.7"}
    odd = {"email": lambda k: f"{word()}{k}@{word()}", "phone": lambda k: f"030/{2000000 + k}", "card": lambda k: f"X{k}-9911-{40 + k}", "ip": lambda k: f"fe80::{k:x}:77a{k}"}

    def card(k):
        body = f"4{k:014d}"
        return body + next(d for d in "0123456789" if luhn(body + d))

    seed["card"] = card
    rows, planted = [], {}
    for kind, forms in contexts.items():
        for k in range(80):
            rows.append((len(rows), around(forms[k % 2].format(seed[kind](k)))))
        for k in range(25):
            text = odd[kind](k).replace(" ", "")
            assert not pii.seeds(text)
            full = around(forms[k % 2].format(text))
            planted[len(rows)] = f"{kind}:{full.index(text)}:{full.index(text) + len(text)}"
            rows.append((len(rows), full))
    clean = range(len(rows), len(rows) + 300)
    rows += [(k, around(f"{word()} {word()}{k} and {k * 37} of {word()}-{k}")) for k in clean]
    made = {r["doc_id"]: r for r in pii.pii_digests(documents(spark, rows)).collect()}
    right = sum(made[k]["spans"] == x for k, x in planted.items())
    added = sum(r["n_added"] for r in made.values())
    assert right >= 0.9 * len(planted) and right >= 0.9 * added, (right, len(planted), added)


def test_whole_tokens_and_contexts():
    long = "x" * 700
    text = f"a9{'b' * 900} {long} {long} 12345 {long} {long}"
    spans = pii.others(text, pii.seeds(text))
    assert spans[0][:2] == (0, 902) and text[slice(*spans[1][:2])] == "12345"
    at = spans[1]
    short = pii.patterns(f"y {long} {long} 12345 {long} {long}", *(x - text.index(" " + long) + 1 for x in at[:2]))
    assert pii.patterns(text, *at[:2]) == short
    many = " ".join(f"{k}.1.1.1" for k in range(12))
    glued = ",".join(f"{k}.1.1.1" for k in range(12))
    assert pii.others(many, pii.seeds(many)) == [] and pii.others(glued, pii.seeds(glued)) == []


def test_identifiers_known_elsewhere(spark):
    rows = [(1, "write +4912345678901 soon"), (2, "see +4912345678901 2024 there"), (3, "card 4111111111111111"), (4, "order 12 4111111111111111 sent"), (5, "order 12 4111111111111112 sent")]
    made = {r["doc_id"]: r for r in pii.pii_digests(documents(spark, rows)).collect()}
    assert made[1]["spans"] == "phone:6:20" and made[2]["spans"] == "phone:4:18" and made[2]["n_added"] == 1
    assert made[3]["spans"] == "card:5:21" and made[4]["spans"] == "card:9:25" and made[4]["n_added"] == 1
    assert made[5]["spans"] == "" and made[1]["n_added"] == made[3]["n_added"] == 0
    assert all(r["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest() for k, t in rows for r in [made[k]])


def test_digit_groups_and_patterns_of_later_rounds(spark):
    runs = lambda text: [text[a:b] for a, b, whole in pii.others(text, pii.seeds(text)) if whole]
    assert runs("call (555) 123-4567.") == ["(555) 123-4567", "123-4567"] and runs("at 020 79 46 09 58, 12") == ["020 79 46 09 58"]
    assert runs("card 4111 1111 1111 1112") == ["4111 1111 1111 1112"] and runs("5  6 7/8 a1") == []
    assert runs("1234567890 1234567891 1234567892 1") == ["1234567890", "1234567891", "1234567892", "1234567892 1"]
    assert (5, 24, False) in pii.others("1234 4111 1111 1111 1112", [])
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(k, f"{word()} {word()} call me at +1 ({200 + k}) 555-{1000 + k} {word()} {word()}") for k in range(60)]
    shapes = ["555 123 45{}", "020 79 46 09 {}", "4111 1111 1111 11{}", "(555) 123-45{}", "555-12{}-ext"]
    numbers = [shapes[k % 5].format(10 + k) for k in range(15)]
    numbers = [n for n in numbers if not pii.seeds(n)]
    rows += [(100 + k, f"{word()} call me at {n} {word()} {word()}") for k, n in enumerate(numbers)]
    rows += [(200 + k, f"{word()} {word()} desk line {n} {word()} {word()}") for k, n in enumerate(numbers)]
    rows += [(300, f"{word()} {word()} desk line 777 888 99 {word()} {word()}"), (301, f"{word()} {word()} room {word()} 777 12 {word()}")]
    made = {r["doc_id"]: r["spans"] for r in pii.pii_digests(documents(spark, rows)).collect()}
    for i, text in rows[60:-1]:
        n = numbers[i % 100] if i < 300 else "777 888 99"
        assert made[i] == f"phone:{text.index(n)}:{text.index(n) + len(n)}", (i, text)
    assert made[301] == ""


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(0, 60))) for _ in range(60)] + ["", "😀é" * 7, "x " * 9000]
    rows = [*enumerate(texts), (3, texts[3]), (7, None), *((None, f"no id {k}") for k in range(40)), *((5, f"five {k}") for k in range(30))]
    hashes = {r["text"]: r["h"] for r in documents(spark, rows).select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    wanted = Counter()
    for k, (doc_id, text) in enumerate(order):
        follower, n = order[(k + 1) % len(order)][1], len(text)
        edited = text[: n - n // 2] + follower[: n // 2]
        marks = [simhash.simhash(x) for x in (text, edited, follower)]
        wanted[doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), f"{marks[0]:016x}", f"{marks[1]:016x}", simhash.likeness(marks[0], marks[1]), simhash.likeness(marks[0], marks[2])] += 1
    made = simhash.fingerprint_documents(documents(spark, rows).repartition(5))
    parts = simhash.with_next(documents(spark, rows)).filter("doc_id IS NULL AND NOT only_next").groupBy("part").count().collect()
    assert len(parts) > 5 and max(r["count"] for r in parts) < 20  # rows without an id are not one part
    assert Counter(tuple(r) for r in made.collect()) == wanted
    assert simhash.fingerprint_documents(documents(spark, [])).count() == 0
    one = simhash.fingerprint_documents(documents(spark, [(None, "a b c d e f")])).first()
    assert one["near_edited"] <= 1 and one["near_next"] == 1 and one["doc_id"] is None


def test_radius_search_is_exact(spark):
    rng = random.Random(3)
    marks = [rng.getrandbits(64) for _ in range(150)]
    for m in marks[:60]:
        for flips in (1, 2, 3, 4):
            marks.append(m ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks] + [None]
    frame = spark.createDataFrame([(m,) for m in signed], "mark long")
    for r in simhash.within_radius(frame, frame).collect():
        near = [m for m in marks if ((m ^ r["mark"]) & (2**64 - 1)).bit_count() <= 3]
        assert (r["n_marks"], r["n_docs"]) == (len(set(near)), len(near))


def brute_classes(rows):
    """(class_id, n_links) of each doc_id, from all pairs of sets of five-word runs."""
    sets, key = [], []
    for _, t in rows:
        w = (t or "").split()
        key.append(tuple(w))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), Counter()

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if key[a] == key[b] or both and both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        c = top(k)
        least[c] = i if least[c] is None else min(least[c], i)
    return [(i, least[top(k)], links[k]) for k, (i, _) in enumerate(rows)]


def test_near_classes(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    rows = [(900, ""), (901, None), (902, "a b"), (903, "a  b"), (904, "a b c")]
    for base in range(25):
        text = rng.choices(words, k=rng.randint(60, 300))
        for copy in range(rng.randint(1, 12)):
            changed = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((base * 20 + copy, " ".join(changed)))
    made = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_join.near_classes(documents(spark, rows)).collect())
    assert made == Counter(brute_classes(rows))
    assert near_join.near_classes(documents(spark, [])).count() == 0
    same = near_join.near_classes(documents(spark, [(5, "x y z"), (5, "x y z"), (None, "x y z")])).collect()
    assert len(same) == 3 and {r["n_links"] for r in same} == {2}


@pytest.mark.parametrize("family", [1000, 20])
def test_tiles_of_a_large_family(spark, monkeypatch, family):
    """One block in tiles; and the same family as a block a band."""
    monkeypatch.setattr(near_join, "TILE", 16)
    rng = random.Random(6)
    text = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        changed = list(text)
        changed[rng.randrange(120)] = f"x{k}"
        if k % 3 == 0:
            changed[rng.randrange(120)] = f"y{k}"
        rows.append((k, " ".join(changed)))
    for k in range(60):  # a chain: neighbours are similar, ends are not
        rows.append((100 + k, " ".join(f"c{x}" for x in range(8 * k, 8 * k + 150))))
    rows += rows[:3] * 4
    made = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_join.near_classes(documents(spark, rows).repartition(7), family=family).collect())
    assert made == Counter(brute_classes(rows))


def test_bayes_bound():
    from math import comb

    for n, needed in near_join.least_matches(0.8, 1e-4, 190, 19):
        tail = lambda m, n=n: sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(needed) >= 1e-4 and (needed == 0 or tail(needed - 1) < 1e-4)


PAGE = '<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>m</a></nav><div class="cookie-notice">ck</div><main><article><header><h1>T &amp; U</h1></header><p>One <b>two</b>\n three<br>four<p>Five&nbsp;<i>six</i></p><ul><li>a<li>b</ul><div class="ad">x</div><aside>s</aside><form>f<input></form></article><section id="comments"><article class="comment"><p>cc</p></article></section></main><footer>ff</footer><script>var a="<p>z</p>";</script></body></html>'


CASES = [
    (PAGE, "T & U\nOne two three four\nFive six\na\nb"),
    ("", ""),
    (None, ""),
    ("plain", "plain"),
    ("<div>a < b &lt;p&gt; <p unclosed", "a < b <p>"),
    ("<p>a<p>b</p><!-- <p>c</p> --><p hidden>d</p>", "a\nb"),
    ("<body><p>a &amp;amp; &am</p>", "a &amp; &am"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<div class='a'>x</div" * 3, "xxx"),
    ("<main><h1>Title</h1><article><p>Text of it</p></article></main>", "Title\nText of it"),
    ("<main><p>All the prose there is here</p></main><article><p>Teaser</p></article>", "All the prose there is here"),
    ('<p title="a hidden gem">x</p><div data-state="hidden">y</div><p style="display: none">z</p>', "x\ny"),
    ('<div class="content has-sidebar"><article><p>x y z</p></article></div><div class="sidebar">s</div>', "x y z"),
    ('<div class="widget"><article><p>x</p></article></div><div id="comments"><p>c</p></div>', "x"),
    ("<nav>m</nav><p>" + "long " * 60_000 + "</p>", ("long " * 60_000).strip()),
]


def test_single_pages(spark):
    rows = [(k, f"http://h{k}.x/", html, "clash", "clash") for k, (html, _) in enumerate(CASES)] + [(0, "http://h0.x/", PAGE, "clash", "clash"), (None, None, None, None, None)]
    made = page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")).collect()
    assert len(made) == len(rows) and all(r["text"] == ("" if r["page_id"] is None else CASES[r["page_id"]][1]) and r["n_chars"] == len(r["text"]) for r in made)
    assert page_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def site(k, rng, sections):
    """A page without telling names: a menu and adverts that rotate, a notice of one section, link boxes in the text."""
    words = lambda n: " ".join(rng.choices([f"w{j}" for j in range(4000)], k=n))
    menu = "".join(f'<li><a href="/{j}">item {rng.randrange(50)}</a></li>' for j in range(rng.randint(3, 7)))
    box = f'<div><a href="/a">{words(3)}</a> <a href="/b">{words(4)}</a></div>'
    note = "<div><p>Members of this section read it first and pay less for it</p></div>" if k % sections == 0 else ""
    text = [words(rng.randint(3, 80)) for _ in range(rng.randint(1, 6))] + ["Said often, and rightly."] * (k % 4 == 0)
    prose = "".join(f"<p>{t}</p>" for t in text)
    html = f'<body><div><ul>{menu}</ul></div><div class="x{k}">advert {rng.randrange(60)}</div>{note}<section><h2>{words(5)}</h2>{prose}{box}</section><div>&copy; {rng.randrange(60)}</div></body>'
    return html, text


def test_templates_of_hosts(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for host, pages, sections in (("large.x", 400, 9), ("small.x", 30, 3)):
        for k in range(pages):
            html, text = site(k, rng, sections)
            wanted[len(rows)] = text
            rows.append((len(rows), f"http://{host}/{k}", html))
    copy = site(1, rng, 9)[0]
    rows += [(1000 + k, f"http://copy.x/{k}", copy) for k in range(50)]
    made = {r["page_id"]: r["text"].split("\n") for r in page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()}
    for k, text in wanted.items():
        assert made[k][1:] == text, k
    assert all(made[1000 + k] == made[1000] and len(made[1000]) > 3 for k in range(50))


def test_counts_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, f"http://h{k % 2}.x/{k}", site(k % 7 if k % 3 else k, rng, 2)[0]) for k in range(60)]
    rows += [(100 + k, "http://h0.x/", rows[0][2]) for k in range(5)]
    wanted, seen = Counter(), set()
    for _, url, html in rows:
        page = page_text.Page(html)
        if (url[7:9], page.prose()) not in seen:
            seen.add((url[7:9], page.prose()))
            wanted.update((url[7:11], *n[1:4]) for n in page.nodes)
    made = page_text.counted(page_text.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert {(r["host"], r["place"], r["slot"], r["content"]): r["times"] for r in made} == wanted


def test_unique_titles_and_prices_stay(spark):
    """A shape that recurs outside the prose, but never with the same content, is no template."""
    rng = random.Random(31)
    words = lambda n: " ".join(rng.choices([f"w{j}" for j in range(3000)], k=n))
    rows, wanted = [], []
    for k in range(30):
        prose = [words(rng.randint(30, 60)) for _ in range(6)]
        wanted.append("\n".join([f"Product {k}", f"Price {10 + 3 * k} euro", *prose]))
        rows.append((k, f"http://shop.x/{k}", f"<body><div class=menu2><ul><li><a href=/>Home</a></li></ul></div><div class=top><h1>Product {k}</h1><p>Price {10 + 3 * k} euro</p></div><div class=desc>{''.join(f'<p>{x}</p>' for x in prose)}</div><div class=legal>All rights reserved</div></body>"))
    made = {r["page_id"]: r["text"] for r in page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [made[k] for k in range(30)] == wanted


@pytest.mark.parametrize("markup", ["<div>x", "<b>x", "<b>x<i>", "<h1>x", "<ul><li>x", "<span><p>x", "<b>x</i>", "<b><div>x</b>", "<table><tr><td>x", "<a href=x>x"])
def test_deep_markup_takes_linear_time(markup):
    began = time.process_time()
    page = page_text.Page(markup * 50_000)
    assert time.process_time() - began < 15 and sum(len(t.split()) for t, *_ in page.blocks) > 0
    numbers = [n[0] for n in page.nodes]
    page_text.page_left(numbers, page.overs, *map(list, zip(*page.blocks)), [k * 8 + page_text.OUT for k in numbers[:9]] + [page_text.SETTLED], names=True)


def test_deep_page_in_spark(spark):
    rows = [(k, f"http://deep.x/{k}", "<div>x" * 20_000 + f"<p>{k}") for k in range(7)]
    assert page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 7


@pytest.mark.parametrize("names", [True, False])
def test_pages_keep_their_articles(spark, names):
    """Against the articles cut out by expressions; without names all but hosts with few pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    made = {r["page_id"]: r["text"] for r in page_text.extract_text(pages, names=names).collect()}
    wanted = {}
    for p in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", p["html"])[1]
        blocks = [" ".join(page_text.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?p>|</?h1>", article)]
        wanted[p["page_id"]] = "\n".join(filter(None, blocks))
    assert set(made) == set(wanted) and sum(made[k] != wanted[k] for k in wanted) <= (0 if names else 2)


def test_hot_keys_are_split(spark):
    from millrace.llm import common

    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 400 THEN 'hot' ELSE concat('k', id % 100) END AS key")
    table = rows.groupBy("key").count().withColumnRenamed("count", "n").withColumn("v", F.length("key"))
    for small in (5, 1000):
        made = common.hot_join(rows, table, ["key"], "n", small=small, hot=100)
        assert made.select("id").distinct().count() == made.count() == 1000 and made.filter("v <> length(key)").count() == 0
    wide = spark.range(10).select(F.repeat(F.lit("x"), 300_000).alias("a"), F.array(F.struct(F.col("id"))).alias("b"))
    assert common.small_side(wide, 100, megabytes=1) is wide and common.small_side(wide, 100) is not wide


def test_redaction(spark):
    rows = [(1, "mail a@b.cc and 10.0.0.1!", [(5, 0, 11), (16, 1, 24)]), (2, "é 1.2.3.4", [(2, 1, 9), (4, 2, 8)]), (3, None, []), (4, "none", [])]
    frame = spark.createDataFrame(rows, "id int, text string, spans array<struct<start: int, kind: int, finish: int>>")
    made = {r["id"]: r["t"] for r in frame.select("id", corpus_pipeline.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert made == {1: "mail <EMAIL> and <IP>!", 2: "é <IP>", 3: None, 4: "none"}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept, current = set(texts), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = corpus_pipeline.written(stage(spark, current, sf_dir), name)
        assert current.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in current.collect()}
        assert set(rows) <= kept and len(rows) == current.count()
        if name == "near_duplicates":
            classes = {i: c for i, c, _ in brute_classes([(i, texts[i]) for i in sorted(kept)])}
            assert set(rows) == {i for i, c in classes.items() if i == c}
        if name == "pii":
            assert set(rows) == kept and not any(base_spans(t) for t in rows.values())
        kept, texts = set(rows), rows
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == kept
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "a  b c d e f"), (None, None), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "6L AS n_chars")
    left = corpus_pipeline.near_stage(spark, odd, sf_dir).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (1, "a b c d e f"), (1, "u v w x y z")]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_rows_that_share_a_doc_id_keep_their_own_verdicts_and_spans(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.written(corpus_pipeline.quality_stage(spark, good, sf_dir).limit(20), "good").withColumn("doc_id", F.lit(None).cast("long"))
    junk = good.limit(1).withColumn("text", F.lit("# #"))
    left = corpus_pipeline.quality_stage(spark, good.unionByName(junk), sf_dir)
    made = Counter(r["text"] for r in left.collect())
    assert "# #" not in made and made == Counter(r["text"] for r in corpus_pipeline.quality_stage(spark, good, sf_dir).collect()) and made
    texts = [(None, "mail a@b.cc now"), (None, "no personal data here"), (None, "hello, at 10.0.0.1"), (7, "x"), (7, "write to c@d.ee or f@g.hh"), (7, None)]
    rows = corpus_pipeline.pii_stage(spark, documents(spark, texts), sf_dir).collect()
    wanted = [(None, "mail <EMAIL> now"), (None, "no personal data here"), (None, "hello, at <IP>"), (7, "x"), (7, "write to <EMAIL> or <EMAIL>"), (7, None)]
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(wanted)
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_stages_with_odd_tables(spark, sf_dir):
    """Null and shared ids, null, empty and very long texts, repeated rows, and columns that clash with the stages' own."""
    long = " ".join(f"w{k % 977}x{k // 977}" for k in range(60_000))
    texts = [(None, None), (None, ""), (1, ""), (1, None), (2, "mail a@b.cc now"), (2, "mail a@b.cc now"), (2, "other words"), (3, long), (None, long)]
    names = "spans text_hash found_doc_id found_text_hash clean gone_doc_id gone_text_hash gone_id gone_key text_key kept head base added part row ids rest at node docs band".split()
    plain = documents(spark, texts)
    clash = plain.select("*", *[F.lit("clash").alias(c) for c in names if c not in plain.columns])
    for name, stage in corpus_pipeline.STAGES:
        columns = [c for c in stage(spark, plain, sf_dir).columns if name != "packing" or c not in ("sequence_id", "offset")]
        made = Counter(tuple(r) for r in stage(spark, clash, sf_dir).select(columns).collect())
        assert made == Counter(tuple(r) for r in stage(spark, plain, sf_dir).select(columns).collect()), name
        left = {"quality": 2, "near_duplicates": 4, "pii": len(texts)}.get(name)
        assert left is None or sum(made.values()) == left, (name, sum(made.values()))
