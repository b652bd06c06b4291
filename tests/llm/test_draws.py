"""Centroids, byte pairs, resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import byte_pairs, centroids, resampling
from millrace.llm.oracles import ORACLES
from millrace.llm.queries import QUERIES
from tests.compare import both

VECTORS = "vec_id long, embedding array<double>, cluster string, distance int"


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (named(r[0]), len(s := ",".join(map(str, r[1]))), s))
    centre = [v for _, v in starts[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        groups = [[] for _ in centre]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centre = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centre)]
    found = [(i, *near(v)) for i, v in kept]
    cut = lambda x: min(x, 2**63 - 1)
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += cut(d)
    return sorted((str(i), c, cut(d), cut(inertia[c]), cut(sum(inertia.values())), hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for i, d, c in found)


def clusters(spark, rows, parts=3):
    made = centroids.cluster_vectors(spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], VECTORS).repartition(parts)).collect()
    return sorted((str(r["vec_id"]), *r[1:6]) for r in made), sum(r["by_integers"] for r in made[:1])


def test_clusters_equal_brute_force(spark):
    rng = random.Random(3)
    spots = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(spots)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [float("nan")] + [0.0] * 63), (304, [None] + [0.0] * 63), (305, [float("inf")] * 64), (None, [0.25] * 64), (7, rows[7][1]), (7, rows[8][1])]
    assert clusters(spark, rows)[0] == brute_clusters(rows)
    huge = [*rows, (900, [1e300] * 64), (901, [-1e300] * 64), (902, [3e8] * 64)]
    assert clusters(spark, huge)[0] == brute_clusters(huge)


def test_ties_and_close_calls_are_settled_by_integers(spark):
    rng = random.Random(4)
    rows = [(i, [float(2**19 + rng.randint(0, 2)) / 64 * 8 for _ in range(64)]) for i in range(120)] + [(200 + i, [1.0] * 64) for i in range(40)]
    made, opened = clusters(spark, rows)
    assert made == brute_clusters(rows) and opened > 0
    few = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)]
    assert clusters(spark, few)[0] == brute_clusters(few)
    assert clusters(spark, [])[0] == []


def test_intervals_hold_the_exact_values():
    rng = np.random.default_rng(5)
    for top in (3, 2**12, 2**26):
        x, c = rng.integers(-top, top + 1, (200, 64)), rng.integers(-top, top + 1, (16, 64))
        best, distance, _ = centroids.Screen(c.tolist()).nearest(x.astype(float))
        exact = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in c.tolist()] for v in x.tolist()]
        assert [(min(e), e.index(min(e))) for e in exact] == list(zip(distance, best.tolist()))


@pytest.mark.parametrize("name", ["op11_centroid_screen", "op13_target_resampling"])
def test_same_rows_as_sql(spark, sf_dir, name):
    mine, theirs = both(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert mine == theirs


def by_library(coder, text):
    ids = coder.library.encode(text, add_special_tokens=False).ids
    return ids, coder.library.decode(ids, skip_special_tokens=False)


def test_pairs_equal_the_library():
    coder = byte_pairs.PairCoder(byte_pairs.public_tokenizers.path("byte_bpe_50k.json"), most=300)
    rng = random.Random(6)
    texts = ["", " ", "  ", "a  b   c\n\n d \n e ", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|end", "aaaaaaa" * 9, "it's we'll 'S  ", "\x1c\x1d a\x85b​ c", "日本語 😀🏽 ١٢ ½²", "a\r\n\tb ", "  　x", "͸ \U00010fff"]
    texts += ["".join(rng.choices("ab \n\té日😀.,<>|\x01'ſ²٣́ s", k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x1FFFF)))) if rng.random() < 0.6 else " " for _ in range(30)) for _ in range(800)]
    for text, (ids, read, _) in zip(texts, coder.encode(texts), strict=True):
        wanted, decoded = by_library(coder, text)
        assert np.frombuffer(ids, "<u4").tolist() == wanted and read.decode() == decoded == coder.decode(wanted)
    assert coder.decode([255, 99, 10_000_000, 50256]) == coder.library.decode([255, 99, 50256], skip_special_tokens=False)
    assert max(len(k.ids) for k in (coder.known, coder.first, coder.coded)) <= 300


@pytest.mark.parametrize("text", ["q" * 400_000, " " * 200_000 + "x", "1" * 200_000, "ab" * 150_000 + " c"])
def test_long_runs(text):
    coder = byte_pairs.coder("byte_bpe_50k.json")
    ids, read, _ = coder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == by_library(coder, text)[0] and read.decode() == text
    assert all(len(w) <= byte_pairs.LONGEST for kept in (coder.known, coder.first, coder.coded) for w in kept.ids)


def test_pair_query(spark, sf_dir):
    coder = byte_pairs.coder("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    made = QUERIES["op12_pair_index"](spark, sf_dir).collect()
    assert len(made) == len(texts)
    for r in made:
        ids, text = by_library(coder, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))
    odd = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "a b", "c"), (None, "a b", "c")], "doc_id long, text string, ids string")
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in byte_pairs.encode_pairs(odd).collect()) == [("1", [], ""), ("1", [], ""), *[("None", by_library(coder, "a b")[0], "a b")] * 2]
    assert byte_pairs.encode_pairs(odd.limit(0)).count() == 0 == byte_pairs.pair_digests(odd.limit(0)).count()


def brute_draw(rows, targets, low=1, high=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in range(low, high + 1) for k in range(len(words) - n + 1)], len(words)

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in targets for b in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))))
    out = []
    for i, f, n in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    placed = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = placed[: 10 * len(placed) // 100]
    return Counter([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in placed[len(drawn) :] + [r for r in out if r[4] < 20]])


@pytest.mark.parametrize(("low", "high", "parts"), [(1, 1, 7), (1, 2, 2)])
def test_draw_equals_brute_force(spark, low, high, parts):
    rng = random.Random(7)
    words = "Alpha beta GAMMA delta Ünï été 42 x zeta eta theta".split()
    rows = [(i, " ".join(rng.choices(words, weights=[1 + (i + k) % 7 for k in range(len(words))], k=rng.randint(0, 60)))) for i in range(2500)]
    rows += [(None, None), (5, ""), (5, rows[5][1]), (None, "alpha " * 30), *[(9, "alpha " * 40)] * 30, (77, "word " * 30_000)]
    targets = ["alpha beta beta zeta", None, "Ünï ünï " * 50]
    made = resampling.resample(spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, rank int").repartition(parts), spark.createDataFrame([(t,) for t in targets], "text string"), low=low, high=high)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in made.collect()) == brute_draw(rows, targets, low, high)


def test_draw_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).count() == 0
    rows = [(1, "a " * 25), (2, "b"), (3, None)]
    made = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), none.select("text")).collect()
    assert Counter(tuple(r) for r in made) == brute_draw(rows, [])


def test_tournament():
    rng = random.Random(8)
    rows = [(rng.randint(-5, 5), rng.choice([None, *range(50)]), rng.randint(0, 3), 0) for _ in range(3000)]
    runs = [sorted(rows[k::9], key=lambda r: resampling.order(*r[:3])) for k in range(9)]
    blocks = sorted((run[k : k + 16] for run in runs for k in range(0, len(run), 16)), key=lambda b: resampling.order(*b[0][:3]))
    wanted = sorted(rows, key=lambda r: resampling.order(*r[:3]))
    for n in (0, 1, 700, 3000, 4000):
        made = list(resampling.merged_until(iter(blocks), n))
        assert [r for r, k in made if k] == wanted[:n] and Counter(r for r, _ in made) == Counter(rows)
