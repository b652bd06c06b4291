"""Packing, pieces, token counts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import packing, pieces, token_counts, word_ids
from millrace.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, ids string, n_tokens int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", "clash", 1) for k, t in rows], DOCS)


def check_plan(histogram, made):
    total, spans, sizes = 0, defaultdict(list), Counter()
    for r in made:
        for rank in range(r["low"], r["high"]):
            spans[r["origin"], rank].append((r["start"], r["length"]))
            sizes[r["sequence"] + rank - r["low"]] += r["length"]
            total += r["length"]
    for length, n in histogram.items():
        for rank in range(n):
            at = 0
            for start, width in sorted(spans[length, rank]):
                assert start == at and width > 0
                at += width
            assert at == length
    assert total == sum(k * n for k, n in histogram.items()) and max(sizes.values()) <= 4096 and sorted(sizes) == list(range(len(sizes)))
    return total / (4096 * len(sizes))


@pytest.mark.parametrize("histogram", [{1: 1}, {4095: 7}, {100: 3000}, {1500: 40, 2600: 41}, {3000: 400, 10: 3}])
def test_plan(histogram):
    fill = check_plan(histogram, packing.plan(histogram))
    assert fill > 0.97 or sum(k * n for k, n in histogram.items()) < 40 * 4096


def test_plan_of_many_lengths():
    rng = random.Random(5)
    histogram = dict(Counter(min(4095, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(5000)))
    assert check_plan(histogram, packing.plan(histogram)) > 0.97


def test_least_squares():
    x = packing.nonnegative_least_squares([(4,), (1, 3), (2, 2), (1, 1, 2)], np.array([0.0, 30, 40, 10, 5]))
    assert (x >= 0).all() and np.allclose([x[1] + 2 * x[3], 2 * x[2] + x[3], x[1], x[0]], [30, 40, 10, 5], atol=1e-6)


def test_packing_covers_every_id(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", "a", "Word, word. " * 4000, "it's <|endoftext|> 3.14, x\x1cy É.", *(" ".join(rng.choices("alpha beta gamma, delta. Ünï 42".split(), k=rng.randint(1, 3000))) for _ in range(60))]
    rows = [*enumerate(texts), (5, texts[5]), (None, "null id")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for k, t in rows:
        wanted[k, (np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    made = packing.with_offsets(packing.pack(documents(spark, rows).repartition(3))).collect()
    found, sequences = defaultdict(list), defaultdict(list)
    for r in made:
        assert len(r["ids"]) == 4 * r["length"]
        found[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (k, n), parts in found.items():
        copies = sum(c for (i, ids), c in wanted.items() if i == k and len(ids) == 4 * n)
        ids = next(ids for (i, ids) in wanted if i == k and len(ids) == 4 * n)
        assert sum(len(p) for _, p in parts) == copies * len(ids) and all(ids[4 * s : 4 * s + len(p)] == p for s, p in parts)
    assert sum(len(p) for parts in found.values() for _, p in parts) == sum(len(ids) * c for (_, ids), c in wanted.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    made = QUERIES["op1_packing_nnls"](spark, sf_dir).collect()
    for r in made:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    used = sum(r["length"] for r in made)
    assert used / (4096 * len({r["sequence_id"] for r in made})) > 0.97


def test_word_cache_stays_bounded():
    small = word_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=200)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdeé.,'#", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(200)]
    assert small.encode(texts) == small.whole(texts) and len(small.known) <= 400


def test_pieces_equal_the_library():
    coder = pieces.coder("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = ["", " ", "  a  b ", "▁", "x▁▁y", "\n\n a", "\x00", "日本語 😀", "a" * 500, " " * 70, "<s> <0x41>", "á", *("".join(rng.choices("ab \n▁é日😀.,<>\x01", k=rng.randint(1, 40))) for _ in range(500))]
    for text in texts:
        ids = coder.library.encode(text)
        assert coder.encode(text) == ids and coder.decode([*ids, coder.end]) == coder.library.decode([*ids, coder.end])
    coder.check()
    ids = [coder.byte[0xE6], coder.byte[0x41], coder.byte[0xFF]]
    assert coder.decode(ids) == coder.library.decode(ids)


def test_piece_digests(spark, sf_dir):
    library = pieces.coder("piece_bpe_32k.model").library
    texts = [None, "", "word " * 50_000, *(r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    made = pieces.piece_digests(documents(spark, [*enumerate(texts), (None, "x")]))
    for r in made.collect():
        ids = [*library.encode("x" if r["doc_id"] is None else texts[r["doc_id"]] or ""), library.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
    whole = pieces.encode_pieces(documents(spark, [(1, "a b"), (1, "a b"), (2, None)])).collect()
    assert [r["decoded"] for r in whole] == ["a b", "a b", ""] and whole[2]["ids"] == [library.eos_id()]
    assert pieces.encode_pieces(documents(spark, [])).count() == 0


def test_ledger(spark):
    ledger = token_counts.Ledger(spark)
    rows = lambda *x: spark.createDataFrame(x, "source string, lang string, tokenizer string, n_tokens long, n_chars long")
    assert ledger.totals().count() == 0
    assert ledger.commit("a/1 ü", token_counts.inserts(rows(("s", "en", "v1", 5, 20), ("s", "en", "v1", 7, 30), (None, "en", "v1", 1, 1))))
    assert not ledger.commit("a/1 ü", token_counts.inserts(rows(("s", "en", "v1", 5, 20))))
    assert ledger.commit("b", token_counts.revisions(rows(("s", "en", "v1", 5, 20)), rows(("s", "de", "v1", 6, 20))))
    assert ledger.commit("c", token_counts.deletes(rows((None, "en", "v1", 1, 1))))
    again = token_counts.Ledger(spark, ledger.path)
    assert not again.commit("c", token_counts.deletes(rows((None, "en", "v1", 1, 1))))
    assert sorted(tuple(r) for r in again.totals().collect()) == [("s", "de", "v1", 1, 6, 20, 0, 0), ("s", "en", "v1", 1, 7, 30, 0, 0)]


def test_ledger_under_a_race(spark, monkeypatch):
    """Both senders find the name free and write; the target then appears before the second one's commit."""
    ledger, late = token_counts.Ledger(spark), None
    late = token_counts.Ledger(spark, ledger.path)
    rows = spark.createDataFrame([("s", "en", "v1", 5, 20)], "source string, lang string, tokenizer string, n_tokens long, n_chars long")
    taken = late._taken

    def appears_first(draft, batch):
        assert ledger.commit(batch, token_counts.inserts(rows))
        return taken(draft, batch)

    monkeypatch.setattr(late, "_taken", appears_first)
    assert not late.commit("b", token_counts.inserts(rows))
    lost = token_counts.Ledger(spark, ledger.path)
    monkeypatch.setattr(lost, "_taken", lambda *_: (_ for _ in ()).throw(OSError("executor and driver lost")))
    with pytest.raises(OSError):
        lost.commit("c", token_counts.inserts(rows))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v1", 1, 5, 20, 0, 0)]
    assert token_counts.Ledger(spark, ledger.path).commit("c", token_counts.inserts(rows))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "v1", 2, 10, 40, 0, 0)]


def test_rollup(spark):
    texts = ["one two", "three", "one two", None, "", "x" * 5000]
    rows = [(k, t, la, so, "clash", 1) for k, (t, la, so) in enumerate(zip(texts, ["en", "en", "de", None, "en", "fr"], ["a", "b", "a", "a", None, "c"], strict=True))] + [(0, "one two", "en", "a", "clash", 1)]
    ledger = token_counts.Ledger(spark)

    def totals(*times):
        seen, wanted = set(), Counter()
        for k, t, la, so, *_ in sorted(rows, key=lambda r: r[0]):
            for v in token_counts.VERSIONS:
                n = len(token_counts.ranks(v).encode_ordinary(t or ""))
                for c, x in zip(token_counts.SUMS, (1, n, len(t or ""), int((t or "") in seen), n * ((t or "") in seen)), strict=True):
                    wanted[so, la, v, c] += x
            seen.add(t or "")
        return +wanted

    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows[::-1], DOCS).repartition(3)):
        made = token_counts.rollup_documents(docs, ledger=ledger)
        assert +Counter({(r["source"], r["lang"], r["tokenizer"], c): r[c] for r in made.collect() for c in token_counts.SUMS}) == totals()
    more = token_counts.rollup_documents(documents(spark, [(9, "further text")]), ledger=ledger).agg(token_counts.F.sum("n_docs")).first()[0]
    assert more == 2 * len(rows) + 2
    assert token_counts.rollup_documents(documents(spark, [])).count() == 0


def test_pieces_fall_back_on_the_library():
    coder = pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    text = "of the table and " * 3
    coder.encode(text)
    coder.check()
    assert not coder.differs
    coder.ids["▁cat"] += 1
    coder.encode("the cat")
    coder.check()
    assert coder.differs and coder.by_library(text) == ([*coder.library.encode(text), coder.end], text)
