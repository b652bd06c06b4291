"""Personal data: bootstrapped contextual extraction.

Expressions find the seed entities: mail addresses, network addresses, payment cards and phone numbers. The words
around an entity, and around everything else that looks like an identifier (a token with a digit or an at-sign, or
digit groups side by side), are its lexical patterns. Patterns and instances form a graph. In each round a pattern is
scored by its distinct instances that are believed to be of a kind, against those of other kinds and those that don't
look like the kind; an unknown instance that looks like it is no evidence either way, so unseen identifiers may well
outnumber the seeds. An instance is scored by the patterns it stands in; instances believed in one round count for
patterns in the next. Identifiers that no expression knows but reliable patterns surround are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, small_side, written

#: The kinds in order, and the expressions of the seeds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"  # before the @ of a mail address
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match from within a run of digits would start with the run
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, MARK, WORD = re.compile(r"[0-9]"), re.compile(r"[0-9]+|@"), re.compile(r"\w+|[^\w\s]")
EDGES, REACH, SHORTEST = ".,;:!?()[]{}<>\"'", 60, 5  # REACH: characters looked at first, more where words are longer
FIRST, LATER = re.compile(r"\(?\+?\(?[0-9][0-9()-]*"), re.compile(r"\(?[0-9][0-9()-]*[.,;:!?\]}>]*")
DIGITS = 19  # of the longest identifier, a card
#: What a kind looks like, beyond its expression: a local part and some "at"; groups with separators; masked or long
#: numbers; digits with the punctuation of numbers.
LIKE_EMAIL = re.compile(r"[^\W_][^@]{0,63}?(?:@|[\[({<]at[\])}>]|[ _.-]at[ _.-])[^\W_]", re.I)
LIKE_IP = re.compile(r"[0-9a-f]*+(?:[.:-][0-9a-f]*+){3,}", re.I)
LIKE_PHONE, MASKED = re.compile(r"[0-9 ()+./-]+(?: ?(?:x|ext)\.? ?[0-9]+)?|[0-9 ()+./-]+-ext", re.I), re.compile(r"[0-9xX*#. -]+")
LONGEST_LIKE = 100
ROUNDS, SUPPORT, SURE, COMBINED, UNKNOWN, RARE = 3, 3, 0.8, 0.6, 0.5, 16
CANDIDATE = "array<struct<start: int, finish: int, kind: int, instance: bigint, patterns: array<bigint>>>"


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of LOCAL+ @ DOMAIN, leftmost and non-overlapping. Each @ looks back over what stands between it
    and the one before, or the last match, so a text is read once however long its runs are."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def looks(text: str) -> int:
    """Bits of the kinds that a token or a run of digit groups looks like."""
    if len(text) > LONGEST_LIKE:
        return 0
    n = len(digits(text))
    masked = MASKED.fullmatch(text) and (n >= 8 or (n >= 4 and any(c in "xX*#" for c in text)))
    return bool(LIKE_EMAIL.search(text)) | 2 * bool(n and LIKE_IP.fullmatch(text)) | 4 * bool(masked) | 8 * bool(6 <= n <= 18 and LIKE_PHONE.fullmatch(text))


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all seed entities, leftmost and non-overlapping within each kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            number = digits(m[0])
            if 12 <= len(number) <= 19 and luhn(number):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def others(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether patterns count) of what looks like an identifier and touches no seed.

    That is each token with a digit or an at-sign, without punctuation at its edges, and each run of digit groups (with
    brackets and hyphens) across single spaces, cut only where it has more digits than any identifier. Shorter runs of
    neighbouring groups come without patterns, to be compared with what is known from elsewhere.
    """
    out, chain, done, k = [], [], 0, 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        low, high = m.start(), m.end()
        while low > done and not text[low - 1].isspace() and text[low - 1] not in "=:\"'":
            low -= 1
        while high < len(text) and not text[high].isspace() and text[high] not in "=\"'":
            high += 1
        first, done = low, high
        while low < high and text[low] in EDGES:
            low += 1
        while low < high and text[high - 1] in EDGES:
            high -= 1
        while k < len(found) and found[k][2] <= low:
            k += 1
        free, j = True, k
        while free and j < len(found) and found[j][0] < high:
            free, j = found[j][2] <= low, j + 1
        if free and high - low >= SHORTEST:
            out.append((low, high, True))
        if not (free and chain and first == chain[-1][2] + 1 and text[first - 1] == " " and LATER.fullmatch(text, first, done)):
            out += runs(text, chain)
            chain = []
        if free and (chain or FIRST.fullmatch(text, first, done)):
            chain.append((low, high, done))
            if text[done - 1] not in "0123456789)":
                out += runs(text, chain)
                chain = []
    return sorted(out + runs(text, chain))


def runs(text: str, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is one of the longest from the left) of runs of two or more of the chain's groups."""
    out, fresh = [], 0
    sizes = [len(digits(text[a:b])) for a, b, _ in chain]
    for i in range(len(chain) - 1):
        j, total = i, sizes[i]
        while j + 1 < len(chain) and total + sizes[j + 1] <= DIGITS:
            j += 1
            total += sizes[j]
            low, high = chain[i][0], chain[j][1]
            inner = text[low:high]
            low -= low > 0 and text[low - 1] == "(" and inner.count(")") > inner.count("(")
            high += text[high : high + 1] == ")" and inner.count("(") > inner.count(")")
            if high - low >= SHORTEST:
                out.append((low, high, i == fresh and (j + 1 == len(chain) or total + sizes[j + 1] > DIGITS)))
        if i == fresh:
            fresh = j + 1
    return out


def patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of two words before, one before and one after, two after, and one before; words are whole."""
    reach, left = REACH, WORD.findall(text[max(0, start - REACH) : start])
    while reach < start and len(left) < 3:  # the first word may be cut, unless the text starts with it
        reach *= 4
        left = WORD.findall(text[max(0, start - reach) : start])
    left = [w.lower() for w in left[-2:]]
    right = [m[0].lower() for m in islice(WORD.finditer(text, end), 2)]
    left, right = ["^"] * (2 - len(left)) + left, right + ["$"] * (2 - len(right))
    forms = (f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}", f"_ {right[0]} {right[1]}", f"{left[1]} _")
    return [xxhash.xxh3_64_intdigest(f.encode()) - (1 << 63) for f in forms]


def candidates(docs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, what is carried, part, row (in the writing task), found: seeds and identifier-like tokens, whose kind is
    -1 less the bits of what they look like.

    Written to the shared folder; holds no text but places and hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            made = []
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py() or ""
                got = seeds(text)
                every = [(*g, True) for g in got] + [(a, -1 - looks(text[a:b]), b, whole) for a, b, whole in others(text, got)] if got or MARK.search(text) else []
                made.append([{"start": a, "finish": b, "kind": k, "instance": xxhash.xxh3_64_intdigest(text[a:b].lower().encode()) - (1 << 63), "patterns": patterns(text, a, b) if whole else []} for a, k, b, whole in every])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(made, kind)], names=[*batch.schema.names[:-1], "part", "row", "found"])
            row += n

    given = docs.select(F.col("doc_id").cast("long"), *carried, "text")
    fields = T.StructType([*given.schema.fields[:-1], *T._parse_datatype_string(f"part int, row long, found {CANDIDATE}").fields])
    return written(given.mapInArrow(run, fields), "pii-candidates")


def discovered(places: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE, combined: float = COMBINED, unknown: float = UNKNOWN, rare: int = RARE) -> DataFrame:
    """instance, kind, score of identifiers where no expression finds them, from places(kind, instance, patterns).

    Edges of the graph are distinct, so copies of a text add nothing. A pattern needs ``support`` distinct instances.
    Its score for a kind is the belief in its instances of that kind over one plus their number, plus the number of
    seeds of other kinds and, by the weight ``unknown``, of unknown instances that don't look like the kind; so few
    instances never give certainty. Unknown ones that do look like it count neither way, but a pattern with more than
    ``rare`` of them for each that is known is not scored until more is known. A pattern without seeds is scored once
    instances it surrounds are believed. Patterns of ``combined`` and more count for their instances, whose score is
    the complement of the product of the patterns' doubts; those of ``sure`` and more are believed. An instance that is
    a seed somewhere is known with score 1 where the expressions fail, too, and counts as a seed of the patterns there.
    Ties between kinds go to the first.
    """
    of_kind = F.min(F.when(F.col("kind") >= 0, F.col("kind")))
    both = places.groupBy("instance").agg(F.min("kind").alias("least"), of_kind.alias("seed_kind")).filter("least < 0 AND seed_kind >= 0")
    known_elsewhere = small_side(both.select("instance", "seed_kind").checkpoint(), 200_000)
    found = places.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    edges = found.join(known_elsewhere, "instance", "left").select("pattern", "instance", F.when(F.col("kind") < 0, F.coalesce("seed_kind", "kind")).otherwise(F.col("kind")).alias("kind"))
    unlike = lambda k: (F.col("kind") < 0) & (F.shiftright(-1 - F.col("kind"), k) % 2 == 0)
    total = lambda each: F.array(*[F.sum(each(k).cast("int")) for k in range(len(KINDS))])
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n"), total(lambda k: F.col("kind") == k).alias("seeds"), total(unlike).alias("unlike")).filter(F.col("n") >= support)
    open_ones = F.col("n") > F.reduce("seeds", F.lit(0).cast("long"), lambda a, x: a + x)  # patterns of seeds alone find nothing
    graph = written(hot_join(edges.filter("kind < 0"), wide.filter(open_ones).checkpoint(), ["pattern"], "n"), "pii-graph")
    believed = None
    for _ in range(rounds):
        blank = F.lit(None).cast("int").alias("now"), F.lit(0.0).alias("score")
        given = graph.select("*", *blank) if believed is None else graph.join(small_side(believed.withColumnRenamed("kind", "now"), 200_000), "instance", "left")
        sums = [F.sum(F.when(F.col("now") == k, F.struct(F.col("score").alias("b"), F.lit(1).alias("c"), unlike(k).cast("int").alias("u"))[f]).otherwise(0)).alias(f"{f}{k}") for k in range(len(KINDS)) for f in "bcu"]
        held = given.groupBy("pattern").agg(F.first("n").alias("n"), F.first("seeds").alias("seeds"), F.first("unlike").alias("unlike"), *sums)
        scores = []
        for k in range(len(KINDS)):
            mine = F.col("seeds")[k] + F.col(f"c{k}")
            seeded = F.reduce("seeds", F.lit(0).cast("long"), lambda a, x: a + x)
            against = seeded - F.col("seeds")[k] + unknown * (F.col("unlike")[k] - F.col(f"u{k}"))
            like = F.col("n") - seeded - F.col("unlike")[k]
            score = F.when((mine > 0) & (mine * rare >= like), (F.col("seeds")[k] + F.col(f"b{k}")) / (1 + mine + against)).otherwise(0.0)
            scores.append(F.struct(F.lit(k).alias("kind"), score.alias("score")))
        scored = held.select("pattern", "n", F.inline(F.array(*scores))).filter(F.col("score") >= combined)
        doubts = hot_join(graph.select("pattern", "instance"), scored.checkpoint(), ["pattern"], "n").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.col("score"))))).alias("score"))
        best = doubts.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m")).select("instance", (-F.col("m.k")).alias("kind"), F.col("m.score").alias("score"))
        believed = best.filter(F.col("score") >= sure).checkpoint()
    certain = known_elsewhere.select("instance", F.col("seed_kind").alias("kind"), F.lit(1.0).alias("score"))
    return certain if believed is None else believed.unionByName(certain)


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined, of an array of (start, kind, finish)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["finish"].cast("string"))), ",")


def find_pii(docs: DataFrame, *, carried: Sequence[str] = (), **parameters) -> DataFrame:
    """A row a document: doc_id, the columns named in carried, base and added: arrays of (start, kind, finish).

    Places are code points, kinds those of KINDS. Null and empty texts have no spans. Rows that repeat are searched as
    often as they come. Spans of different kinds may overlap; added ones touch no base span, and none lies inside
    another. An empty table gives no rows. Other columns are not looked at.
    """
    rows = candidates(docs, carried)
    flat = rows.select("part", "row", F.inline("found"))
    fresh = discovered(flat.select("kind", "instance", "patterns"), **parameters)
    hits = flat.filter("kind < 0").select("part", "row", "start", "finish", "instance").join(small_side(fresh.select("instance", "kind"), 200_000), "instance")
    before = Window.partitionBy("part", "row").orderBy("start", F.desc("finish")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("reached", F.max("finish").over(before)).filter("reached IS NULL OR finish > reached")
    added = hits.groupBy("part", "row").agg(F.collect_list(F.struct("start", "kind", "finish")).alias("added")).checkpoint()
    base = F.transform(F.filter("found", lambda f: f["kind"] >= 0), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["finish"].alias("finish")))
    both = rows.join(small_side(added, 100_000), ["part", "row"], "left")
    return both.select("doc_id", *carried, base.alias("base"), F.coalesce("added", F.array().cast("array<struct<start: int, kind: int, finish: int>>")).alias("added"))


def pii_digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added), n_added."""
    found = find_pii(docs, **parameters)
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
