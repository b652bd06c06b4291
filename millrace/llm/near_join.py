"""N-gram Jaccard join: Bayesian pruning of candidate pairs, exact verification.

Texts that are equal word for word form a class. Every class has MinHash values of its runs of five words. Classes that
share a band of values are to be examined together. Where few classes hang together by their bands (a family: connected
components over bands, which narrow rows of keys settle), the family is one block. Where bands chain more of them than
FAMILY, each band is a block of its own, bands of the same members are one, and a pair counts in the first block that
holds it; so work follows the sizes of bands, not those of chains. Blocks are cut into square tiles of bounded size.
In a tile MinHash values are compared a few at a time, a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below the tolerance, and the rest is verified on the exact sets of word runs. A
tile returns how many links each class has and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import hot_join, shared_dir, small_side, written
from .simhash import WORDS, term_hashes

TERM, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, AT_ONCE = 38, 5, 19
TILE, TILE_BYTES, FAMILY = 128, 6_000_000, 4096
PRIME = np.uint64(0xD6E8FEB86659FD93)


def multipliers(n: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS = multipliers(BANDS * ROWS)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words (of all words where there are fewer)."""
    return np.unique(term_hashes(WORDS.of(text.split()), TERM))


def minhash(terms: np.ndarray) -> np.ndarray:
    """One 32-bit value for each factor: the high half of the least product."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(terms), 4096):
        least = np.minimum(least, (terms[k : k + 4096, None] * FACTORS[None, :]).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(4)
def least_matches(threshold: float, tolerance: float, values: int, at_once: int) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed): fewer make similarity >= threshold less likely than the tolerance.

    The posterior under a uniform prior after m matches of n is Beta(m + 1, n - m + 1); its upper tail is a binomial
    sum: P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(at_once, values + 1, at_once):
        tail = 0.0
        for m in range(n + 1):
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
            if tail >= tolerance:
                out.append((n, m))
                break
    return tuple(out)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_terms, n_bytes, bands: written to the shared folder. The key is that of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands = [], []
            for x in batch.column(2):
                terms = shingles(x.as_py())
                sizes.append(len(terms))
                folded = minhash(terms).reshape(BANDS, ROWS).astype(np.uint64)
                keys = term_hashes_of_rows(folded)
                bands.append(keys if len(terms) else keys[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_terms", "bands"])

    return written(keyed(docs).mapInArrow(run, "doc_id long, text_key string, n_terms int, bands array<bigint>"), "near-sketches")


def term_hashes_of_rows(folded: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    keys = np.arange(len(folded), dtype=np.uint64) + np.uint64(1)
    for k in range(folded.shape[1]):
        keys = (keys ^ (keys >> np.uint64(29))) * PRIME + folded[:, k]
    keys ^= keys >> np.uint64(32)
    return (keys * PRIME).view(np.int64)


def text_key(text: Column) -> Column:
    """One key for texts of the same words in the same order; null text counts as empty."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def examine(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float, tolerance: float, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into left and right, or left alone with i < j) whose similarity reaches the threshold.

    With ``band``, only pairs whose first block in common is that band's.
    """
    cut = lambda x, name, kind: [np.frombuffer(b, kind) for b in x[name]]
    a = cut(left, "terms", np.uint64)
    b = a if right is None else cut(right, "terms", np.uint64)
    marks_a = np.stack(cut(left, "marks", np.uint32))
    marks_b = marks_a if right is None else np.stack(cut(right, "marks", np.uint32))
    i, j = np.triu_indices(len(a), 1) if right is None else (x.ravel() for x in np.indices((len(a), len(b))))
    size_a, size_b = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    small, large = np.minimum(size_a[i], size_b[j]), np.maximum(size_a[i], size_b[j])
    fits = small >= threshold * large  # no larger set can be so similar
    i, j = i[fits], j[fits]
    if band is not None:
        blocks_a = np.stack(left["blocks"].tolist())
        blocks_b = blocks_a if right is None else np.stack(right["blocks"].tolist())
        stay = ~((blocks_a[i, :band] == blocks_b[j, :band]) & (blocks_a[i, :band] != 0)).any(axis=1)
        i, j = i[stay], j[stay]
    same, done = np.zeros(len(i), np.int32), 0
    for n, needed in least_matches(threshold, tolerance, len(FACTORS), AT_ONCE):
        if not len(i):
            break
        for low in range(0, len(i), 100_000):
            same[low : low + 100_000] += (marks_a[i[low : low + 100_000], done:n] == marks_b[j[low : low + 100_000], done:n]).sum(axis=1, dtype=np.int32)
        stay = same >= needed
        i, j, same, done = i[stay], j[stay], same[stay], n
    if not len(i):
        return i, j
    rows_a, rows_b = np.unique(i), np.unique(j)
    if 16 * len(i) < len(rows_a) * len(rows_b):
        both = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        shared = overlaps([a[k] for k in rows_a], [b[k] for k in rows_b])
        both = shared[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)]
    exact = both >= threshold * (size_a[i] + size_b[j] - both) - 1e-9
    return i[exact], j[exact]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the 0/1 matrices of the terms that both sides have."""
    every_a, every_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(every_a, every_b)
    out = np.zeros((len(a), len(b)), np.float64)
    place = lambda every, sets: (np.searchsorted(common, every), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (at_a, row_a), (at_b, row_b) = place(every_a, a), place(every_b, b)
    if not len(common):
        return out
    for at, row, every in ((at_a, row_a, every_a), (at_b, row_b, every_b)):
        at[at == len(common)] = 0
        row[common[at] != every] = -1
    for low in range(0, len(common), 2048):
        x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        for m, at, row in ((x, at_a, row_a), (y, at_b, row_b)):
            here = (row >= 0) & (at >= low) & (at < low + 2048)
            m[row[here], at[here] - low] = 1
        out += x @ y.T
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the links, those that first join two parts."""
    parent = list(range(n))
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        u, v = x, y
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


def tile_links(tiles: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b, links: per tile and class (b null) the documents it is linked to, and forest links (links null)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "text_key"], ignore_index=True)
        left, right = group[group["side"] == 0].reset_index(drop=True), group[group["side"] == 1].reset_index(drop=True)
        alone = bool(group["x"].iloc[0] == group["y"].iloc[0])
        band = int(group["band"].iloc[0])
        if not len(left) or not (alone or len(right)):
            return pd.DataFrame({"a": pd.array([], "string"), "b": pd.array([], "string"), "links": pd.array([], "Int64")})
        i, j = examine(left, None if alone else right, threshold, tolerance, band if band >= 0 else None)
        keys = left["text_key"].tolist() if alone else left["text_key"].tolist() + right["text_key"].tolist()
        docs = left["docs"].to_numpy() if alone else np.concatenate([left["docs"].to_numpy(), right["docs"].to_numpy()])
        j = j if alone else j + len(left)
        links = np.bincount(i, docs[j], len(keys)) + np.bincount(j, docs[i], len(keys))
        some = np.flatnonzero(links)
        joined = forest(len(keys), i, j)
        a = [*(keys[x] for x in some), *(keys[x] for x, _ in joined)]
        b = [*[None] * len(some), *(keys[y] for _, y in joined)]
        n = [*links[some].astype(np.int64).tolist(), *[None] * len(joined)]
        return pd.DataFrame({"a": pd.array(a, "string"), "b": pd.array(b, "string"), "links": pd.array(n, "Int64")})

    return tiles.groupBy("block", "x", "y").applyInPandas(run, "a string, b string, links long")


def dealt(blocks: DataFrame) -> DataFrame:
    """blocks(block, band, text_key, n_terms) with chunk and chunks: a tile is two chunks of bounded size of a block."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n_terms") * 8 / TILE_BYTES)).cast("int").alias("chunks")).checkpoint()
    return hot_join(blocks, sizes, ["block"], "n").withColumn("chunk", F.pmod(F.xxhash64("text_key", F.lit("chunk")), F.col("chunks")).cast("int")).drop("n")


def block_members(members: DataFrame, *, family: int) -> tuple[DataFrame, DataFrame | None]:
    """(blocks: block, band, text_key, n_terms; blocks of a text_key by band as longs, 0 for none) of members(family,
    text_key, n_terms, bands). Band is -1 where a family is a block; then there are no bands to compare."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n")).checkpoint()
    whole = members.select("family", F.lit(-1).alias("band"), "text_key", "n_terms").withColumnRenamed("family", "block")
    wide = sizes.filter(F.col("n") > family)
    if wide.isEmpty():
        return whole, None
    wide = F.broadcast(wide.select("family"))  # at most one in ``family`` rows; each has that many members
    chained = members.join(wide, "family").select("text_key", "n_terms", F.posexplode("bands").alias("band", "key"))
    groups = chained.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("text_key").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("b")).filter("n > 1")
    kept = groups.groupBy("n", "a", "b").agg(F.min(F.struct("band", "key")).alias("first")).select("first.band", "first.key", "n").checkpoint()
    held = written(hot_join(chained, kept, ["band", "key"], "n").drop("n"), "near-chained")
    own = held.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("m")).select("text_key", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))).alias("blocks"))
    blocks = held.select(F.concat_ws(":", "band", "key").alias("block"), "band", "text_key", "n_terms")
    return whole.join(wide.withColumnRenamed("family", "block"), "block", "left_anti").unionByName(blocks), own


def near_classes(docs: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, family: int = FAMILY) -> DataFrame:
    """A row a document: doc_id, class_id, n_links, text_class, text_key, head_key.

    text_class is the least doc_id with the same words; text_key tells texts of different words apart, and head_key is
    that of the class's head, so that rows which share a doc_id but not a text keep apart; class_id the least doc_id
    among all documents that links of similarity ``threshold`` or more join, directly or in steps; n_links the other
    documents that such a link, or the same words, join to this one directly. A text of fewer than five words is one
    run; null and empty texts have no runs and are linked to their like only. Null doc_ids count as the least long and
    stay null. Rows that repeat count as documents of their own. An empty table gives no rows. Only doc_id and text are
    looked at. ``family`` is the most classes that are examined as one block; results don't depend on it but for pairs
    that no band finds.
    """
    shared_dir(docs.sparkSession)
    least = F.lit(-(2**63))
    rows = sketches(docs).withColumn("at", F.coalesce("doc_id", least))
    classes = written(rows.groupBy("text_key").agg(F.min("at").alias("node"), F.count("*").alias("docs"), F.first("bands").alias("bands"), F.first("n_terms").alias("n_terms")), "near-classes")
    banded = classes.select("text_key", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("text_key").alias("head"), F.count("*").alias("n")).filter("n > 1").checkpoint()
    edges = hot_join(banded, met, ["band"], "n").select(F.col("text_key").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()
    families = components(edges).select(F.col("node").alias("text_key"), F.col("label").alias("family"))
    members = written(classes.join(families, "text_key"), "near-members")
    blocks, own = block_members(members, family=family)
    heads = keyed(docs).withColumn("at", F.coalesce("doc_id", least)).join(small_side(members.select("text_key", F.col("node").alias("at"), "docs"), 200_000), ["text_key", "at"])
    terms = written(with_terms(heads), "near-terms")
    if terms.count() > members.count():  # rows that repeat, with their doc_id, in several tasks
        terms = terms.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("docs", "marks", "terms")])
    terms = terms.withColumn("blocks", F.lit(None).cast("array<bigint>")) if own is None else terms.join(own, "text_key", "left")
    placed = dealt(blocks).select("text_key", "block", "band", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    tiles = placed.select("text_key", "block", "band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), (F.col("chunk") > F.col("other")).cast("int").alias("side")).checkpoint()
    found = written(tile_links(terms.join(small_side(tiles, 200_000), "text_key"), threshold, tolerance), "near-links")
    degrees = found.filter("links IS NOT NULL").groupBy(F.col("a").alias("text_key")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("text_key"), "label")
    linked = members.select("text_key", "node").join(joined, "text_key").join(degrees, "text_key", "left")
    linked = written(linked, "near-linked")
    first = linked.groupBy("label").agg(F.min(F.struct("node", "text_key")).alias("head"), F.count("*").alias("n")).checkpoint()
    named = hot_join(linked, first, ["label"], "n", hot=100_000).select("text_key", F.col("head.node").alias("class_id"), F.col("head.text_key").alias("head_key"), "links").checkpoint()
    per_class = written(classes.select("text_key", "node", "docs").join(small_side(named, 200_000), "text_key", "left").select("text_key", F.col("node").alias("text_class"), F.coalesce("class_id", "node").alias("class_id"), F.coalesce("head_key", "text_key").alias("head_key"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), "docs"), "near-named")
    named_rows = hot_join(rows.select("doc_id", "text_key"), per_class, ["text_key"], "docs", hot=100_000)
    return named_rows.select("doc_id", "class_id", "n_links", "text_class", "text_key", "head_key")


def with_terms(heads: DataFrame) -> DataFrame:
    """text_key, docs, marks (MinHash values) and terms (sorted 64-bit hashes), binary, of each class's head.

    A head that is there several times (rows that repeat with their doc_id) is given once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                rows = []
                for key, docs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key not in seen:
                        seen.add(key)
                        terms = shingles(text)
                        rows.append((key, docs, minhash(terms).tobytes(), terms.tobytes()))
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["text_key", "docs", "marks", "terms"])

    return heads.select("text_key", "docs", "text").mapInArrow(run, "text_key string, docs long, marks binary, terms binary")
