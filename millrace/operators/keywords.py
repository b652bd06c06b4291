"""Keywords: word spans, phrase counts, hybrid ranking over a corpus, weights of grouped keywords, review scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python import shares
from ..session import shared_dir, stored
from .relational import hot_join

#: Weights of the hybrid importance and of keyword statistics.
TF_IDF_SHARE, TF_SHARE, TITLE_SHARE, FULL_SCORE = 0.5, 0.3, 0.2, 5.0
HISTORY_RATE, MOST_HISTORY, REPEAT_PENALTY, SINGLE_PENALTY, TARGET_BOOST = 0.03, 0.1, 0.92, 0.8, 1.15
HALF_WAY = 1e-9
#: Bytes of text whose phrases a task counts in one go; a longer text is counted alone.
AT_ONCE = 1 << 24


def windows(tokens: Column, low: int = 2, high: int = 3) -> Column:
    """Array of all runs of ``low`` to ``high`` tokens, as (start, width, text)."""
    per_width = [
        F.when(F.size(tokens) >= w, F.transform(F.sequence(F.lit(0), F.size(tokens) - w), _run(tokens, w))).otherwise(F.array().cast("array<struct<start: int, width: int, span: string>>"))
        for w in range(low, high + 1)
    ]
    return F.flatten(F.array(*per_width))


def _run(tokens: Column, width: int):
    return lambda i: F.struct(i.cast("int").alias("start"), F.lit(width).alias("width"), _joined(tokens, i, width).alias("span"))


def _joined(tokens: Column, i: Column, width: int) -> Column:
    return F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(width)])


def window_summary(tokens: Column, low: int = 2, high: int = 3) -> Column:
    """Array of (width, n, last_span, last_start), of the widths that have windows: how many, and the last by text and place."""
    texts = lambda w: F.transform(F.sequence(F.lit(0), F.size(tokens) - w), lambda i: _joined(tokens, i, w))
    each = [F.when(F.size(tokens) >= w, F.struct(F.lit(w).alias("width"), (F.size(tokens) - w + 1).cast("long").alias("n"), F.array_max(texts(w)).alias("last_span"), (F.size(tokens) - w).alias("last_start"))) for w in range(low, high + 1)]
    return F.array_compact(F.array(*each))


#: Pairs of tags that two words of a phrase may have, and the longest phrase.
PHRASE_TAGS, MOST_PHRASE = (("NNG", "NNG"), ("NNP", "NNP"), ("SL", "NNG"), ("NNG", "SL"), ("SL", "SN")), 40


def tagged_phrases(tokens: Column, stop: tuple[str, ...] = ()) -> Column:
    """Array of the phrases of tokens (form, tag): each word, pairs whose tags may stand together, and runs of three;
    words of ``stop`` don't count."""
    kept = F.filter(tokens, lambda t: ~t["form"].isin(*stop)) if stop else tokens
    shifted = lambda k: F.slice(kept, k + 1, F.greatest(F.size(kept) - k, F.lit(0)))
    allowed = lambda a, b: F.concat_ws(" ", a["tag"], b["tag"]).isin(*[" ".join(p) for p in PHRASE_TAGS])
    pairs = F.zip_with(kept, shifted(1), lambda a, b: F.when(b.isNotNull() & allowed(a, b), F.concat_ws(" ", a["form"], b["form"])))
    threes = F.zip_with(F.zip_with(kept, shifted(1), lambda a, b: F.struct(a["form"].alias("a"), b["form"].alias("b"))), shifted(2), lambda x, c: F.when(c.isNotNull(), F.concat_ws(" ", x["a"], x["b"], c["form"])))
    short = lambda phrases: F.filter(phrases, lambda p: p.isNotNull() & (F.length(p) <= MOST_PHRASE))
    return F.concat(F.transform(kept, lambda t: t["form"]), short(pairs), short(threes))


def _phrases(texts: pa.Array, width: int) -> tuple[pa.Array, np.ndarray]:
    """(phrases of ``width`` neighbouring words of a text, each once, how many of each)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    held = pc.not_equal(flat, "")
    coded, row = flat.filter(held).dictionary_encode(), row[held.to_numpy(zero_copy_only=False)]
    code, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    first = np.flatnonzero(row[: max(len(row) - width + 1, 0)] == row[width - 1 :])
    runs, at = [], code[first]
    for k in range(1, width):  # a run's number is made of the number of the run before and the next word's
        if k > 1:
            run, at = np.unique(at, return_inverse=True)
            runs.append(run)
        at = at * size + code[first + k]
    at, n = np.unique(at, return_counts=True)
    parts = []
    for k in range(1, width):
        at, word = np.divmod(at, size)
        parts.append(word)
        at = runs.pop()[at] if runs else at
    words = (at, *reversed(parts))
    return pc.binary_join_element_wise(*[coded.dictionary.take(pa.array(x)) for x in words], " "), n


def phrase_counts(docs: DataFrame, text: Column, width: int, *, at_once: int = AT_ONCE) -> DataFrame:
    """phrase, n over the corpus: ``width`` words in a row, between white space of ASCII.

    A task counts the phrases of some ``at_once`` bytes of text at a time. Most phrases are rare, so what it has counted
    goes straight to the phrase's partition: no task holds a table of all phrases of its input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in shares(pc.binary_length(batch.column(0)), at_once):
                phrases, count = _phrases(batch.column(0).slice(at, n), width)
                yield pa.RecordBatch.from_arrays([phrases, pa.array(count)], names=["phrase", "n"])

    return docs.select(text.alias("text")).mapInArrow(run, "phrase string, n long").repartition("phrase").groupBy("phrase").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, doc: str, tokens: Column, title: Column) -> DataFrame:
    """doc, terms: an array of (term, tf, in_title) a document, counted in its row: runs of its sorted tokens.

    Only rows that share their document are shuffled.
    """
    rows = docs.select(F.col(doc), F.array_sort(F.coalesce(tokens, F.array().cast("array<string>"))).alias("w"), title.alias("title"))
    marked = rows.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get(F.col("w"), i - 1)), i)), lambda i: i.isNotNull()))
    run = lambda i, k: F.struct(F.get(F.col("w"), i).alias("term"), (F.coalesce(F.get(F.col("at"), k + 1), F.size("w")) - i).cast("long").alias("tf"), F.contains(F.col("title"), F.get(F.col("w"), i)).cast("int").alias("in_title"))
    each = stored(marked.select(doc, F.transform("at", run).alias("terms")), "postings")
    repeated = each.groupBy(doc).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(doc).alias("again")).checkpoint()
    if repeated.isEmpty():
        return each
    same = F.col(doc).eqNullSafe(F.col("again"))
    parts = each.join(repeated, same, "left_semi").select(doc, F.inline("terms")).groupBy(doc, "term").agg(F.sum("tf").alias("tf"), F.max("in_title").alias("in_title"))
    return each.join(repeated, same, "left_anti").unionByName(parts.groupBy(doc).agg(F.collect_list(F.struct("term", "tf", "in_title")).alias("terms")))


def hybrid_ranks(docs: DataFrame, doc: str, tokens: Column, title: Column, top: int = 10) -> DataFrame:
    """doc, term, tf, importance, rank of each document's best ``top`` terms.

    importance = 0.5 min(1, tf idf / 5) + 0.3 min(1, tf / 5) + 0.2 in the title, with idf = ln((1 + N) / (1 + df)) + 1
    over all documents. Postings are counted in the document's row and written once; df, an aggregate of them, is
    broadcast while it is small, and beyond that for its common terms, so that postings of rare terms alone are
    shuffled. A document's other postings stay together, and its best go on to the last rank.
    """
    shared_dir(docs.sparkSession)
    terms = postings(docs, doc, tokens, title)
    df = stored(terms.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    n = docs.agg(F.count("*")).scalar()
    scored = hot_join(terms.select(doc, F.inline("terms")), df, ["term"], "df", small=1_000_000)
    idf = F.ln((1 + n) / (1 + F.col("df"))) + 1
    weight = TF_IDF_SHARE * F.least(F.lit(1.0), F.col("tf") * idf / FULL_SCORE) + TF_SHARE * F.least(F.lit(1.0), F.col("tf") / FULL_SCORE) + TITLE_SHARE * F.col("in_title")
    ranked = scored.withColumn("importance", F.round(weight, 6)).withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("importance"), "term")))
    return ranked.filter(F.col("rank") <= top).select(doc, "term", "tf", "importance", "rank")


def keyword_counts(rows: DataFrame, scope: str, words: Column, score: Column) -> DataFrame:
    """scope, keyword, batch_count, score_sum: a keyword counts once a row."""
    each = rows.select(F.col(scope), F.explode(F.array_distinct(words)).alias("keyword"), score.alias("score"))
    return each.groupBy(scope, "keyword").agg(F.count("*").alias("batch_count"), F.sum("score").alias("score_sum"))


def keyword_weights(counts: DataFrame, history: Column, is_target: Column, jitter: Column | float = 1.0) -> DataFrame:
    """counts with average_score, history_boost and final_weight, to four places.

    A billionth is added before rounding, so that half-way values go up whatever the order in which scores were summed.
    """
    average = F.col("score_sum") / F.col("batch_count")
    boost = F.least(F.log1p(history) * HISTORY_RATE, F.lit(MOST_HISTORY))
    weight = F.col("batch_count") * average * (1 + boost)
    weight = weight * F.when(history > 0, REPEAT_PENALTY).otherwise(1.0) * F.when((F.col("batch_count") == 1) & (history == 0), SINGLE_PENALTY).otherwise(1.0) * F.when(is_target, TARGET_BOOST).otherwise(1.0)
    return counts.withColumns({"average_score": F.round(average + HALF_WAY, 4), "history_boost": F.round(boost + HALF_WAY, 4), "final_weight": F.round(weight * jitter + HALF_WAY, 4)})


def candidate_pool(weights: DataFrame, scope: str, ratio: Column, most: int, *, least_ratio: float = 0.5, near_top: float = 0.55) -> DataFrame:
    """Per scope the keywords of ratio >= least_ratio or weight >= near_top of the best, at most max(3 most, 8)."""
    whole = Window.partitionBy(scope)
    near = (ratio >= least_ratio) | (F.col("final_weight") >= near_top * F.max("final_weight").over(whole))
    picked = weights.withColumn("near", near).filter("near").drop("near")
    return picked.withColumn("pool_rank", F.row_number().over(whole.orderBy(F.desc("final_weight"), "keyword"))).filter(F.col("pool_rank") <= max(3 * most, 8))


def review_score(overlap: Column, targets: Column, positive: Column, score: Column, content: Column) -> Column:
    return overlap * 10 + targets * 4 + F.when(positive, 2).otherwise(0) + F.coalesce(score, F.lit(0.0)) + F.least(F.length(content), F.lit(300)) / 300


def overlap_score(words: Column, selected: list[str]) -> Column:
    """3 for each pair of equal words, 1 where one holds the other."""
    pairs = F.transform(words, lambda w: sum((F.when(w == s, 3).when(F.contains(w, F.lit(s)) | F.contains(F.lit(s), w), 1).otherwise(0) for s in selected), F.lit(0)))
    return F.reduce(pairs, F.lit(0), lambda a, b: a + b)


def hashed_draw(key: Column, seed: str) -> Column:
    """A number below 2^32 that key and seed fix: the first bits of their md5."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), F.lit(8)), 16, 10).cast("long")


def weighted_sample(rows: DataFrame, scope: str, key: Column, weight: Column, k: int, seed: str = "") -> DataFrame:
    """k rows a scope, drawn without replacement by weight: the smallest -ln(u) / weight, u fixed by key and seed."""
    u = (hashed_draw(key, seed) + 1) / float(2**32 + 1)
    drawn = rows.withColumn("draw", -F.ln(u) / F.greatest(weight, F.lit(0.01)))
    return drawn.withColumn("draw_rank", F.row_number().over(Window.partitionBy(scope).orderBy("draw", key))).filter(F.col("draw_rank") <= k).drop("draw")


def reservoir(rows: DataFrame, key: Column, k: int, seed: str = "") -> DataFrame:
    """k rows of equal chance that the seed fixes: a bounded top-k over hashes."""
    return rows.orderBy(hashed_draw(key, seed), key).limit(k)
