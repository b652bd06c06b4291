"""Quality rules: robust multivariate outliers.

Each text has a vector of transformed statistics. For every language and source the minimum-covariance-determinant
estimate of mean and covariance is found by concentration steps: the half of the texts nearest to the current
estimate gives the next one. Two starts are followed, and the smaller determinant counts. Texts whose Mahalanobis distance from their group's estimate is too large are rejected.
Everything is DataFrame expressions; the Cholesky factor of the small covariance matrix is unrolled into columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_side, written

SPACE = r"[ \t-\r]"
#: Name and smallest spread of each statistic: a group of texts without any variation still has room for some.
STATISTICS = {"word_length": 0.1, "symbols": 0.2, "same_lines": 0.2, "repeats": 0.2, "capitals": 0.15}
STEPS, LEAST_GROUP, CUT = 4, 40, 36.0  # a chi-squared variable of five degrees exceeds 36 once in a million


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that the text holds twice or more, the first included.

    Windows are compared by a 64-bit hash. Only texts with some window twice sort their windows with positions.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        starts = let(placed, lambda s: F.array_distinct(F.flatten(F.filter(twice(s), lambda x: x.isNotNull()))))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def text_statistics(docs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang, source, what is carried, the base counts, n_chars, n_lines, n_capitals; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    letters = F.regexp_replace(text, f"{SPACE}+", "")
    cast = lambda c: c.cast("long")
    keys = list(dict.fromkeys(["doc_id", "lang", "source", *carried]))
    base = docs.select(*keys, F.length(text).alias("n_chars"), F.length(letters).alias("word_chars"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).alias("n_symbols"), (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).alias("n_capitals"), let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("w"), let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"))
    return base.select(*keys, cast(F.col("w.n")).alias("n_words"), cast(F.col("word_chars")).alias("word_chars"), cast(F.col("n_symbols")).alias("n_symbols"), cast(F.col("l.d")).alias("n_dup_lines"), cast(F.col("w.r")).alias("n_repeat_words"), cast(F.col("l.n")).alias("n_lines"), cast(F.col("n_capitals")).alias("n_capitals"), cast(F.col("n_chars")).alias("n_chars"))


def vector() -> list[Column]:
    """The transformed statistics, in the order of STATISTICS; of a text without words all are 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.asin(F.sqrt(F.least(F.col(a) / F.col(b), F.lit(1.0))))).otherwise(0.0)
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return [F.when(F.col("n_words") > 0, F.ln(F.greatest(per("word_chars", "n_words"), F.lit(1.0)))).otherwise(0.0), F.ln(1 + 10 * per("n_symbols", "n_words")), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "word_chars")]


def chi_squared_below(degrees: int, x: float) -> float:
    """P(X <= x) of a chi-squared variable: the series of the lower incomplete gamma function."""
    a, half = degrees / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= half / (a + k)
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if x > 0 else 0.0


def consistency(p: int) -> float:
    """What the covariance of the central half of a normal sample must be multiplied by."""
    low, high = 0.0, 10.0 * p + 10
    for _ in range(100):
        low, high = ((low + high) / 2, high) if chi_squared_below(p, (low + high) / 2) < 0.5 else (low, (low + high) / 2)
    return 0.5 / chi_squared_below(p + 2, low)


def estimates(rows: DataFrame, keys: list[str], floors: list[float]) -> DataFrame:
    """A group's mean m0.. and the inverse pivots and factors of the Cholesky factor of its covariance."""
    p = len(floors)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    whole = consistency(p)
    means = [F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]
    moments = rows.groupBy(*keys).agg(*means, *[(F.covar_pop(f"x{i}", f"x{j}") * whole).alias(f"c{i}{j}") for i, j in pairs])
    for i, j in pairs:
        inner = sum((F.col(f"f{i}{k}") * F.col(f"f{j}{k}") for k in range(j)), F.lit(0.0))
        left = F.col(f"c{i}{j}") - inner
        moments = moments.withColumn(f"f{i}{j}", F.sqrt(F.greatest(left + floors[i] ** 2, F.lit(floors[i] ** 2))) if i == j else left / F.col(f"f{j}{j}"))
    return moments.select(*keys, *[f"m{i}" for i in range(p)], *[f"f{i}{j}" for i, j in pairs])


def distance(p: int) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    solved: list[Column] = []
    for i in range(p):
        inner = sum((F.col(f"f{i}{k}") * solved[k] for k in range(i)), F.lit(0.0))
        solved.append((F.col(f"x{i}") - F.col(f"m{i}") - inner) / F.col(f"f{i}{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def robust_distances(rows: DataFrame, keys: list[str], floors: list[float], *, steps: int = STEPS) -> DataFrame:
    """rows(keys, x0..) with ``distance``: squared, from the group's minimum-covariance-determinant estimate.

    Two starts go through the same passes: the group's coordinatewise medians and median deviations, and its plain mean
    and covariance. Each concentration step keeps, for either start, the half of a group's rows (and ties) with the
    smallest distances and estimates from those; estimates are checkpointed. Of a group's two last estimates the one
    with the smaller determinant counts, the first among equals.
    """
    p = len(floors)
    names = [*[f"m{i}" for i in range(p)], *[f"f{i}{j}" for i in range(p) for j in range(i + 1)]]
    medians = rows.groupBy(*keys).agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(p)])
    medians = medians.checkpoint()
    side = small_side(medians, 100_000)
    spread = rows.join(side, keys).groupBy(*keys, *[f"m{i}" for i in range(p)]).agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i in range(p)])
    robust = spread.select(*keys, *[f"m{i}" for i in range(p)], *[(F.greatest(1.4826 * F.col(f"s{i}"), F.lit(floors[i])) if i == j else F.lit(0.0)).alias(f"f{i}{j}") for i in range(p) for j in range(i + 1)])
    current = robust.withColumn("start", F.lit(0)).unionByName(estimates(rows, keys, floors).withColumn("start", F.lit(1))).checkpoint()
    each = [*keys, "start"]
    for _ in range(steps):
        far = rows.join(small_side(current, 200_000), keys).select(*each, *[f"x{i}" for i in range(p)], distance(p).alias("distance"))
        half = far.groupBy(*each).agg(F.percentile_approx("distance", 0.5, 1000).alias("half")).checkpoint()
        core = far.join(small_side(half, 200_000), each).filter(F.col("distance") <= F.col("half"))
        current = estimates(core, each, floors).checkpoint()
    determinant = sum((F.log(f"f{i}{i}") for i in range(p)), F.lit(0.0))
    best = current.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(determinant, "start")).alias("best")).select(*keys, "best.*").checkpoint()
    return rows.join(small_side(best, 100_000), keys).withColumn("distance", distance(p)).drop(*names)


def quality_verdicts(docs: DataFrame, *, cut: float = CUT, steps: int = STEPS, least_group: int = LEAST_GROUP, carried: Sequence[str] = ()) -> DataFrame:
    """A row a document: base counts, base_failed, kept, and the squared distance from its group.

    Texts that fail the base rules are not estimated from and have no distance. A language and source with fewer than
    ``least_group`` estimated texts shares one group with the other small ones; where even that is small, distances
    are measured all the same, and the smallest spreads leave room. Null languages and sources form groups of their
    own. Null and empty texts have no words and fail. Repeated rows count as often as they come.
    Columns named in ``carried`` come last, as they are.
    """
    stats = text_statistics(docs.select(*dict.fromkeys(["doc_id", "lang", "source", "text", *carried])), carried)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(stats.select("*", failed.alias("base_failed"), F.coalesce("lang", F.lit("")).alias("g_lang"), F.coalesce("source", F.lit("")).alias("g_source"), *[x.alias(f"x{i}") for i, x in enumerate(vector())]), "quality-statistics")
    sound = stats.filter(~F.col("base_failed"))
    sizes = sound.groupBy("g_lang", "g_source").agg((F.count("*") < least_group).alias("few")).checkpoint()
    few = F.coalesce("few", F.lit(True))
    pooled = sound.join(small_side(sizes, 100_000), ["g_lang", "g_source"], "left").withColumns({"g_lang": F.when(few, "").otherwise(F.col("g_lang")), "g_source": F.when(few, "").otherwise(F.col("g_source"))}).drop("few")
    far = robust_distances(pooled, ["g_lang", "g_source"], list(STATISTICS.values()), steps=steps)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = far.select(*columns, (F.col("distance") <= cut).alias("kept"), F.col("distance"), *carried)
    return judged.unionByName(stats.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), *carried))
