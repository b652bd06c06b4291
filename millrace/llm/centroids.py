"""Lloyd rounds over integer vectors, exact, with most of the work in 32-bit matrix products.

A task multiplies its vectors with the centroids in float32. Each product comes with a bound on its rounding error
(|fl(x.c) - x.c| <= g |x| |c|, g = m u / (1 - m u), u = 2**-24, m = components + 2 for the two conversions, for any
order of the sums), so |c|**2 - 2 x.c, which ranks the centroids of x, lies in a known interval. Centroids whose
interval reaches below the least upper end are the shortlist. Where it holds one centroid, that one is nearest; else
the distances to those on it are computed again in exact integers, and the smaller number wins a tie.

New centroids come from sums per task and cluster, added up by Spark in limbs of 24 bits, so they are exact for any
finite input; what reaches the driver in a round is clusters times components times limbs numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LIMB, SMALL, TOP = 24, 1 << 26, 2**63 - 1  # bits of a limb; size up to which 64 bits hold distances; largest long
UNIT = 2.0**-24  # rounding unit of float32


def integers(rows: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the kept vectors, floor(scale * component) as a matrix of doubles without a fraction)."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    sizes = np.where(np.isnan(sizes), -1, sizes) if sizes.dtype.kind == "f" else sizes
    kept = np.flatnonzero(sizes == width)
    flat = rows.take(pa.array(kept)).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls become nan
    sound = np.isfinite(matrix).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * matrix[sound])
    whole = np.isfinite(scaled).all(axis=1)  # scaling the largest doubles can leave their range: such vectors go
    return kept[sound][whole], scaled[whole]


class Screen:
    """The centroids of one round, as exact integers and as float32."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact = centroids
        self.small = max((abs(v) for c in centroids for v in c), default=0) <= SMALL and len(centroids[0]) <= 256
        if self.small:
            self.whole = np.array(centroids, np.int64)
            self.short = self.whole.astype(np.float32)
            self.squares = (self.whole * self.whole).sum(axis=1)
            self.length = np.sqrt(self.squares.astype(np.float64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """(number of the nearest centroid, squared distance, how many vectors exact integers had to settle)."""
        best, distance = np.zeros(len(vectors), np.int64), [0] * len(vectors)
        fits = (np.abs(vectors) <= SMALL).all(axis=1) if self.small else np.zeros(len(vectors), bool)
        near = np.flatnonzero(fits)
        settled = 0
        if near.size:
            best[near], exact, settled = self.screened(vectors[near].astype(np.int64))
            for k, d in zip(near.tolist(), exact.tolist(), strict=True):
                distance[k] = d
        for k in np.flatnonzero(~fits).tolist():  # beyond 64 bits: Python's integers
            x = list(map(int, vectors[k]))
            distance[k], best[k] = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(self.exact))
            settled += 1
        return best, distance, settled

    def screened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        m = x.shape[1] + 2
        g = m * UNIT / (1 - m * UNIT)
        product = (x.astype(np.float32) @ self.short.T).astype(np.float64)
        size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        middle = self.squares - 2 * product
        # the rounding of the products, then that of these few steps in doubles; widened for the bound's own rounding
        error = (2 * g * size[:, None] * self.length + 2.0**-50 * (self.squares + 2 * np.abs(product))) * (1 + 2.0**-20)
        listed = middle - error <= (middle + error).min(axis=1)[:, None]
        best = listed.argmax(axis=1)
        open_rows = np.flatnonzero(listed.sum(axis=1) > 1)
        if open_rows.size:
            row, cluster = np.nonzero(listed[open_rows])
            gap = x[open_rows[row]] - self.whole[cluster]
            square = (gap * gap).sum(axis=1)
            order = np.lexsort((cluster, square, row))
            first = np.unique(row[order], return_index=True)[1]
            best[open_rows] = cluster[order][first]
        gap = x - self.whole[best]
        return best, (gap * gap).sum(axis=1), int(open_rows.size)


def limbs(value: int) -> list[int]:
    """value in limbs of 24 bits, lowest first, all of its sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def first_centroids(vectors: DataFrame, k: int, width: int, scale: float, salt: str) -> list[list[int]]:
    """The k kept vectors of smallest sha256 of salt:vec_id (a null id is empty text), in that order; each task hands
    on no more than its own k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, str]] = []
        for batch in batches:
            at, whole = integers(batch.column(1), width, scale)
            names = batch.column(0).take(pa.array(at)).to_pylist()
            keys = [hashlib.sha256(f"{salt}:{'' if n is None else n}".encode()).hexdigest() for n in names]
            cut = sorted(keys)[k - 1] if len(keys) > k else "~"
            spelled = ((h, ",".join(str(int(x)) for x in whole[j])) for j, h in enumerate(keys) if h <= cut)
            found = sorted(found + [(h, len(v), v) for h, v in spelled])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in found], pa.string()), pa.array([v for _, _, v in found], pa.string())], names=["hash", "components"])

    least = vectors.mapInArrow(run, "hash string, components string").orderBy("hash", F.length("components"), "components").limit(k).collect()  # k rows
    return [list(map(int, r["components"].split(","))) for r in least]


def next_centroids(vectors: DataFrame, centroids: list[list[int]], width: int, scale: float) -> list[list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        count = [0] * len(centroids)
        total = [[0] * width for _ in centroids]
        for batch in batches:
            _, whole = integers(batch.column(1), width, scale)
            best, _, _ = screen.nearest(whole)
            large = (np.abs(whole) > SMALL).any(axis=1)
            for c in np.unique(best).tolist():
                mine = best == c
                count[c] += int(mine.sum())
                part = [whole[mine & ~large].astype(np.int64).sum(axis=0).tolist(), *[list(map(int, v)) for v in whole[mine & large]]]
                total[c] = [a + sum(b) for a, b in zip(total[c], zip(*part, strict=True), strict=True)]
        rows = [(c, j, k, v) for c in range(len(centroids)) for j in range(width) for k, v in enumerate(limbs(total[c][j]))]
        rows += [(c, -1, 0, n) for c, n in enumerate(count) if n]  # component -1: how many vectors
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((),) * 4)], names=["cluster", "component", "limb", "part"])

    sums = vectors.mapInArrow(run, "cluster long, component long, limb long, part long").groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part"))
    count, total = [0] * len(centroids), [[0] * width for _ in centroids]
    for c, j, k, v in sums.collect():  # clusters x components x limbs, of which a long needs two or three
        if j < 0:
            count[c] = v
        else:
            total[c][j] += v << (LIMB * k)
    return [[s // n for s in t] if n else c for c, n, t in zip(centroids, count, total, strict=True)]


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, by_integers for every kept vector.

    Kept are vectors with ``width`` components, none null or non-finite (also after scaling); components become
    floor(scale * x). Rows that repeat count as often as they come; of two with one id the one whose components are written shorter, then in text order, starts first.
    A null id is kept and hashed as empty text. With fewer kept vectors than k there are as many centroids; an empty
    table gives no rows. Distances and inertias beyond a long are its largest value (components above 2**26 only).
    Other columns are not looked at. by_integers is how many vectors, of
    all, the float32 screen left open in the last assignment, so that exact integers settled them.
    """
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    centroids = first_centroids(plain, k, width, scale, salt)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(plain, centroids, width, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids or [[0] * width])
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                at, whole = integers(part.column(1), width, scale)
                best, distance, settled = screen.nearest(whole)
                opened = [settled, *[0] * (len(at) - 1)] if len(at) else []
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(best, pa.int32()), pa.array([min(d, TOP) for d in distance], pa.int64()), pa.array(opened, pa.int64())], names=["vec_id", "cluster", "distance", "opened"])

    assigned = written(plain.mapInArrow(run, "vec_id long, cluster int, distance long, opened long"), "clusters")
    sizes = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.sum("opened").alias("opened")).collect()}  # a row a cluster
    cut = lambda v: min(int(v), TOP)
    table = [(cut(sizes[c]["inertia"]) if c in sizes else 0, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), sizes[c]["opened"] if c in sizes else 0) for c, v in enumerate(centroids)]
    pick = lambda n, kind: F.get(F.array(*[F.lit(r[n]).cast(kind) for r in table]).cast(f"array<{kind}>"), F.col("cluster"))
    whole = cut(sum(int(r["inertia"]) for r in sizes.values()))
    return assigned.select("vec_id", "cluster", "distance", pick(0, "long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), pick(1, "string").alias("centroid_sha256"), F.lit(sum(int(r["opened"]) for r in sizes.values())).cast("long").alias("by_integers"))
