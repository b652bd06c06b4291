"""The few functions that have no Spark expression, as Arrow-batched ones, and shares of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ", "")


def shares(sizes: pa.Array, at_once: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of the shares of a batch that are worked on together: rows of ``at_once`` in all, or one larger."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        after = max(at + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield at, after - at
        at = after


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two strings (longest common blocks); null where either is null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def split_recursively(text: str, size: int = 200, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves, with trailing overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next(s for s in separators if s in text)
    finer = separators[separators.index(mark) + 1 :]
    if not mark:
        step = size - overlap
        return [text[k : k + size] for k in range(0, max(len(text) - overlap, 1), step)]
    parts = text.split(mark)
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part) > size and finer:
            if held:
                out.append(mark.join(held))
                held = []
            out += split_recursively(part, size, overlap, finer)
            continue
        while held and len(mark.join([*held, part])) > size:
            if not out or out[-1] != mark.join(held):
                out.append(mark.join(held))
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    if held:
        out.append(mark.join(held))
    return [p.strip() for p in out if p.strip()]


def recursive_chunks(rows: DataFrame, key: str, text: str, *, texts: int = 64) -> DataFrame:
    """key, chunk (from 0) and piece of every text; a task holds the pieces of a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), texts):
                part = batch.slice(at, texts)
                pieces = [split_recursively(t) if t is not None else [] for t in part.column(1).to_pylist()]
                of = pa.array([k for k, p in enumerate(pieces) for _ in p], pa.int64())
                chunk = pa.array([n for p in pieces for n in range(len(p))], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), chunk, pa.array([x for p in pieces for x in p], pa.string())], names=[key, "chunk", "piece"])

    return rows.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("piece", T.StringType())]))
