"""Exponential averages and other folds along a series, as one sorted pass per symbol.

A fold is no frame aggregate. ``ema`` groups by symbol, sorts there and runs one vectorised
filter per column. A long single series is split into chunks first: each chunk is folded with a
zero start, which gives the pair (decay, sum) that carries a start value to its end; a prefix
scan over the few chunk pairs yields every chunk's start, and the chunks are folded again with it.
With ``long_series`` no task holds more than a chunk; without it the row numbers come from one sorted pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.rows import row_numbers

CHUNK_ROWS = 200_000
BLOCK_RANGE = 1e3  # how much the weights of a block differ at most


def alpha_of(span: int) -> float:
    return 2.0 / (span + 1)


def fold(x: np.ndarray, alpha: float, start: float | None) -> np.ndarray:
    """Exponential average without adjustment; it starts with the first value unless ``start`` is given.

    A null keeps the average as it is, and nothing is known before the first value.
    """
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return np.full(len(x), np.nan if start is None else start)
    values = x[known]
    made, last, keep = np.empty(len(values)), values[0] if start is None else start, 1.0 - alpha
    # within a block y[i] = keep ** (i + 1) * (last + sum of alpha * x[j] / keep ** (j + 1)); short ones keep the powers small
    size = max(1, int(np.log(BLOCK_RANGE) / -np.log(keep))) if keep > 0 else 1
    powers = keep ** np.arange(1, size + 1)
    for at in range(0, len(values), size):
        some = values[at : at + size]
        p = powers[: len(some)]
        made[at : at + size] = p * (last + np.cumsum(alpha * some / p)) if keep > 0 else some
        last = made[min(at + size, len(values)) - 1]
    # a null keeps the average before it
    place = np.searchsorted(known, np.arange(len(x)), side="right") - 1
    return np.where(place >= 0, made[np.maximum(place, 0)], np.nan if start is None else start)


def ema(
    df: DataFrame,
    columns: dict[str, tuple[str, int]],
    keys: tuple[str, ...] = ("symbol",),
    order: str = "ts",
    chunk_rows: int = CHUNK_ROWS,
    long_series: bool = False,
) -> DataFrame:
    """Add ``{new: (source column, span)}`` exponential averages.

    See :func:`ema_by_rate`.
    """
    return ema_by_rate(df, {n: (c, alpha_of(s)) for n, (c, s) in columns.items()}, keys, order, chunk_rows, long_series)


def ema_by_rate(
    df: DataFrame,
    sources: dict[str, tuple[str, float]],
    keys: tuple[str, ...] = ("symbol",),
    order: str = "ts",
    chunk_rows: int = CHUNK_ROWS,
    long_series: bool = False,
) -> DataFrame:
    """Add ``{new: (source column, rate)}`` exponential averages: each value moves the average by the rate's share.

    Rows are numbered by a window over each series; with ``long_series`` by range-partitioned pieces
    and their counts, so that no task sees a whole series.
    """
    if long_series:
        numbered = row_numbers(df, keys, order, "_number")
    else:
        numbered = df.withColumn("_number", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    chunked = numbered.withColumn("_chunk", F.floor(F.col("_number") / chunk_rows).cast("long")).drop("_number")
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in sources]])
    ends = _chunk_ends(chunked, sources, keys, order)
    ends = ends.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_chunk")})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.col("_chunk") == F.col("_k__chunk"))
    joined = chunked.join(ends, same, "left").drop(*[f"_k_{k}" for k in (*keys, "_chunk")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        made = {}
        for name, (source, alpha) in sources.items():
            start = pdf[f"_start_{name}"].iloc[0]
            made[name] = fold(pdf[source].to_numpy(float), alpha, None if start != start or start is None else float(start))
        return pdf.assign(**made)[schema.names]

    return joined.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def _chunk_ends(chunked: DataFrame, sources: dict[str, tuple[str, float]], keys: tuple[str, ...], order: str) -> DataFrame:
    """For each chunk the averages that hold before its first row; null for the first chunk."""
    fields = ", ".join(f"`{k}` {chunked.schema[k].dataType.simpleString()}" for k in keys)
    pairs = ", ".join(f"`_first_{n}` double, `_end_{n}` double, `_left_{n}` double" for n in sources)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        row = {k: pdf[k].iloc[0] for k in keys} | {"_chunk": int(pdf["_chunk"].iloc[0])}
        for name, (source, alpha) in sources.items():
            x = pdf[source].to_numpy(float)
            x = x[~np.isnan(x)]
            row[f"_first_{name}"] = x[0] if len(x) else np.nan
            row[f"_end_{name}"] = fold(x, alpha, 0.0)[-1] if len(x) else np.nan
            row[f"_left_{name}"] = float(len(x))
        return pd.DataFrame([row])

    ends = chunked.groupBy(*keys, "_chunk").applyInPandas(summary, f"{fields}, _chunk long, {pairs}")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        out = pdf[[*keys, "_chunk"]].copy()
        for name, (_, alpha) in sources.items():
            starts, last = [], np.nan
            for first, end, n in zip(pdf[f"_first_{name}"], pdf[f"_end_{name}"], pdf[f"_left_{name}"]):
                starts.append(last)
                if n:  # seeded with the first value, then decayed n times
                    seed = first if last != last else last
                    last = end + (1 - alpha) ** n * seed
            out[f"_start_{name}"] = starts
        return out

    starts = ", ".join(f"`_start_{n}` double" for n in sources)
    return ends.groupBy(*keys).applyInPandas(scan, f"{fields}, _chunk long, {starts}")


def hurst_of(x: np.ndarray) -> float:
    """Rescaled-range exponent of one window: the slope of log R/S over log k for prefixes k = 8, 12, ..."""
    sizes, scaled = [], []
    for k in range(8, len(x) + 1, 4):
        part = x[:k]
        walk = np.cumsum(part - part.mean())
        spread, s = walk.max() - walk.min(), part.std()
        if s > 0 and spread > 0:
            sizes.append(np.log(k))
            scaled.append(np.log(spread / s))
    if len(sizes) < 3:
        return np.nan
    a, b = np.array(sizes), np.array(scaled)
    slope = ((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum()
    return float(min(1.0, max(0.0, slope)))


def hurst_udf():
    @F.pandas_udf("double")
    def hurst(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield pd.Series([np.nan if v is None else hurst_of(np.asarray(v, float)) for v in s])

    return hurst
