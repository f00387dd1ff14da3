"""Quantiles of long sliding frames by an order-statistic structure instead of a sort for each row.

A frame function recomputes the quantile of every frame: n values for each row. Here each series is cut into chunks of rows that
overlap by the frame's length; a task slides over one chunk with an ordered structure that takes a value in and lets one out, log n
a row, and holds one chunk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rows import row_numbers


def sliding_quantiles(df: DataFrame, x: str, n: int, shares: dict[str, float], keys: tuple[str, ...] = ("symbol",), order: str = "ts", chunk_rows: int = 0) -> DataFrame:
    """``df`` with a column for each of ``shares``: the interpolated quantile of ``x`` over the last ``n`` rows, null unless all of them have one.

    ``order`` must be unique in a series and not null; rows of null keys are a series of their own. A chunk has ``chunk_rows`` rows, by
    default four times the frame and 50,000 at least, and is read with the ``n - 1`` rows before it.
    """
    size = max(chunk_rows or max(4 * n, 50_000), n)
    rows = row_numbers(df.select(*keys, order, F.col(x).cast("double").alias("_x")), keys, order)
    own = F.floor(F.col("_row") / size)
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence("_own", F.floor((F.col("_row") + n - 1) / size))))

    def slide(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("_row", kind="stable")
        frames = chunk["_x"].rolling(n, min_periods=n)
        chunk = chunk.assign(**{c: frames.quantile(p, interpolation="linear") for c, p in shares.items()})
        return chunk.loc[chunk["_own"] == chunk["_chunk"], [*keys, order, *shares]]

    kinds = df.select(*keys, order).dtypes
    shape = ", ".join([f"`{c}` {k}" for c, k in kinds] + [f"`{c}` double" for c in shares])
    found = rows.groupBy(*keys, "_chunk").applyInPandas(slide, shape)
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, order)], *shares)
    same = F.lit(True)
    for k in (*keys, order):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(found, same, "left").select(*df.columns, *shares)
