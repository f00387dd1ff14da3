"""Bounded frames over one long series, cut into chunks that overlap by the longest lookback.

A window over one symbol is one task. Here each series is cut into chunks of row numbers; the last rows
of each chunk also go to the next one as a halo, the operator runs by (symbol, chunk), and the halo's
rows are dropped. Exact for operators whose frames reach at most ``lookback`` rows back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames
from tidemark.functions.rows import row_numbers


def chunked(
    df: DataFrame, operator: Callable[[DataFrame, Frames], DataFrame], lookback: int, chunk_rows: int = 100_000, keys: tuple[str, ...] = ("symbol",), order: str = "ts"
) -> DataFrame:
    """``operator(df, frames)`` on chunks; the result equals that on whole series."""
    if chunk_rows < lookback:
        raise ValueError("a chunk must be as long as the lookback at least")
    rows = row_numbers(df, keys, order)
    own = F.floor(F.col("_row") / chunk_rows)
    reach = F.floor((F.col("_row") + lookback) / chunk_rows)
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence("_own", reach)))
    out = operator(rows, Frames((*keys, "_chunk"), (order,)))
    return out.where(F.col("_chunk") == F.col("_own")).drop("_row", "_own", "_chunk")
