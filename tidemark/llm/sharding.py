"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a ring. A row belongs to the arc of its
key's hash; the arc's owner takes it while it has room, else it continues clockwise to
the owners of the following arcs. The room of all shards together is the number of
rows, and no two shards' room differs by more than one, so the counts differ by at most
one. Where rows go depends on the arcs' counts alone, and there are
``shards * virtual_nodes`` arcs whatever the size of the table: that walk is the only
thing the driver does. Rows get their ranks inside an arc from sub-ranges of the arc, so
no task holds an arc.

Counts that differ by at most one leave no spare room, so what overflows one shard fills the
next: more rows move between n and n + 1 shards than the 1 / (n + 1) of a ring with spare room. Many
virtual nodes keep the arcs' sums close to the room, so that little overflows. Groups of equal texts
are not kept together: the key is the id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

PIECE_ROWS = 50_000  # rows of one rank window, about
VIRTUAL_NODES = 512


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Ring points in order (signed 64 bit), and the shard that owns the arc up to each."""
    points = sorted(
        (xxhash.xxh64_intdigest(f"shard-{s}/{v}", seed=7) - 2**63, s) for s in range(shards) for v in range(virtual_nodes)
    )
    return [p for p, _ in points], [s for _, s in points]


def arc_of(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The arc of each hash: it ends at the first point not before it; past the last the ring starts again."""
    at = np.searchsorted(points, values, side="left")
    return np.where(at < len(points), at, 0).astype(np.int32)


def _arcs(points: list[int]):
    cuts = np.array(points, np.int64)

    @F.pandas_udf("int")
    def arcs(at: pd.Series) -> pd.Series:
        return pd.Series(arc_of(at.to_numpy(), cuts))

    return arcs


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Deal the rows of each arc: (arc, from rank, to rank, shard, first slot).

    In the first round each arc offers its rows to its owner, in the second what is left to
    the next arc's owner, and so on. An arc whose owner is full passes its last rows on.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    at = [0] * len(counts)
    dealt = []
    left, hop = [arc for arc, n in enumerate(counts) if n], 0
    while left:
        for arc in left:
            s = owners[(arc + hop) % len(counts)]
            take = min(counts[arc] - at[arc], room[s] - used[s])
            if take:
                dealt.append((arc, at[arc], at[arc] + take, s, used[s]))
                used[s] += take
                at[arc] += take
        left, hop = [arc for arc in left if at[arc] < counts[arc]], hop + 1
    return dealt


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1, a null text has none. Shard counts
    differ by at most one and slots run from 0 without a gap. The key is the id; a null id
    is a key like any other. Rows equal in id and text are interchangeable: they are ranked
    together and get neighbouring slots. Texts may be of any length; only their sizes and hashes are
    shuffled. Other columns are not read. An empty table gives an empty table.
    """
    points, owners = ring(shards, virtual_nodes)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_col).alias("mark"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("at"),
    )
    groups = rows.groupBy("id", "size", "text_crc32", "mark", "at").agg(F.count(F.lit(1)).alias("copies"))
    groups = groups.withColumn("arc", _arcs(points)("at"))
    groups = stored(groups, "sharded")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    per_arc = max(1, -(-total // (PIECE_ROWS * shards * virtual_nodes)))
    piece = F.pmod(F.xxhash64("at", "mark", F.lit("piece")), F.lit(per_arc)).cast("int")
    groups = groups.withColumn("piece", piece)
    sizes = groups.groupBy("arc", "piece").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("piece")) - F.col("n")
    sizes = sizes.withColumn("before", before)
    counts = [0] * len(points)
    for r in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one row for each arc of the ring
        counts[r["arc"]] = r["n"]
    dealt = walk(counts, owners, shards)
    plan = docs.sparkSession.createDataFrame(dealt or [(-1, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, slot0 long")
    order = Window.partitionBy("arc", "piece").orderBy("mark", "id", "size", "text_crc32")
    ranked = groups.withColumn("upto", F.sum("copies").over(order))
    ranked = ranked.join(sizes.select("arc", "piece", "before"), ["arc", "piece"])
    ranked = ranked.withColumn("first", F.col("before") + F.col("upto") - F.col("copies"))
    one = ranked.select("id", "size", "text_crc32", "arc", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("rank"))
    # at most shards * virtual_nodes arcs, each dealt to few owners: a table of bounded size
    placed = one.join(F.broadcast(plan), "arc").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot")
    )
