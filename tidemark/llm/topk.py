"""Exact inner-product top-k: norm-sorted blocks, rotated partial sums, residual bounds.

Vectors become integers, are ordered by descending length and packed into blocks. An
orthogonal rotation from the SVD (the eigenvectors of the table's Gram matrix, a sum of
fixed size) moves most of every inner product into the first coordinates: the exact
product is at most the partial one plus the product of the residual lengths
(Cauchy-Schwarz). Each query first meets the block of the longest vectors, which gives
the score it has to beat; pairs of groups whose lengths cannot reach it are never formed,
and inside a pair the scan ends at the first block that is too short. Survivors are scored
with exact integers, so the rotation's rounding never decides.

Queries and vectors meet in blocks: a task holds one group of query blocks and one group of
vector blocks, both of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BLOCK = 1024  # vectors of a block
GROUP = 4  # blocks of a group
PARTIAL = 16  # rotated coordinates of the first bound
SAFE_FLOAT = 2.0**52
LARGEST = 2.0**62  # of the product of two lengths, and so of a score
BLOCK_SCHEMA = "dim int, block long, top double, ids binary, values binary"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v``: floor(scale * x) of each component; vectors with a null or non-finite component are left out."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(x) > 0) & ~odd)
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix by falling eigenvalue, from per-task sums of dim x dim numbers."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0)).astype(float)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    got = rows.select("v").mapInArrow(grams, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    gram = np.zeros(dim * dim)
    gram[got.column("at").to_numpy()] = got.column("x").to_numpy()
    _, vectors = np.linalg.eigh(gram.reshape(dim, dim))
    return np.ascontiguousarray(vectors[:, ::-1])


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks by falling length; ``block`` keeps that order, ``top`` is a block's longest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                m = _matrix(some.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m.shape[1]], pa.int32()),
                        pa.array([n]),
                        pa.array([some.column(2)[0].as_py()]),
                        pa.array([some.column(0).to_numpy().tobytes()]),
                        pa.array([m.tobytes()]),
                    ],
                    names=["dim", "block", "top", "ids", "values"],
                )
                n += 1

    ordered = rows.repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    blocks = ordered.select("id", "v", "length").mapInArrow(pack, BLOCK_SCHEMA)
    return blocks.withColumn("block", F.spark_partition_id().cast("long") * F.lit(1 << 32) + F.col("block"))


class Block:
    """A block of integer vectors with its rotated coordinates and lengths."""

    def __init__(self, row, rotation: np.ndarray) -> None:
        self.ids = np.frombuffer(row.ids, np.int64)
        self.values = np.frombuffer(row.values, np.int64).reshape(len(self.ids), row.dim)
        self.exact = self.values.astype(float)
        turned = self.exact @ rotation
        self.partial = turned[:, :PARTIAL]
        self.rest = np.sqrt((turned[:, PARTIAL:] ** 2).sum(1))
        self.length = np.sqrt((self.exact**2).sum(1))
        self.largest = float(np.abs(self.exact).max(initial=0))


def _merge(best: list[tuple], ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
    order = np.lexsort((ids, -scores))[:k]
    return sorted([*best, *zip((-scores[order]).tolist(), ids[order].tolist())])[:k]


def scan(queries: Block, floors: np.ndarray, blocks: list[Block], k: int) -> list[list[tuple]]:
    """Each query's best (-score, id) in blocks of falling length; scores below its floor may be left out."""
    best: list[list[tuple]] = [[] for _ in queries.ids]
    floors = floors.copy()
    for block in blocks:
        slack = 1e-6 * (1 + queries.length * block.length.max(initial=0))
        alive = np.flatnonzero(queries.length * block.length.max(initial=0) + slack >= floors)
        if not len(alive):
            break
        top = queries.partial[alive] @ block.partial.T + queries.rest[alive, None] * block.rest
        may = top + slack[alive, None] >= floors[alive, None]
        rows = np.flatnonzero(may.any(1))
        if not len(rows):
            continue
        columns = np.flatnonzero(may.any(0))
        some = alive[rows]
        if queries.largest * block.largest * block.values.shape[1] < SAFE_FLOAT:
            exact = (queries.exact[some] @ block.exact[columns].T).astype(np.int64)
        else:
            exact = queries.values[some] @ block.values[columns].T
        may = may[np.ix_(rows, columns)] & (block.ids[columns] != queries.ids[some, None])
        for i, q in enumerate(some):
            at = np.flatnonzero(may[i])
            if len(at):
                best[q] = _merge(best[q], block.ids[columns[at]], exact[i, at], k)
                if len(best[q]) == k:
                    floors[q] = max(floors[q], -best[q][-1][0])
    return best


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each query.

    Queries are the rows whose id ``every`` divides, candidates all rows of the same
    dimension but those with the query's own id. Scores are integer inner products of
    floor(scale * x); ties go to the smaller id. Vectors that are null, empty or hold a null
    or non-finite component, and rows with a null id, take no part. Repeated candidate rows
    each count; equal query rows are one query. Fewer than ``k`` candidates give all of them. An empty
    table gives an empty table; other columns are not read. Components so large that a score might not
    fit 64 bits raise a ValueError.
    """
    rows = quantized(vectors, id_col, vector_col, scale).withColumn("length", _length(F.col("v")))
    rows = stored(rows, "vectors")
    longest = [r["length"] for r in rows.select("length").orderBy(F.desc("length")).limit(2).collect()]
    if len(longest) == 2 and longest[0] * longest[1] >= LARGEST:
        raise ValueError("components are too large for 64-bit scores")
    out = None
    for dim, n in sorted((r["dim"], r["n"]) for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        one = _one_dimension(rows.where(F.size("v") == dim), dim, n, k, every)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _one_dimension(rows: DataFrame, dim: int, n: int, k: int, every: int) -> DataFrame:
    rotation = _rotation(rows, dim)
    parts = max(1, math.ceil(n / (BLOCK * GROUP)))
    blocks = stored(_packed(rows, parts), "blocks")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    asked = stored(_packed(asked, max(1, math.ceil(n / every / (BLOCK * GROUP)))), "queries")
    longest = [Block(b, rotation) for b in blocks.orderBy(F.desc("top"), "block").limit(1).collect()]

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for row in frame.itertuples():
                block = Block(row, rotation)
                best = scan(block, np.full(len(block.ids), -np.inf), longest, k)
                got.append(np.array([-b[-1][0] if len(b) == k else -np.inf for b in best], float))
            frame = frame.assign(floors=[g.tobytes() for g in got])
            # what a candidate's length must reach for any query of the block
            need = [min([*(g / max(1e-300, x) for g, x in zip(f, Block(r, rotation).length)), np.inf]) for f, r in zip(got, frame.itertuples())]
            yield frame.assign(need=need)

    asked = stored(asked.mapInPandas(floors, f"{BLOCK_SCHEMA}, floors binary, need double"), "asked")
    # groups of consecutive blocks: a part of the range partitioning holds about GROUP blocks
    sides = blocks.withColumn("g", F.shiftright("block", 32))
    heads = sides.groupBy("g").agg(F.max("top").alias("reach")).agg(F.collect_list(F.struct("g", "reach")).alias("heads"))
    wanted = asked.withColumn("qg", F.shiftright("block", 32))
    # one row of 16 bytes for each GROUP * BLOCK vectors; lengths that differ from the bound by rounding alone must stay
    pairs = wanted.groupBy("qg").agg(F.min("need").alias("need")).join(F.broadcast(heads))
    near = F.filter("heads", lambda h: h["reach"] * (1 + 1e-9) + 1e-6 >= F.col("need"))
    pairs = pairs.select("qg", F.explode(near).alias("h")).select("qg", "h.g")
    pairs = stored(pairs.select("qg", "g"), "pairs")
    def meet(key: tuple, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = [Block(r, rotation) for r in theirs.sort_values(["top", "block"], ascending=[False, True]).itertuples()]
        found = []
        for row in ours.itertuples():
            block = Block(row, rotation)
            for q, own, best in zip(block.ids, block.values, scan(block, np.frombuffer(row.floors), theirs, k)):
                twin = xxhash.xxh64_intdigest(own.tobytes()) - 2**63
                found += [(int(q), twin, i, -s) for s, i in best]
        return pd.DataFrame(found, columns=["query_id", "twin", "vec_id", "score"])

    ours = wanted.join(pairs, "qg").select("qg", "g", "dim", "ids", "values", "floors")
    theirs = sides.join(pairs, "g").select(F.col("qg").alias("oqg"), F.col("g").alias("og"), "dim", "block", "top", "ids", "values")
    met = ours.groupBy("qg", "g").cogroup(theirs.groupBy("oqg", "og"))
    met = met.applyInPandas(meet, "query_id long, twin long, vec_id long, score long")
    # k rows of each pair of groups at most
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
