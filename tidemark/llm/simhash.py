"""SimHash near-duplicates by a segment-popcount grid.

A 64-bit fingerprint becomes sixteen bit counts, one for each four-bit segment.
The Manhattan distance of two such count vectors is at most the Hamming distance of
the fingerprints, so near fingerprints are near in that grid. Two lattice points at
distance 2 or less share a lattice point within distance 1 of both; each fingerprint
therefore enters its own cell and the 32 cells one step away, and one equi-join on
the cell is the whole range join. The exact Hamming distance decides.

Rows per fingerprint are constant (33), whatever the size of the table. A cell that
holds more than ``cell_limit`` fingerprints would make all pairs of them; there, each
fingerprint enters its 65 neighbours within one flipped bit instead. All entries of
one such neighbour are within 2 bits of each other, so a star to the smallest is
exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, sliced, stored

SEGMENTS = 16
SEGMENT_BITS = 4
STEP_BITS = 3  # counts 0 to 4 and one step to either side fit in three bits
MAX_BITS = 2  # what one shared grid step can reach
SLICE = 65536  # shingles whose bits are counted at a time


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of UTF-8 text, A-Z lower-cased, repeats included.

    Fewer words than ``size`` give their whole sequence, no words give nothing.
    """
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set if over half the hashes have them; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(parts: list[bytes]) -> int:
    """The signed 64-bit SimHash of shingles by their XXH64, seed 42."""
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, seed=42) for x in parts), np.uint64, len(parts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``id_col, fp``: one fingerprint for each row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            fps = [fingerprint(shingles(t or b"", shingle_words)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = 64) -> DataFrame:
    """``a, b``: links that connect all distinct ``fp`` at ``max_bits`` or fewer differing bits.

    Every row is a true link. In cells of at most ``cell_limit`` fingerprints every link
    is returned; denser cells return stars with the same components. ``fps`` must hold
    distinct values.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit(2**SEGMENT_BITS - 1))).cast("long")
        for i in range(SEGMENTS)
    ]
    base = sum((F.shiftleft(c + 1, STEP_BITS * i) for i, c in enumerate(counts[1:], 1)), counts[0] + 1)
    steps = [F.lit(s * 2 ** (STEP_BITS * i)) for i in range(SEGMENTS) for s in (1, -1)]
    entries = fps.select("fp", base.alias("base")).select(
        "fp", F.explode(F.array("base", *[F.col("base") + s for s in steps])).alias("cell")
    )
    cells = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    cells = stored(cells.where("n > 1"), "cells")
    pairs = cells.where("n = 2").select("a", "b").where(_near("a", "b", max_bits))
    more = entries.join(cells.where("n > 2").select("cell", "n"), "cell")
    more = stored(more, "members")
    few = more.where(F.col("n") <= cell_limit).groupBy("cell").agg(F.collect_list("fp").alias("all"))
    few = few.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    few = few.where((F.col("a") < F.col("b")) & _near("a", "b", max_bits))
    dense = more.where(F.col("n") > cell_limit).select("fp").distinct()
    return pairs.unionByName(few).unionByName(_stars(dense, max_bits)).distinct()


def _stars(fps: DataFrame, max_bits: int) -> DataFrame:
    """Stars over shared one-flip neighbours; below 2 bits only a fingerprint's own entry is a centre."""
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]
    entries = fps.select("fp", F.explode(F.array("fp", *flips)).alias("way"))
    if max_bits == 1:
        entries = entries.join(fps.select(F.col("fp").alias("way")), "way", "left_semi")
        return entries.select(F.col("way").alias("a"), F.col("fp").alias("b")).where("a < b")
    centres = entries.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a")).where("n > 1")
    return entries.join(centres, "way").where("fp > a").select("a", F.col("fp").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = MAX_BITS,
    cell_limit: int = 64,
) -> DataFrame:
    """``id_col, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of at most
    ``max_bits`` differing bits; equal fingerprints always link, and texts without a
    word share fingerprint zero. Null texts count as empty. Rows with a null id take
    part; they never give a component its id, and a component of null ids alone has a
    null one. Repeated rows are kept. Texts may be of any length; ``SLICE`` shingles are counted at a
    time. Other columns are not read. An empty table gives an empty table.
    """
    marks = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return marks.join(classes(marks, id_col, max_bits, cell_limit), "fp").select(id_col, "fp", "component_id")


def classes(marks: DataFrame, id_col: str = "doc_id", max_bits: int = MAX_BITS, cell_limit: int = 64) -> DataFrame:
    """``fp, component_id``: one row for each distinct fingerprint of ``marks`` (``id_col, fp``)."""
    distinct = stored(marks.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    nodes = components(links(distinct.select("fp"), max_bits, cell_limit), "a", "b")
    named = distinct.join(nodes, distinct["fp"] == nodes["node"], "left")
    named = stored(named.select("fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    least = stored(named.groupBy("component").agg(F.min("first").alias("component_id")), "least-ids")
    return named.join(least, "component").select("fp", "component_id")
