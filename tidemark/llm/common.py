"""Helpers the corpus operators share: durable intermediate tables and components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _test_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where all tasks run in this process, as in local tests, may it be unset; a temporary folder
    takes its place then.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return _test_folder()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage, and the rows outlive any executor. Columns keep their
    names and types. A join that needs a stored side deals both sides out anew, so
    Spark can split a hot key of the other side. The table goes when the driver ends.
    """
    out, path = _write(df, name)
    place, system = _place(df.sparkSession, path)
    system.deleteOnExit(place)
    return out


class Scratch:
    """Stored tables that an operator needs only until its own result is stored."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append(path)
        return out

    def drop(self, spark: SparkSession) -> None:
        """Delete the tables; no frame that reads them may be used after this."""
        for path in self.paths:
            place, system = _place(spark, path)
            system.delete(place, True)
        self.paths.clear()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _slots(names: list[bytes] | np.ndarray, bits: int, probes: int = 1) -> np.ndarray:
    """The bits of each name, a row of ``probes``; more than one needs 16-byte names, each probe takes 32 bits of them."""
    if probes > 1:
        words = np.frombuffer(b"".join(names), np.uint32).reshape(-1, 4)[:, :probes].astype(np.uint64)
    else:
        words = (names.view(np.uint64) if isinstance(names, np.ndarray) else np.frombuffer(b"".join(names), np.uint64)[::2])[:, None]
    return words & np.uint64((1 << bits) - 1)


MOST_BITS = 28  # of a bitmap: 32 MB


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of a bitmap for ``n`` names, as a power of two: some 16 for each name, 2 ** ``most`` at most."""
    return min(most, max(20, (16 * max(1, n) - 1).bit_length()))


def fills(n: int, bits: int) -> bool:
    """Whether a bitmap of ``n`` names has so few bits to spare that it stops saving work: fewer than four a name."""
    return 4 * n > 1 << bits


def bitmap(names: DataFrame, bits: int, probes: int = 1) -> np.ndarray:
    """A set of 16-byte names or of 64-bit hashes as 2 ** ``bits`` bits, whatever their number.

    It holds every name, and others by chance: it may only save work, never decide. With 16 bits for each name
    one other in 16 is taken for a member by one probe, one in 400 by four.
    """
    longs = names.schema[0].dataType.simpleString() == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << bits >> 6, np.uint64)
        for batch in batches:
            if batch.num_rows:
                slots = _slots(batch.column(0).to_numpy() if longs else batch.column(0).to_pylist(), bits, probes).ravel()
                np.bitwise_or.at(mine, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
        words = mine.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    words = names.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    got = words.toArrow()  # at most 2 ** bits / 64 rows
    full = np.zeros(1 << bits >> 6, np.int64)
    full[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return full


def bitmap_has(names: list[bytes] | np.ndarray, words: np.ndarray, bits: int, probes: int = 1) -> list[bool]:
    """Which names may be in the set."""
    if not len(names):
        return []
    at = _slots(names, bits, probes)
    word = words[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64)
    return (word >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1).tolist()


def tied(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most to a smaller one, and that one has none: the edges are stars."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v", most: int = 60) -> DataFrame:
    """Connected components of an undirected edge table.

    Returns ``node, component``, one row for each node that has an edge to another
    node; ``component`` is the smallest node of its component. Alternates large-star
    and small-star steps until only stars are left, so a chain of n nodes needs
    about log n rounds (more than ``most`` raise an error). Each round is joins and grouped minima,
    and its result is a table in the shared folder. Null ends and loops are dropped. No edges give no rows.
    """
    edges = (
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    keep = Scratch()
    edges = keep.stored(edges, "edges")
    for _ in range(most):
        if _settled(edges):
            break
        last = Scratch()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = last.stored(least, "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = last.stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = last.stored(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        last.paths, keep.paths = last.paths + keep.paths, []
        edges = keep.stored(
            small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        last.drop(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    nodes = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops), "nodes")
    keep.drop(nodes.sparkSession)
    return nodes
