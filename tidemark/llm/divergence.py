"""Source divergence by exact term counts behind a count-min sketch.

How a source of a language differs from the others: which of its terms are more frequent than in the
language as a whole, and how far its smoothed term probabilities are from those of every other source.

Two passes read the texts. The first merges a count-min sketch of document frequencies: no cell is ever
lower than the true frequency, so a term with a cell below the limit cannot be kept. The second counts
exactly what the sketch lets through; only those terms are shuffled, and their exact document frequency
decides. Pairs of sources meet on the terms that both hold (a sparse join, added up before its shuffle);
terms that one or neither holds enter by sums over counts, never as rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, stored

ONE = 1_000_000_000  # probabilities are whole numbers of this share
PIECE = 1 << 16  # cells of the sketch that travel together
DEPTH = 2  # cells of a term
HELD = 200_000  # entries that a task gathers before it hands them on
#: Bytes that belong to no term become spaces, A to Z become a to z; all bytes of other alphabets are 128 and more.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and characters from U+0080 on."""
    return text.translate(FOLD).split() if text else []


def cells(lang: str, terms: list[bytes], bits: int) -> np.ndarray:
    """The ``DEPTH`` cells of each term, one row of ``2 ** bits`` cells below the other."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    names = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    low = np.uint64((1 << bits) - 1)
    rows = [(names >> np.uint64(32 * d) & low) + np.uint64(d << bits) for d in range(DEPTH)]
    return np.stack(rows, axis=1).astype(np.int64)


def sketch_bits(rows: int) -> int:
    """Cells of a row of the sketch, as a power of two: some 16 for each document, 2 ** 18 to 2 ** 28."""
    return min(28, max(18, (16 * max(1, rows)).bit_length()))


def sketch(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """Which cells of the merged sketch reach ``least``, as bits.

    Each task adds up its own documents, cells end at ``least`` (higher sums decide nothing), and pieces of
    ``PIECE`` cells are merged by number, in as many tasks as there are partitions. The driver receives
    one bit a cell, 64 MB at most.
    """

    def add(mine: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        mine[at] = np.minimum(mine[at].astype(np.int64) + n, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(DEPTH << bits, np.uint8 if least < 256 else np.uint32)
        held: dict[str, Counter] = {}

        def settle() -> None:
            for lang, counts in held.items():
                at, inverse = np.unique(cells(lang, list(counts), bits), return_inverse=True)
                add(mine, at, np.bincount(inverse.ravel(), np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), DEPTH), len(at)).astype(np.int64))
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(set(terms_of(text.as_py())))
            if sum(map(len, held.values())) > HELD:
                settle()
        settle()
        full = np.flatnonzero(mine)
        for piece in np.unique(full // PIECE):
            at = full[np.searchsorted(full, piece * PIECE) : np.searchsorted(full, (piece + 1) * PIECE)]
            yield _row(piece=int(piece), at=(at - piece * PIECE).astype(np.uint16).tobytes(), n=mine[at].astype(np.uint32).tobytes())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                add(sums.setdefault(piece, np.zeros(PIECE, np.uint32)), np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32))
        for piece, n in sums.items():
            yield _row(piece=piece, full=np.packbits(n >= least).tobytes())

    parts = texts.mapInArrow(count, "piece long, at binary, n binary").repartition("piece").mapInArrow(merge, "piece long, full binary")
    out = np.zeros(max(PIECE, DEPTH << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():  # at most DEPTH * 2 ** bits / PIECE rows of 8 KB
        out[row["piece"] * (PIECE // 8) :][: PIECE // 8] = np.frombuffer(row["full"], np.uint8)
    return out


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values.values()], names=list(values))


def _may_reach(lang: str, terms: list[bytes], full: np.ndarray, bits: int) -> np.ndarray:
    at = cells(lang, terms, bits)
    return (full[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def counted(texts: DataFrame, full: np.ndarray, bits: int) -> DataFrame:
    """``lang, source, term, n, df``: partial counts of the terms that the sketch lets through.

    A group without any gets a row with a null term, so no group is lost.
    """
    shared = texts.sparkSession.sparkContext.broadcast(full)
    kinds = [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        groups: set[tuple[str, str]] = set()

        def settle() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = list(n)
                keep = _may_reach(lang, terms, bitmap, bits) if terms else []
                terms = [t for t, ok in zip(terms, keep) if ok]
                columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], [n[t] for t in terms], [df[t] for t in terms]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[k for k, _ in kinds])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                df.update(set(terms))
            groups.update(held)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from settle()
        yield from settle()
        marks = sorted(groups)
        columns = [[a for a, _ in marks], [b for _, b in marks], [None] * len(marks), [0] * len(marks), [0] * len(marks)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[k for k, _ in kinds])

    return texts.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(n: str, total: str, v: str):
    """``1 + floor(ONE * (n + 2) / (total + 2 v))`` in whole numbers; 1 where nothing is kept."""
    parts = f"(cast({n} + 2 as decimal(19,0)) * cast({ONE} as decimal(10,0))) div cast({total} + 2 * {v} as decimal(20,0))"
    return F.expr(f"case when {total} + 2 * {v} = 0 then 1 else 1 + ({parts}) end")


def _gap(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(
    docs: DataFrame,
    least: int = 10,
    top: int = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    bits: int | None = None,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) group of ``docs``.

    A language keeps the terms that stand in at least ``least`` of its documents. In a group with ``n``
    occurrences of a kept term, ``N`` of all ``V`` kept ones, the term's probability is ``1 + floor(10**9 (n + 2)
    / (N + 2 V))``; two probabilities are ``floor((p - q)**2 / (p + q))`` apart. ``part`` is ``pair`` (item: another
    source of the language, value: the distance summed over all kept terms) or ``term`` (item: a term of the
    group that is likelier in it than in the whole language, value: the distance to the language's
    probability, the first ``top``). Ranks start at 1, highest value first, equal values by item.

    Null texts, languages and sources are empty strings. Repeated rows count as often as they occur, ids do not
    matter, other columns are not read. A group without terms has pairs, but no terms; a language
    without kept terms has pairs of value 0. An empty table gives an empty one. ``bits`` sets the width of the
    sketch, by default by the number of rows; it decides what is shuffled, never a result.
    """
    spark = docs.sparkSession
    keep = Scratch()
    texts = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.col(text_col).cast("binary").alias("text"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
    )
    bits = bits or sketch_bits(docs.count())
    full = sketch(texts.select("lang", "text"), bits, least)
    parts = counted(texts, full, bits)
    # each task has added up what it saw; Spark adds up the tasks
    exact = keep.stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "terms")
    whole = exact.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("df").alias("df")).where(F.col("df") >= least)
    whole = keep.stored(whole.select("lang", "term", "all_n"), "kept")
    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    langs = exact.select("lang").distinct().join(langs, "lang", "left").na.fill(0, ["v", "lang_n"])
    found = exact.where("term is not null").join(whole, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
    found = keep.stored(found, "found")
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = exact.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").na.fill(0, ["group_n"]).join(langs, "lang")
    groups = groups.withColumn("zero", _share("0", "group_n", "v"))
    groups = keep.stored(groups, "groups")  # one row a group
    entries = found.join(groups, ["lang", "source"]).withColumn("p", _share("n", "group_n", "v"))
    entries = keep.stored(entries.withColumn("q", _share("all_n", "lang_n", "v")).select("lang", "source", "term", "p", "q"), "shares")
    out = _pairs(entries, groups).unionByName(_terms(entries, top))
    out = stored(out.select("lang", "source", "part", "item", "value", "rank"), "divergence")
    keep.drop(spark)
    return out


def _terms(entries: DataFrame, top: int) -> DataFrame:
    over = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # Spark keeps the first ones of each task before it shuffles


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over all kept terms, from what differs from the distance of two absent terms.

    With f the distance, z a group's probability of an absent term and T its terms: the sum over all terms is
    V f(z, z') + sum over T of f(p, z') - f(z, z') + the same of T' + sum over both of f(p, p') - f(p, z') - f(z, p') + f(z, z').
    The middle sums need one row for each probability that occurs in a group, and the last the shared terms.
    """
    mine = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    both = mine.join(other, "lang").where("a < b")  # as many rows as half the result has
    levels = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    zeros = groups.select("lang", "source", F.col("zero").alias("z"))
    kinds = zeros.select("lang", F.col("z").alias("zb")).distinct()
    alone = levels.join(zeros, ["lang", "source"]).join(kinds, "lang")
    alone = alone.groupBy("lang", "source", "zb").agg(F.sum(F.col("m") * (_gap("p", "zb") - _gap("z", "zb"))).alias("alone"))
    left = entries.join(zeros, ["lang", "source"]).select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = left.select("lang", "term", F.col("a").alias("b"), F.col("pa").alias("pb"), F.col("za").alias("zb"))
    extra = _gap("pa", "pb") - _gap("pa", "zb") - _gap("za", "pb") + _gap("za", "zb")
    shared = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(extra).alias("shared"))
    total = both.join(shared, ["lang", "a", "b"], "left")
    total = total.join(alone.select("lang", F.col("source").alias("a"), "zb", F.col("alone").alias("alone_a")), ["lang", "a", "zb"], "left")
    total = total.join(alone.select("lang", F.col("source").alias("b"), F.col("zb").alias("za"), F.col("alone").alias("alone_b")), ["lang", "b", "za"], "left")
    nil = F.lit(0).cast("long")
    value = F.col("v") * _gap("za", "zb") + sum(F.coalesce(F.col(c), nil) for c in ("alone_a", "alone_b", "shared"))
    total = total.select("lang", "a", "b", value.alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = total.select("lang", ends.alias("end"), "value").select("lang", "end.*", "value", F.lit("pair").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
