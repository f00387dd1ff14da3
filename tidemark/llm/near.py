"""Groups of similar documents: SimHash links and rare shingles, verified by Jaccard similarity.

At five-word shingles, texts of similarity 0.8 have 64-bit SimHashes that mostly differ in five
to fifteen bits, far beyond the two bits that the grid join can reach. So the SimHash links of
:mod:`tidemark.llm.simhash` are candidates here together with those of an exact prefix filter,
and a candidate pair becomes a link only if the shingle sets of its texts are similar enough.
Equal word sequences are one text from the start and are never paired.

The prefix filter loses no pair. With the shingles of all texts in one fixed order, two texts of
similarity t share one of the first ``n - ceil(t * n) + 1`` of their n shingles each. Rare ones come
first in that order, so what many documents quote stands in few prefixes. The texts of one such
shingle are a posting. Two facts about a shared shingle prune further and hold for every similar
pair in the first posting that it shares: the sizes differ by no more than the similarity allows,
and enough shingles are left after the shared one in both. A parity sketch bounds how many
shingles are in one of the two texts only.

Postings do not make all pairs. Each text first meets one text of its posting, the one of which the
largest share of its prefix is held by others: the unedited text of a group of edited copies. That is
linear and joins most of a large group. Then every text outside the largest group of its posting is
held against all texts of other groups there, with the bounds as join conditions, so no link is
left out; only the pairs that pass are rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, simhash
from tidemark.llm.common import Scratch, bitmap, bitmap_has, bits_for, components, fills, sliced, stored

SKETCH = 512
WORDS = SKETCH // 64
COUNT_BITS = (20, 26)  # cells of the shingle counts, as powers of two: at least and at most
COUNT_BLOCK = 1 << 16  # cells of a row of counts
MORE_STARS = 1000  # comparisons for each row of the postings beyond which another star round comes first
STAR_ROUNDS = 6
SPAN = 1 << 18  # bytes hashed at a time
SEEN = 100_000  # keys that a task remembers at a time
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def normal(text: bytes | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between them."""
    return b" ".join((text or b"").lower().split())


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        x = np.full(1 << bits, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(norm: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of each shingle of ``normal`` text in order, repeats included.

    Fewer words than ``size`` are one shingle; no words are none. Prefix sums of a polynomial over the
    bytes give any stretch's hash without a loop; it does not depend on where the stretch stands.
    """
    if not norm:
        return np.zeros(0, np.uint64)
    text = np.frombuffer(norm, np.uint8)
    gaps = np.flatnonzero(text == 32)
    count = max(1, len(gaps) + 2 - size)
    starts, ends = np.zeros(count, np.int64), np.full(count, len(text), np.int64)
    starts[1:], ends[:-1] = gaps[: count - 1] + 1, gaps[size - 1 : size - 2 + count]
    out, at = np.empty(count, np.uint64), 0
    while at < count:  # one pass for all but very long texts
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN, side="right")))
        first, last = int(starts[at]), int(ends[upto - 1])
        powers, inverses = _powers(max(18, (last - first).bit_length()))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((text[first:last].astype(np.uint64) + np.uint64(1)) * powers[: last - first], out=sums[1:])
        s, e = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = (sums[e] - sums[s]) * inverses[s]
        at = upto
    return _mixed(out)


def distinct(found: np.ndarray) -> np.ndarray:
    """The different hashes, rising."""
    found = np.sort(found)
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def sketch(found: np.ndarray) -> np.ndarray:
    """For each of ``SKETCH`` cells, whether an odd number of shingles falls in it; 64 cells a number.

    Two sketches differ in no more cells than there are shingles in just one of the two sets.
    """
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-6) + 1 if n else 0


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), text_col)
    return docs.withColumns({"_tm_key": key, "_tm_mark": F.xxhash64(text_col)})


def count_bits(rows: int) -> int:
    """Cells for the shingle counts of so many texts: some 64 a text, so that they tell rare shingles from others at any size."""
    return min(COUNT_BITS[1], max(COUNT_BITS[0], (64 * max(1, rows) - 1).bit_length()))


def _cells(found: np.ndarray, bits: int) -> np.ndarray:
    return (found & np.uint64((1 << bits) - 1)).astype(np.int64)


def _marks(docs: DataFrame, id_col: str, text_col: str, size: int, bits: int) -> DataFrame:
    """``id, key, mark, norm, fp`` for each row, and a row for each task with its shingle counts by cell, ``cells``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "key", "mark", "norm", "fp", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, types = np.zeros(1 << bits, np.uint8), None
        for batch in sliced(batches):
            types = [c.type for c in batch.columns[:3]]
            norms, fps, sets = [], [], []
            for text in batch.column(3).to_pylist():
                norm = normal(text)
                found = shingle_hashes(norm, size)
                norms.append(xxhash.xxh3_128_digest(norm))
                fps.append(simhash.majority(found))
                sets.append(_cells(distinct(found), bits))
            at, n = np.unique(np.concatenate(sets), return_counts=True)
            mine[at] += np.minimum(n, 255 - mine[at].astype(np.int64)).astype(np.uint8)
            made = [pa.array(norms, pa.binary()), pa.array(fps, pa.int64()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=names)
        if types:
            last = [pa.nulls(1, t) for t in (*types, pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*last, pa.array([zlib.compress(mine, 1)], pa.binary())], names=names)

    rows = _keys(docs, id_col, text_col)
    rows = rows.select(F.col(id_col).alias("id"), F.col("_tm_key").alias("key"), F.col("_tm_mark").alias("mark"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, mark long, norm binary, fp long, cells binary")


def _counts(marks: DataFrame, bits: int) -> np.ndarray:
    """About how many texts' shingles fall in each of 2 ** ``bits`` cells; a task counts to 255, all together to 65,535.

    The counts only order shingles. Any order is right, a good one puts frequent shingles last.
    """
    blocks = (1 << bits) // COUNT_BLOCK

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                more = np.frombuffer(zlib.decompress(cells), np.uint8)
                mine += np.minimum(more, 65535 - mine)
        rows = mine.reshape(blocks, COUNT_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = sums.setdefault(block, np.zeros(COUNT_BLOCK, np.uint16))
                mine += np.minimum(np.frombuffer(cells, np.uint16), 65535 - mine)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["block", "cells"])

    shape = "block int, cells binary"
    tables = marks.where(F.col("cells").isNotNull()).select("cells").mapInArrow(add, shape)
    full = np.zeros((blocks, COUNT_BLOCK), np.uint16)
    for block, cells in tables.repartition("block").mapInArrow(merge, shape).toLocalIterator():  # 2 ** bits numbers of two bytes, 128 MB at most
        full[block] = np.frombuffer(cells, np.uint16)
    return full.ravel()


def _prefixes(rows: DataFrame, spelled: DataFrame, size: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """``norm, size, s0..s7, firsts``: each text's sketch and its rarest shingles, rarest first.

    ``rows`` are ``key, text``; ``spelled`` has the key of one row of each word sequence. Others come, too, where a bitmap
    of the keys has false hits; where so many would come that their prefixes crowd the postings, they go before.
    """
    spark, n, cell_bits = rows.sparkSession, spelled.count(), len(counts).bit_length() - 1
    bits = bits_for(n, common.MOST_BITS)
    shared, wanted = spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(bitmap(spelled.select("key"), bits))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            norms, sizes, sketches, firsts = [], [], [], []
            for text in _fresh(batch, wanted.value, bits, seen):
                norm = normal(text)
                found = distinct(shingle_hashes(norm, size))
                order = np.lexsort((found, shared.value[_cells(found, cell_bits)]))
                norms.append(xxhash.xxh3_128_digest(norm))
                sizes.append(len(found))
                sketches.append(sketch(found))
                firsts.append(found[order[: prefix_size(len(found), similarity)]].view(np.int64))
            table = np.array(sketches, np.int64).reshape(len(norms), WORDS)
            made = [pa.array(norms, pa.binary()), pa.array(sizes, pa.int32()), *[pa.array(table[:, i]) for i in range(WORDS)]]
            yield pa.RecordBatch.from_arrays([*made, pa.array(firsts, pa.list_(pa.int64()))], names=["norm", "size", *SKETCHES, "firsts"])

    out = rows.mapInArrow(run, f"norm binary, size int, {_LONGS}, firsts array<long>")
    if fills(n, bits):
        out = out.groupBy("norm").agg(*[F.first(c).alias(c) for c in ("size", *SKETCHES, "firsts")])
    return out


def _fresh(batch: pa.RecordBatch, wanted: np.ndarray, bits: int, seen: set[int]) -> list[bytes]:
    """The texts of ``key, text`` rows whose key is wanted and has not come to this task before."""
    if len(seen) > SEEN:
        seen.clear()
    keys, keep = batch.column(0).to_numpy(), []
    for i in np.flatnonzero(bitmap_has(keys, wanted, bits)):
        if (key := int(keys[i])) not in seen:
            seen.add(key)
            keep.append(i)
    return batch.column(1).take(pa.array(keep, pa.int32())).to_pylist()


SKETCHES = [f"s{i}" for i in range(WORDS)]
_LONGS = ", ".join(f"{s} long" for s in SKETCHES)
MEMBER = ["norm", "size", "pos", *SKETCHES]


def _postings(prefixes: DataFrame, keep: Scratch) -> DataFrame:
    """``shingle, norm, size, pos, s0..s7, held``: the prefix shingles that other rows have in their prefixes, too.

    ``pos`` is the shingle's place in the prefix, ``held`` about the share of the prefix that others have. A bitmap whose size
    follows the number of shared shingles leaves the others in their tasks; beyond ``MOST_BITS`` a join with the shared ones does,
    which has no limit.
    """
    twice = prefixes.select(F.explode("firsts").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle")
    twice = keep.stored(twice, "twice")
    n = twice.count()
    bits = bits_for(n, common.MOST_BITS)
    if fills(n, bits):
        return _met(prefixes, twice)
    shared = prefixes.sparkSession.sparkContext.broadcast(bitmap(twice, bits))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, shingles, places, held = [], [], [], []
            for i, firsts in enumerate(batch.column("firsts")):
                found = firsts.values.to_numpy() if firsts.is_valid else np.zeros(0, np.int64)
                hit = np.flatnonzero(bitmap_has(found, shared.value, bits))
                if len(hit):
                    rows.append(np.full(len(hit), i))
                    shingles.append(found[hit])
                    places.append(hit)
                    held.append(np.full(len(hit), len(hit) / len(found)))
            if rows:
                at = pa.array(np.concatenate(rows))
                made = [pa.array(np.concatenate(shingles)), *[batch.column(c).take(at) for c in ("norm", "size")], pa.array(np.concatenate(places).astype(np.int32))]
                made += [batch.column(s).take(at) for s in SKETCHES] + [pa.array(np.concatenate(held))]
                yield pa.RecordBatch.from_arrays(made, names=["shingle", *MEMBER, "held"])

    found = prefixes.mapInArrow(run, f"shingle long, norm binary, size int, pos int, {_LONGS}, held double")
    # rows of one word sequence are one text
    return found.groupBy("shingle", "norm").agg(*[F.first(c).alias(c) for c in (*MEMBER[1:], "held")])


def _met(prefixes: DataFrame, twice: DataFrame) -> DataFrame:
    """The same by joins: shingles without sketches meet the shared ones, and only what is left meets the sketches."""
    places = prefixes.select("norm", F.posexplode("firsts").alias("pos", "shingle")).groupBy("shingle", "norm").agg(F.min("pos").alias("pos"))
    left = places.join(twice, "shingle")
    sums = left.groupBy("norm").agg(F.count(F.lit(1)).alias("k"))
    texts = prefixes.groupBy("norm").agg(*[F.first(c).alias(c) for c in ("size", *SKETCHES)], F.first(F.size("firsts")).alias("all"))
    out = left.join(texts, "norm").join(sums, "norm")
    return out.select("shingle", *MEMBER, (F.col("k") / F.col("all")).alias("held"))


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether two members of a posting can be similar and have it as their first one; true for every similar pair."""
    na, nb = F.col(f"{a}.size"), F.col(f"{b}.size")
    sized = F.least(na, nb) >= F.greatest(na, nb) * F.lit(similarity) - 1e-6
    left = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))  # the shared shingle and what comes after it
    enough = left >= (na + nb) * F.lit(similarity / (1 + similarity)) - 1e-6
    unlike = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCHES), F.lit(0))
    return sized & enough & (unlike <= (na + nb) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(members: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: each member of a posting with the posting's centre, where they can be similar."""
    met = members.alias("m").join(centres.select("shingle", F.struct("c.*").alias("c")).alias("x"), "shingle")
    met = met.select(F.struct(*[F.col(f"m.{k}") for k in MEMBER]).alias("m"), F.col("x.c").alias("c")).where(_may_link("m", "c", similarity))
    return met.select(F.col("m.norm").alias("a"), F.col("c.norm").alias("b"))


def _centres(members: DataFrame) -> DataFrame:
    """``shingle, n, c``: the size of each posting of two texts or more, and its centre."""
    best = F.max(F.struct("held", *MEMBER)).alias("c")
    return members.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1")


def _simhash_pairs(marks: DataFrame, keep: Scratch) -> DataFrame:
    """``a, b``: texts of one fingerprint with its first text, and first texts of linked fingerprints."""
    texts = keep.stored(marks.select("norm", "fp").distinct(), "texts")
    firsts = keep.stored(texts.groupBy("fp").agg(F.min("norm").alias("pick")), "firsts")
    same = texts.join(firsts, "fp").select(F.col("norm").alias("a"), F.col("pick").alias("b"))
    near = simhash.links(firsts.select("fp"))
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("pick").alias("pa")), "a")
    near = near.join(firsts.select(F.col("fp").alias("b"), F.col("pick").alias("pb")), "b")
    return same.unionByName(near.select(F.col("pa").alias("a"), F.col("pb").alias("b")))


def _apart(members: DataFrame, nodes: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """The members of postings that have more than one group, with ``group``; and ``shingle, main, out, n`` of those."""
    grouped = members.join(nodes.withColumnRenamed("node", "norm"), "norm", "left")
    grouped = keep.stored(grouped.withColumn("group", F.coalesce("component", "norm")).drop("component"), "grouped")
    sizes = grouped.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("shingle").agg(F.max_by("group", F.struct("k", "group")).alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("out"))
    main = keep.stored(main.where("out > 0"), "main")
    return keep.stored(grouped.join(main.select("shingle", "main"), "shingle"), "apart"), main


def _across(apart: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: every pair of texts of a posting that are in different groups and can be similar."""
    columns = [F.struct(*MEMBER, "group").alias("m"), (F.col("group") == F.col("main")).alias("in_main")]
    # similar texts are in one class of sizes or in neighbours
    level = F.floor(F.log("size") / -math.log(similarity)) if similarity < 1 else F.col("size").cast("long")
    every = apart.select("shingle", level.alias("level"), *columns)
    near = F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level")
    outside = every.where("not in_main").select("shingle", near, F.col("m").alias("o"))
    apart_still = (F.col("o.group") != F.col("m.group")) & (F.col("in_main") | (F.col("o.norm") < F.col("m.norm")))
    met = outside.join(every, ["shingle", "level"]).where(apart_still & _may_link("o", "m", similarity))
    return met.select(F.col("o.norm").alias("a"), F.col("m.norm").alias("b"))


def _held(rows: DataFrame, involved: DataFrame, size: int) -> DataFrame:
    """``norm, held``: the shingle sets of the texts that pairs need; no other text leaves its task."""
    bits = bits_for(involved.count(), common.MOST_BITS)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(involved.select("key"), bits))  # of bounded size; false hits are joined away

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches):
            norms = [normal(t) for t in _fresh(batch, shared.value, bits, seen)]
            held = [distinct(shingle_hashes(n, size)).tobytes() for n in norms]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(n) for n in norms], pa.binary()), pa.array(held, pa.binary())], names=["norm", "held"])

    return rows.mapInArrow(sets, "norm binary, held binary").groupBy("norm").agg(F.first("held").alias("held"))


def _verified(rows: DataFrame, spelled: DataFrame, pairs: DataFrame, size: int, similarity: float, keep: Scratch) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    involved = pairs.select(F.col("a").alias("norm")).unionByName(pairs.select(F.col("b").alias("norm"))).distinct()
    involved = keep.stored(spelled.join(involved, "norm", "left_semi"), "involved")
    held = keep.stored(_held(rows, involved, size), "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if min(len(x), len(y)) < (similarity - 1e-6) * max(len(x), len(y)):
                    continue
                ours, theirs = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(ours, theirs, assume_unique=True))
                if both >= similarity * (len(ours) + len(theirs) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int32())) for c in (0, 1)], names=["a", "b"])

    full = pairs.join(held.select(F.col("norm").alias("a"), F.col("held").alias("x")), "a")
    full = full.join(held.select(F.col("norm").alias("b"), F.col("held").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def connected(docs: DataFrame, marks: DataFrame, bits: int, similarity: float, shingle_words: int, id_col: str, text_col: str, more_stars: float = MORE_STARS) -> DataFrame:
    """``node, component``: the word sequences that have links of at least ``similarity``, and their groups."""
    keep = Scratch()
    known = marks.where(F.col("norm").isNotNull())
    rows = _keys(docs, id_col, text_col).select(F.col("_tm_key").alias("key"), F.col(text_col).cast("binary").alias("text"))
    # one row of each word sequence is enough
    spelled = keep.stored(known.groupBy("norm").agg(F.min("key").alias("key")), "spelled")
    prefixes = keep.stored(_prefixes(rows, spelled, shingle_words, similarity, _counts(marks, bits)), "prefixes")
    postings = keep.stored(_postings(prefixes, keep), "postings")
    centres = keep.stored(_centres(postings), "centres")
    near = _ordered(_simhash_pairs(known, keep))
    pairs = keep.stored(_ordered(_stars(postings, centres, similarity)).unionByName(near).distinct(), "pairs")
    check = lambda pairs: keep.stored(_verified(rows, spelled, pairs, shingle_words, similarity, keep), "alike")
    before, nodes = math.inf, components(check(pairs), "a", "b")
    # a posting of two texts has no pair but its star
    members = keep.stored(postings.join(centres.where("n > 2").select("shingle"), "shingle"), "members")
    for _ in range(STAR_ROUNDS + 1):
        apart, main = _apart(members, nodes, keep)
        work = main.agg(F.sum(F.col("out") * F.col("n"))).first()[0] or 0
        # more stars save comparisons only while groups grow by them
        if work <= more_stars * members.count() or work > 0.9 * before:
            break
        before = work
        outside = keep.stored(_centres(apart.where("group != main")), "outside")
        nodes = _joined(nodes, check(keep.stored(_ordered(_stars(apart, outside, similarity)), "more")))
    last = keep.stored(_ordered(_across(apart, similarity)).join(pairs, ["a", "b"], "left_anti"), "across")
    nodes = _joined(nodes, check(last))
    keep.drop(docs.sparkSession)
    return nodes


def _joined(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """The components after further links."""
    if more.isEmpty():
        return nodes
    return components(more.unionByName(nodes.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")


def groups(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle_words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    more_stars: float = MORE_STARS,
) -> DataFrame:
    """``id, key, mark, component, stays`` for every row: its group, and whether it is the one that stays.

    Groups are connected components over all links of at least ``similarity``. The row with the smallest id
    stays, null ids last; of rows equal in id, the one of the smallest hash. Texts without a word are
    one group, and null counts as empty. Repeated rows are all returned. Texts may be of any length:
    what a task holds grows with the longest text. An empty table gives an empty table.
    ``more_stars`` decides about effort, not about results.
    """
    keep = Scratch()
    bits = count_bits(docs.count())
    marks = keep.stored(_marks(docs, id_col, text_col, shingle_words, bits), "marks")
    nodes = connected(docs, marks, bits, similarity, shingle_words, id_col, text_col, more_stars)
    labelled = marks.where(F.col("norm").isNotNull()).select("id", "key", "mark", "norm").join(nodes.withColumnRenamed("node", "norm"), "norm", "left")
    labelled = stored(labelled.withColumn("component", F.coalesce("component", "norm")), "labelled")
    keep.drop(docs.sparkSession)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "mark")
    first = stored(labelled.groupBy("component").agg(F.min(order).alias("first")), "first")
    out = labelled.join(first, "component")
    stays = (F.col("key") == F.col("first.key")) & (F.col("mark") == F.col("first.mark"))
    return out.select("id", "key", "mark", "component", stays.alias("stays"))


def keep_one(
    docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of similar documents, all columns kept.

    Rows equal in id and text are one document, of which one row stays. For nulls, empty and long texts,
    ties and empty tables see :func:`groups`. Columns whose names start with ``_tm_`` are not allowed.
    """
    stays = groups(docs, similarity, shingle_words, id_col, text_col).where("stays").select(
        F.col("key").alias("_tm_key"), F.col("mark").alias("_tm_mark")
    )
    rows = _keys(docs, id_col, text_col).join(stays.distinct(), ["_tm_key", "_tm_mark"], "left_semi")
    rows = rows.withColumn("_tm_nth", F.row_number().over(Window.partitionBy("_tm_key", "_tm_mark").orderBy(F.lit(1))))
    return rows.where("_tm_nth = 1").select(*docs.columns)
