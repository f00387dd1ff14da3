"""Prefix trie of conversations by preorder intervals.

Conversations that start with the same turns share the nodes of a trie; what a prefix cache saves is read off
it. Conversations are ranked lexicographically, so the conversations below a node are an interval of ranks,
and nodes ordered by (first rank, depth) stand in preorder: a subtree is an interval that ends with the leaf of
its last conversation. Leaves and savings of a subtree are differences of prefix sums at its ends.

No step needs a whole conversation, node or rank order in one task. Turns are numbered by one sort over
ranges; a conversation is cut into chunks of ``CHUNK`` turns, chunks are ranked among all distinct ones, and
the ranks of ``CHUNK`` chunks form a chunk of the next level, until each conversation is one. Prefix sums add up
pieces of a sort over ranges. A node's members are partially aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, stored

CHUNK = 16  # turns, or chunks of the level below, that are ranked together
BLOCK = 16  # bits: ids that agree above them are joined into one text before a node's digest
WORDS = r"[^\x20\x09-\x0D]+"


def _summed(keep: Scratch, rows: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``rows`` with the running sum of each column of ``sums`` in ``order``, the row itself included; one sort over ranges.

    The sorted rows are a stored table that knows its pieces, so the sums of the pieces before fit it whoever
    reads it. One row for each piece is joined back.
    """
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_rows = rows.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    schema = sorted_rows.withColumns({"_tm_piece": F.lit(0).cast("long")} | {f"_tm_{c}": F.lit(0).cast("long") for c in sums}).schema
    columns = [rows.columns.index(c) for c in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before = TaskContext.get().partitionId(), [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            running = []
            for k, at in enumerate(columns):
                total = np.cumsum(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)) + before[k]
                before[k] = int(total[-1])
                running.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([piece] * batch.num_rows, pa.int64()), *running], names=schema.names)

    cut = keep.stored(sorted_rows.mapInArrow(run, schema), name)
    pieces = cut.groupBy("_tm_piece").agg(*[F.sum(c).alias(f"_tm_sum_{c}") for c in sums])
    earlier = Window.orderBy("_tm_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shuffle partition
    before = pieces.select("_tm_piece", *[F.coalesce(F.sum(f"_tm_sum_{c}").over(earlier), F.lit(0)).alias(f"_tm_before_{c}") for c in sums])
    joined = cut.join(F.broadcast(before), "_tm_piece")
    return joined.select(*rows.columns, *[(F.col(f"_tm_{c}") + F.col(f"_tm_before_{c}")).alias(f"sum_{c}") for c in sums])


def numbered(keep: Scratch, turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, ord, mark, words`` of every turn: its number from 1, the digest of its role and text, and its words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).alias("one"))
    rows = _summed(keep, rows, [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")], ["one"], "turns")
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = keep.stored(rows.select("conv", F.col("sum_one").alias("at"), mark.alias("mark"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")), "marks")
    first = rows.groupBy("conv").agg(F.min("at").alias("first"))
    return keep.stored(rows.join(first, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("ord"), "mark", "words"), "numbered")


def rebuilt(keep: Scratch, turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """``conv, pos, mark, words`` of the rebuilt conversations, and ``conv, length`` of all of them.

    With ``h`` the crc32 of the id modulo ``most``: the first ``h`` turns are those of conversation
    ``id - id % every``, the others are the conversation's own after its first ``h``.
    """
    convs = turns.groupBy("conv").agg(F.max("ord").alias("length"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = convs.select("conv", "length", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = convs.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_length", F.lit(0)))).drop("base_length")
    convs = keep.stored(convs, "convs")
    # a base lends its first turns, fewer than ``most``, to fewer than 2 * ``every`` conversations
    heads = turns.where(F.col("ord") < most).select(F.col("conv").alias("base"), "ord", "mark", "words")
    lent = convs.where("lent > 0").select("base", "conv", "lent").join(heads, "base").where("ord <= lent").select("conv", F.col("ord").alias("pos"), "mark", "words")
    own = turns.join(convs.select("conv", "h", "lent"), "conv").where("ord > h").select("conv", (F.col("ord") - F.col("h") + F.col("lent")).alias("pos"), "mark", "words")
    sizes = convs.select("conv", (F.col("lent") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    return keep.stored(lent.unionByName(own), "rebuilt"), sizes


def _ranked(keep: Scratch, chunks: DataFrame, name: str) -> DataFrame:
    """``chunks`` with ``code``: numbers in the order of their ``items``, equal for equal ones. Not gapless."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = chunks.select("items").distinct().repartitionByRange(n, "items").sortWithinPartitions("items")
    codes = keep.stored(distinct.withColumn("code", F.monotonically_increasing_id()), f"{name}-codes")  # later partitions have higher numbers
    return keep.stored(chunks.join(codes, "items").select("conv", "chunk", "code"), name)


def chunked(rows: DataFrame, item: Column) -> DataFrame:
    """``conv, chunk, parts``: rows of ``pos`` from 0, ``CHUNK`` at a time, in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", item.alias("item"))))  # at most CHUNK rows
    return rows.groupBy("conv", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.transform(parts, lambda x: x["item"]).alias("parts"))


def _levels(keep: Scratch, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rank of each conversation, and ``conv, chunk, prefix`` for chunks after the first: a digest of all before."""
    level, tables = keep.stored(chunks, "chunks-0"), []
    level = level.select("conv", "chunk", F.transform("parts", lambda x: x["mark"]).alias("items"))
    while True:
        codes = _ranked(keep, level, f"ranks-{len(tables)}")
        tables.append(codes)
        if codes.where("chunk > 0").isEmpty():
            break
        above = chunked(codes.select("conv", F.col("chunk").alias("pos"), "code"), F.struct("code"))
        level = keep.stored(above.select("conv", "chunk", F.transform("parts", lambda x: x["code"]).alias("items")), f"chunks-{len(tables)}")
    ranks = tables[-1].select("conv", F.col("code").alias("rank"))
    prefix = tables[-1].select("conv", F.lit(0).cast("long").alias("chunk"), F.lit("").alias("prefix"))
    for codes in reversed(tables[:-1]):  # from each chunk of the level above to the chunks in it
        parts = chunked(codes.select("conv", F.col("chunk").alias("pos"), "code"), F.struct("code"))
        digest = lambda p, k: F.md5(F.concat(p, F.lit("|"), F.array_join(F.transform(F.slice("parts", 1, k), lambda x: x["code"].cast("string")), ",")))
        parts = parts.join(prefix, ["conv", "chunk"])
        each = F.posexplode(F.transform("parts", lambda x, i: F.when((F.col("chunk") == 0) & (i == 0), F.lit("")).otherwise(digest(F.col("prefix"), i))))
        prefix = parts.select("conv", (F.col("chunk") * CHUNK).alias("from"), each).select("conv", (F.col("from") + F.col("pos")).alias("chunk"), F.col("col").alias("prefix"))
        prefix = keep.stored(prefix, "prefixes")
    return ranks, prefix


def _digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the conversations that end at each node.

    A digest reads its text in order, so one task feeds it; the texts of ids that share all but their last 16
    bits are made before, by as many tasks as there are.
    """
    blocks = ends.groupBy("key", F.shiftright("conv", BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))  # at most 2 ** BLOCK ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        keys.append(last)
                        sums.append(digest.hexdigest())
                    last, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    every: int = 20,
    most: int = 4,
) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the textless root among them.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``; and the interval of the subtree, ``position`` (from 1, in preorder) to ``subtree_end``. For the rules that
    rebuild conversations see :func:`rebuilt`; ``most`` of 1 leaves them as they are.

    Turns are ordered by their number, null first, equal numbers by role and text; null roles and texts are empty. Repeated rows are
    turns of their own. Rows without a conversation id are left out. A rebuilt conversation without turns is a member of the root
    only. Ids are whole numbers; other columns are not read. An empty table has no nodes, not even a root. Digests of turns and
    sequences have 128 bits. Conversations, texts and nodes of any size are cut up; only the digest of the ids that end at one node
    reads its text in one task.
    """
    spark, keep = turns.sparkSession, Scratch()
    rows, sizes = rebuilt(keep, numbered(keep, turns, conv_col, turn_col, role_col, text_col), every, most)
    zero = rows.select("conv", (F.col("pos") - 1).alias("pos"), "mark", "words")
    chunks = chunked(zero, F.struct("mark", "words"))
    empty = sizes.where("length = 0").select("conv", F.lit(0).cast("long").alias("chunk"), F.array().cast(chunks.schema["parts"].dataType).alias("parts"))
    chunks = keep.stored(chunks.unionByName(empty), "parts")
    ranks, prefix = _levels(keep, chunks)
    steps = keep.stored(_steps(chunks, prefix), "steps")
    late = steps.where(f"depth > 1 and depth % {CHUNK} = 1")
    if not late.isEmpty():  # the parent of a chunk's first turn ends the chunk before
        ends = steps.where(f"depth % {CHUNK} = 0").select("conv", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"))
        late = late.drop("parent").join(ends, ["conv", "depth"]).select("conv", "depth", "key", "parent", "words")
        steps = keep.stored(steps.where(f"depth = 1 or depth % {CHUNK} != 1").unionByName(late), "linked")
    top = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"))
    members = steps.unionByName(top)
    nodes = members.join(ranks, "conv").groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("words").alias("words"),
    )
    nodes = keep.stored(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"one": F.lit(1), "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = keep.stored(_summed(keep, nodes, [F.col("first"), F.col("depth")], ["one", "leaf", "saved"], "preorder"), "sums")
    # the last node of a subtree is the leaf of its last conversation
    leaves = nodes.where("leaf = 1").select(F.col("first").alias("last"), *[F.col(f"sum_{c}").alias(f"end_{c}") for c in ("one", "leaf", "saved")])
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = members.join(sizes, "conv").where("depth = length").select("key", "conv")
    out = nodes.join(leaves, "last").join(parents, "parent", "left").join(keep.stored(_digests(ends), "digests"), "key", "left")
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaf") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("sum_one").alias("position"), F.col("end_one").alias("subtree_end"),
    )
    out = stored(out, "trie")
    keep.drop(spark)
    return out


def _steps(chunks: DataFrame, prefix: DataFrame) -> DataFrame:
    """``conv, depth, key, parent, words`` of every turn: keys chain the digests of a chunk's turns, from that of the chunks before."""
    chain = F.aggregate("parts", F.array("prefix"), lambda keys, x: F.array_append(keys, F.md5(F.concat(F.element_at(keys, -1), x["mark"]))))
    rows = chunks.join(prefix, ["conv", "chunk"]).withColumn("chain", chain)
    rows = rows.select("conv", "chunk", "chain", F.posexplode("parts").alias("i", "part"))
    depth = (F.col("chunk") * CHUNK + F.col("i") + 1).cast("long")
    return rows.select("conv", depth.alias("depth"), F.get("chain", F.col("i") + 1).alias("key"), F.get("chain", F.col("i")).alias("parent"), "part.words")
