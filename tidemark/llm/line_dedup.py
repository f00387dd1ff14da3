"""Line dedup by overlapping three-line windows, DataFrame functions only.

Every run of three consecutive lines is hashed. A window that occurs more than once in
the corpus is repeated; its first occurrence stays and each later one covers its three
lines. A document loses the union of its covered lines, so overlapping windows merge.
Only hashes and positions are shuffled until the last join. The windows of one hash are
reduced to their first occurrence before the shuffle, and the join of all windows with the
repeated ones can be split by key, so a window that a third of all documents hold is no
hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, tied

WINDOW = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_tm_id": F.col(id_col), "_tm_mark": F.xxhash64(text_col)})


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``_tm_id, _tm_mark, p0, p1, .., h1, h2``: the 128-bit hash of every window, and the numbers of its lines.

    Lines are trimmed of white space and counted from 0; lines without anything else are no lines of a window.
    """
    lines = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(_trim(x).alias("body"), i.alias("i")))
    rows = _keyed(docs, id_col, text_col).select("_tm_id", "_tm_mark", F.filter(lines, lambda x: x["body"] != "").alias("lines"))
    rows = rows.where(F.size("lines") >= size)
    # a line's two hashes are computed once, the windows combine them
    line = F.transform("lines", lambda x: F.struct(F.xxhash64(x["body"]).alias("a"), F.xxhash64(F.lit("b"), x["body"]).alias("b"), x["i"].alias("i")))
    once = rows.select("_tm_id", "_tm_mark", line.alias("marks"))

    def window(pos):
        at = [F.get("marks", pos + i) for i in range(size)]
        return F.struct(
            *[m["i"].alias(f"p{i}") for i, m in enumerate(at)], F.xxhash64(*[m["a"] for m in at]).alias("h1"), F.xxhash64(*[m["b"] for m in at]).alias("h2")
        )

    starts = F.sequence(F.lit(0), F.size("marks") - size)
    return once.select("_tm_id", "_tm_mark", F.explode(F.transform(starts, window)).alias("w")).select("_tm_id", "_tm_mark", "w.*")


def _trim(x):
    return F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``_tm_id, _tm_mark, gone``: the rising numbers of lines that later occurrences cover, for documents that have any."""
    all_windows = windows(docs, id_col, text_col, size)
    where = F.struct(F.col("_tm_id").isNull().alias("none"), "_tm_id", "_tm_mark", "p0")
    first = all_windows.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select("h1", "h2", "first"), "repeated")
    later = all_windows.join(first, ["h1", "h2"]).where(
        ~(tied(F.col("_tm_id"), F.col("first._tm_id")) & (F.col("_tm_mark") == F.col("first._tm_mark")) & (F.col("p0") == F.col("first.p0")))
    )
    # at most as many numbers as the document has lines
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(*[f"p{i}" for i in range(size)])))))
    return later.groupBy("_tm_id", "_tm_mark").agg(gone.alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cleaned, plus ``n_lines`` and ``n_removed``.

    The first occurrence of a window is the one with the smallest (id, hash of the text,
    position), null ids last. Removed lines go with their line ends; empty lines stay where
    they are. Columns of the names it adds are replaced, others are kept. Texts with fewer than ``size``
    lines that hold more than white space, empty texts and null texts come back as they are. The work on a
    text is linear in its lines. Rows equal in id and text count as one document: each keeps what the
    others keep. An empty table gives an empty table.
    """
    gone = covered(docs, id_col, text_col, size).withColumnsRenamed({"_tm_id": "_tm_gid", "_tm_mark": "_tm_gmark", "gone": "_tm_gone"})
    rows = _keyed(docs, id_col, text_col)
    rows = rows.join(gone, tied(F.col("_tm_id"), F.col("_tm_gid")) & (F.col("_tm_mark") == F.col("_tm_gmark")), "left")
    rows = rows.withColumn("_tm_parts", F.split(text_col, "\n", -1))
    # what stays are the stretches between lines that go
    ends = F.concat(F.array(F.lit(-1)), "_tm_gone", F.array(F.size("_tm_parts")))
    rows = rows.withColumn("_tm_ends", ends)
    stretch = lambda i: F.slice("_tm_parts", F.get("_tm_ends", i) + 2, F.get("_tm_ends", i + 1) - F.get("_tm_ends", i) - 1)
    clean = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_tm_ends") - 2), stretch)), "\n")
    filled = F.size(F.filter("_tm_parts", lambda x: _trim(x) != ""))
    return rows.select(
        *[F.when(F.col("_tm_gone").isNull(), F.col(c)).otherwise(clean).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col(text_col).isNull(), 0).otherwise(filled).alias("n_lines"),
        F.coalesce(F.size("_tm_gone"), F.lit(0)).alias("n_removed"),
    )
