"""Benchmark decontamination: a BM25 index of test items, searched with every passage.

The items' words form an inverted index with impacts: the BM25 part of a word in an item,
divided by the item's score for its own whole text, so that 1 means the full item. Postings
are in blocks with their largest impact. Items are in classes by length, ``CLASS`` words, four
times that, and so on. A passage is a window of words twice as long as the class, half overlapping,
so any item that stands in a text lies whole in one passage.
Block-max WAND moves through the postings in item order and scores an item only where the
blocks' maxima can reach the threshold. Words of many items do not drive the search: together
they add at most a known share to any one item's score, which is part of every bound. Retrieved items are verified in
windows twice as long as the item itself, half overlapping: enough of the item's weight, of the
question's words and of the answer's words must stand in one of them. So neither the shards nor
the other items change what is found of an item.

The index is as large as the test set, not as the corpus. It is sent to the tasks in shards
of at most ``shard_items`` items of one class; a larger test set means more passes, not larger tasks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stored

K1, B = 1.2, 0.75
BLOCK = 8
CLASS = 64
SHARD_ITEMS = 20_000
SHARD_BYTES = 16 << 20
DENSE = 1 << 22
WORD = re.compile(r"\w+")
HIT = "struct<item_id:bigint,score:double,question:double,answer:double,start:int>"
END = -1


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, what comes before the question; one sentence is split in half."""
    parts = [p for p in (words_of(s) for s in re.split(r"[.?!\n]+", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    all_words = parts[0] if parts else []
    half = (len(all_words) + 1) // 2
    return all_words[:half], all_words[half:]


def class_of(words: int) -> int:
    """The longest length of an item's class: it depends on the item alone."""
    length = CLASS
    while length < words:
        length *= 4
    return length


class Index:
    """Impact-ordered inverted index over test items ``(item_id, text)``."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float], mean: float) -> None:
        self.ids, self.parts, self.lengths = [], [], []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.longest = CLASS
        for n, (item, text) in enumerate(sorted(items)):
            words = words_of(text)
            count = Counter(words)
            weight = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in count.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                postings[w].append((n, x / whole))
            self.ids.append(item)
            self.parts.append(tuple(map(Counter, question_and_answer(text))))
            self.lengths.append(len(words))
            self.longest = max(self.longest, class_of(len(words)))
        self.term = {w: t for t, w in enumerate(postings)}
        self.items = [[n for n, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.tops = [[max(p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.impacts]
        self.most = np.array([max(p) for p in self.impacts] or [0.0])
        # the same block maxima as arrays: entries first[t] to first[t + 1] are those of term t
        self.blocks = -(-len(self.ids) // BLOCK)
        held = [sorted({i // BLOCK for i in p}) for p in self.items]
        self.first = np.cumsum([0, *map(len, held)])
        self.block = np.array([b for h in held for b in h], np.int64)
        self.block_top = np.array(
            [max(x for i, x in zip(p, q) if i // BLOCK == b) for p, q, h in zip(self.items, self.impacts, held) for b in h]
        )
        self.of_item = [dict(zip(i, x)) for i, x in zip(self.items, self.impacts)]
        # the joint share of the most frequent words, as a maximum over the items, after each word
        self.frequent = sorted(range(len(self.items)), key=lambda t: (-len(self.items[t]), t))
        self.splits: dict[float, tuple[np.ndarray, float]] = {}
        sums, self.joint = [0.0] * len(self.ids), []
        for t in self.frequent:
            for n, x in self.of_item[t].items():
                sums[n] += x
            self.joint.append(max(max(self.joint[-1:], default=0.0), max(sums[n] for n in self.of_item[t])))

    def split(self, least: float) -> tuple[np.ndarray, float]:
        """Which terms drive the search, and the most that all others add to an item: half of ``least`` at most."""
        if least in self.splits:
            return self.splits[least]
        quiet = bisect_right(self.joint, least / 2)
        drives = np.ones(len(self.most), bool)
        drives[self.frequent[:quiet]] = False
        self.splits[least] = drives, self.joint[quiet - 1] if quiet else 0.0
        return self.splits[least]

    def search(self, terms: list[int], least: float, reached: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``least``, by block-max WAND; ``reached``: the blocks of items that can have it, in order."""
        drives, rest = self.split(least)
        goal = least - rest - 1e-9
        lists = [[self.items[t][0], 0, t] for t in terms if drives[t]]  # current item, position, term
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= goal:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            if reached is not None:
                k = bisect_left(reached, item // BLOCK)
                if k == len(reached):
                    break
                if (first := reached[k] * BLOCK) > item:
                    self._advance(lists, [x for x in lists if x[0] < first], first)
                    continue
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            shallow, reach = [], 0.0
            for x in ahead:
                b, t = self._block(x, item), x[2]
                if b != END:
                    shallow.append((b, t))
                    reach += self.tops[t][b]
            if reach >= goal:
                if lists[0][0] == item:
                    score = sum(self.of_item[t].get(item, 0.0) for t in terms)
                    if score >= least - 1e-9:
                        found.append((item, score))
                    self._advance(lists, ahead, item + 1)
                else:
                    self._advance(lists, [x for x in ahead if x[0] < item], item)
            else:  # no item before the end of the shortest block can reach the goal
                ends = [self.items[t][min((b + 1) * BLOCK, len(self.items[t])) - 1] for b, t in shallow]
                nexts = [lists[pivot + 1][0]] if pivot + 1 < len(lists) else []
                self._advance(lists, ahead, max(item + 1, min([*(e + 1 for e in ends), *nexts], default=item + 1)))
        return found

    def _block(self, at: list, item: int) -> int:
        """The block of a list that may hold ``item``."""
        places = self.items[at[2]]
        p = bisect_left(places, item, at[1])
        return p // BLOCK if p < len(places) else END

    def _advance(self, lists: list[list], some: list[list], item: int) -> None:
        for x in some:
            places = self.items[x[2]]
            p = bisect_left(places, item, x[1])
            x[0], x[1] = (places[p], p) if p < len(places) else (END, p)
        lists[:] = [x for x in lists if x[0] != END]

    def passages(self, words: list[str], least: float) -> Iterator[tuple[int, list[int]]]:
        """Start and index terms of every passage whose bound reaches ``least`` for some block of items."""
        return ((start, terms) for start, terms, _ in self.reached(words, least))

    def reached(self, words: list[str], least: float) -> Iterator[tuple[int, list[int], list[int]]]:
        """Start and index terms of every passage whose bound reaches ``least`` for some block of items, and those blocks."""
        get, step = self.term.get, self.longest
        drives, rest = self.split(least)
        ids = np.fromiter(map(get, words, repeat(END)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        at = at[drives[ids[at]]]
        if not len(at):
            return
        last = max(0, (len(words) - 1) // step - 1)  # passages start at 0, step, ..., last * step
        windows = np.concatenate([at // step, at // step - 1])
        both = np.concatenate([ids[at], ids[at]])
        fine = (windows >= 0) & (windows <= last)
        keys = np.unique(windows[fine] * len(self.most) + both[fine])
        window, term = keys // len(self.most), keys % len(self.most)
        # every passage against every block of items that one of its terms is in
        sizes = self.first[term + 1] - self.first[term]
        entry = np.arange(sizes.sum()) + np.repeat(self.first[term] - np.cumsum(sizes) + sizes, sizes)
        pair, top = np.repeat(window, sizes) * self.blocks + self.block[entry], self.block_top[entry]
        if (last + 1) * self.blocks > DENSE:
            pair, at = np.unique(pair, return_inverse=True)
            reached = pair[np.bincount(at, top) + rest >= least - 1e-9]
        else:
            reached = np.flatnonzero(np.bincount(pair, top) + rest >= least - 1e-9)
        own: dict[int, list[int]] = {}
        for pair in reached.tolist():  # in order
            own.setdefault(pair // self.blocks, []).append(pair % self.blocks)
        for w, blocks in own.items():
            here = set(ids[w * step : (w + 2) * step].tolist())
            here.discard(END)
            yield w * step, sorted(here), blocks

    def hits(self, text: str, least: float, question: float, answer: float) -> list[dict]:
        """The best verified hit for each item in a text."""
        words, best, seen = words_of(text), {}, set()
        for start, terms, reached in self.reached(words, least):
            retrieved = self.search(terms, least, reached)
            for n, _ in retrieved:
                size = self.lengths[n]
                for at in range(start // size * size, min(start + 2 * self.longest, len(words)), size):
                    if (n, at) in seen:
                        continue
                    seen.add((n, at))
                    window = words[at : at + 2 * size]
                    held = {self.term[w] for w in window if w in self.term}
                    score = sum(self.of_item[t].get(n, 0.0) for t in sorted(held))
                    if score < least - 1e-9:
                        continue
                    have = Counter(window)
                    q, a = (sum((have & p).values()) / max(1, sum(p.values())) for p in self.parts[n])
                    if q >= question and (a >= answer or not self.parts[n][1]):
                        hit = {"item_id": self.ids[n], "score": score, "question": q, "answer": a, "start": at}
                        if n not in best or score > best[n]["score"] + 1e-12:
                            best[n] = hit
        return [best[n] for n in sorted(best)]


def _indexes(items: DataFrame, id_col: str, text_col: str, shard_items: int, shard_bytes: int) -> Iterator[Index]:
    """Indexes over bounded shards of each class of items, with BM25 statistics of all items."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            found = [words_of(t) for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array([len(w) for w in found], pa.int64()), pa.array([class_of(len(w)) for w in found], pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "text", "n", "class", "words"])

    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(spelled, "item long, text string, n long, class long, words array<string>").where("n > 0")
    rows = stored(rows, "items")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    if not sums["n"]:
        return
    frequency = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("d"))
    classes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("class")
    for c in classes.collect():  # few: lengths grow by four
        shards = max(math.ceil(c["n"] / shard_items), math.ceil(c["bytes"] / shard_bytes))
        for s in range(shards):
            mine = rows.where((F.col("class") == c["class"]) & (F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == s))
            own = mine.select(F.explode("words").alias("word")).distinct().join(frequency, "word")
            idf = {w: math.log(1 + (sums["n"] - d + 0.5) / (d + 0.5)) for w, d in own.select("word", "d").collect()}
            yield Index([(r["item"], r["text"]) for r in mine.select("item", "text").collect()], idf, sums["mean"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.6,
    question: float = 0.7,
    answer: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_items: int = SHARD_ITEMS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """All columns of ``docs`` but those it adds: ``contaminated`` and ``hits``.

    ``hits`` has, for each item found, its id, the BM25 score of its best window as a share of
    the item's own, the shares of its question's and answer's words there, and the window's
    first word. A hit needs a score of at least ``least`` and shares of at least ``question`` and
    ``answer``. Null and empty texts have no hits. Items with a null id, or without a word, take
    no part; repeated items are found as often as they are there. Repeated rows are kept. Texts and
    items may be of any length; a text's passages are searched one by one. No documents give no rows, no
    items give no hits. No shuffle of documents.
    """
    spark = docs.sparkSession
    fields = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("start", pa.int32())])
    kept = [c for c in docs.columns if c not in ("contaminated", "hits")]
    out = docs.select(*kept).withColumn("hits", F.array().cast(f"array<{HIT}>"))
    at, shape = kept.index(text_col), out.schema

    def searched(frame: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                before = batch.column(len(kept)).to_pylist()
                hits = [
                    (b or []) + (shared.value.hits(t, least, question, answer) if t else [])
                    for t, b in zip(batch.column(at).to_pylist(), before)
                ]
                columns = [*batch.columns[: len(kept)], pa.array(hits, pa.list_(fields))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "hits"])

        return frame.mapInArrow(run, shape)

    for n, index in enumerate(_indexes(benchmark, item_col, item_text_col, shard_items, shard_bytes)):
        if n:  # each further shard is a pass of its own
            out = stored(out, "searched")
        out = searched(out, spark.sparkContext.broadcast(index))  # at most shard_items items
    return out.withColumn("contaminated", F.size("hits") > 0)
