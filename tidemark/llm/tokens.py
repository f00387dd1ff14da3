"""Byte-level BPE vocabularies as the workers see them, and token counts.

Tokenizers are read from a file whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

#: The split pattern of byte-level BPE with ``use_regex``: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts below U+0370 without odd digits or separators, where ``re`` agrees and is faster.
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0370-\U0010ffff]")
FULL = regex.compile(PATTERN)
LONG = 200  # bytes from which a pre-token is merged with a heap
NO_MERGE = (1 << 60, -1)
MEMO = 100_000  # pre-tokens a worker remembers at a time


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one letter: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text without special strings."""
    return (FULL if NOT_PLAIN.search(text) else PLAIN).findall(text)


class Vocabulary:
    """Token bytes, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        halves = ((raw(a), raw(b)) for a, b in merges)
        #: two ids to the rank of their merge and its id
        self.pairs = {(self.ids[a], self.ids[b]): (i, self.ids[a + b]) for i, (a, b) in enumerate(halves)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()

    def merge(self, piece: bytes) -> list[int]:
        """BPE ids of one pre-token: apply the lowest-ranked merge, leftmost first, until none fits."""
        if len(piece) > LONG:
            return self._merge_long(piece)
        pairs, none = self.pairs, NO_MERGE
        parts = [self.single[b] for b in piece]
        found = [pairs.get(x, none) for x in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            parts[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = pairs.get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = pairs.get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n for a run of any length."""
        parts: list[int] = [self.single[b] for b in piece]
        left, right = [*range(-1, len(parts) - 1)], [*range(1, len(parts)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (m := self.pairs.get((parts[i], parts[right[i]]))):
                heapq.heappush(heap, (m[0], i, m[1], parts[i], parts[right[i]]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [x for x in parts if x >= 0]

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings proven to be one token when they stand alone.

        A string qualifies if it is a single pre-token and its own merges end in itself.
        """
        out = set()
        for raw in self.ids:
            try:
                s = raw.decode()
            except UnicodeDecodeError:
                continue
            if (m := FULL.match(s)) and m.end() == len(s) and self.merge(raw) == [self.ids[raw]]:
                out.add(s)
        return frozenset(out)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(path)


@functools.cache
def library_tokenizer(path: str):
    """The library's tokenizer, single-threaded: Spark's tasks already fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Counter(dict):
    """Pre-token to token count: whole tokens are known to be one, the rest are merged once and remembered."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[str]) -> None:
        super().__init__()
        self.vocab, self.whole = vocab, whole

    def __missing__(self, piece: str) -> int:
        n = 1 if piece in self.whole else self.cost(piece)
        if len(self) >= MEMO:
            self.clear()
        self[piece] = n
        return n

    def cost(self, piece: str) -> int:
        return len(self.vocab.merge(piece.encode()))


@functools.cache
def counter(path: str) -> tuple:
    vocab = vocabulary(path)
    special = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) or r"(?!)")
    return Counter(vocab, vocab.whole_tokens()), special, sorted(vocab.special)


def count_text(text: str, path: str) -> int:
    """Tokens of one text, special strings in it counted as the library does: one each."""
    counts, special, strings = counter(path)
    if any(s in text for s in strings):
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, pre_tokens(p))) for p in parts)
    return sum(map(counts.__getitem__, pre_tokens(text)))


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A pre-token found among the whole tokens counts one without any merge; only the others
    are merged. Null and empty texts have no bytes and no tokens. One pass, no shuffle.
    Rows with a null id and repeated rows are kept, other columns are not read. Texts may be of any
    length: pre-tokens are counted as they come. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = [count_text(t, tokenizer_path) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
