"""BPE encoding that encodes each chunk shared by documents once, and decoding.

A rolling hash over the bytes cuts every text where its content says so; texts that share a
passage share its chunks. The hashes of chunks that occur more than once are counted over
the whole corpus, each such chunk is encoded once into a table, and documents take its ids
from there; chunks that occur once are encoded where they are. At every join of two chunks
the ids near it may differ from those of the whole text: a window around the join is
encoded again, and is widened until the ids at both its ends agree with what the chunks
have. A window starts and ends where white space follows other text. No pre-token and no
special string can cross such a place, so agreement there is exact.

A document without a shared chunk never leaves its task. Which chunks are shared reaches
the tasks as a bitmap; a false hit only costs its shuffle, so the bitmap may fill up without
harm to the result. A document with shared chunks is dealt out once with its text, to meet
their ids; only the names of its chunks are stored.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, bitmap_has, bits_for, sliced, stored, tied
from tidemark.llm.tokens import MEMO, byte_letters, library_tokenizer, pre_tokens, vocabulary

WINDOW = 32  # bytes a cut depends on
MEAN_BITS = 10  # a cut every 1024 bytes on average
LEAST, MOST = 256, 8192  # bytes of a chunk, but for the last
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=11) for b in range(256)], np.uint32)
#: White space under every definition in use, after a character that is none under any.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
PROBES = 4  # bits of the bitmap that a chunk must find set
REACH = 96  # characters to either side of a join that are searched first


def _candidates(data: np.ndarray) -> np.ndarray:
    """Byte positions at which a chunk may start: the hash of the 32 bytes before has its top bits zero."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    at = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def cuts(texts: pa.Array) -> list[list[int]]:
    """For each UTF-8 text the byte offsets of its chunks' ends; none for empty or null texts."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data else np.zeros(0, np.uint8)
    base = int(ends[0])
    where = _candidates(raw[base:]) + base
    lo, hi = np.searchsorted(where, ends[:-1], "right").tolist(), np.searchsorted(where, ends[1:], "left").tolist()
    found, out = where.tolist(), []
    for row, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        mine, last = [], start
        for c in [*found[lo[row] : hi[row]], end]:
            while c - last > MOST:
                forced = last + MOST
                while raw[forced] & 0xC0 == 0x80:
                    forced -= 1
                mine.append(forced - start)
                last = forced
            if c - last >= LEAST and c < end:
                mine.append(c - start)
                last = c
        if end > start:
            mine.append(end - start)
        out.append(mine)
    return out


def _name(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class Encoder(dict):
    """Pre-token to the bytes of its ids, remembered up to a bound."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.vocab = vocabulary(path)
        self.model = library_tokenizer(path).model
        self.packed = "H" if len(self.vocab.bytes) <= 1 << 16 else "i"  # of ids in tables
        self.letters = [byte_letters()[b] for b in range(256)]
        self.strings = sorted(self.vocab.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.strings)) + ")") if self.strings else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        spelled = "".join(map(self.letters.__getitem__, piece.encode()))
        ids = self[piece] = array("i", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(text)))

    def encode(self, text: str) -> array:
        """Ids of a text that starts and ends at a boundary of the whole text."""
        if any(s in text for s in self.strings):
            parts = self.special.split(text)
            return array("i", b"".join(array("i", [self.vocab.special[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts)))
        return array("i", self._plain(text))

    def decode(self, ids: array) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, text: str, ends: list[int], known: list[array | None]) -> array:
        """Ids of ``text`` from its chunks, which end at the character offsets ``ends``; None: not encoded yet."""
        out, at = array("i"), 0
        for end, ids in zip(ends, known):
            ids = self.encode(text[at:end]) if ids is None else ids
            if at == 0:
                out += ids
            else:
                self._join(out, ids, text, at, end)
            at = end
        return out

    def _join(self, out: array, ids: array, text: str, at: int, end: int) -> None:
        """Append the chunk ``text[at:end]`` to ``out``, which holds the ids of ``text[:at]``."""
        reach = REACH
        while True:
            lo, hi = max(0, at - reach), min(end, at + reach)
            left = [m.start() for m in SAFE.finditer(text, lo, at)][-2:]
            right = [m.start() for m in SAFE.finditer(text, at + 1, hi)][:2]
            left = left if len(left) == 2 else [0, 0] if lo == 0 else None
            right = right if len(right) == 2 else [end, end] if hi == end else None
            if left and right:
                (a2, a1), (b1, b2) = left, right
                before, after = self.encode(text[a2:a1]), self.encode(text[b1:b2])
                tail, head = before + self.encode(text[a1:at]), self.encode(text[at:b1]) + after
                again = self.encode(text[a2:b2])
                if (
                    out[len(out) - len(tail) :] == tail
                    and ids[: len(head)] == head
                    and again[: len(before)] == before
                    and again[len(again) - len(after) :] == after
                ):
                    del out[len(out) - len(tail) :]
                    out += again
                    out += ids[len(head) :]
                    return
            if lo == 0 and hi == end:  # nothing is left to agree with: the whole of both
                del out[:]
                out += self.encode(text[:end])
                return
            reach *= 4


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _chunked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes, list[int], list[bytes]]]:
    """Row, text, chunk ends and chunk names."""
    texts = batch.column(column)
    for row, (text, ends) in enumerate(zip(texts.to_pylist(), cuts(texts))):
        text = text or b""
        yield row, text, ends, [_name(text[a:b]) for a, b in zip([0, *ends], ends)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))


def _shared(rows: DataFrame, bits: int | None) -> tuple[np.ndarray, int]:
    """A bitmap of the chunks that occur more than once, and its bits as a power of two."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen = [n for _, _, _, names in _chunked(batch, 0) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary())], names=["name"])

    found = rows.select("text").mapInArrow(names, "name binary").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    twice = stored(found.where("n > 1").select("name"), "shared")
    bits = bits or bits_for(twice.count())
    return bitmap(twice, bits, PROBES), bits


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decode: bool = False,
    bitmap_bits: int | None = None,
) -> DataFrame:
    """``id_col, ids`` (array<int>) for every row, and with ``decode`` the ``decoded`` text of the ids.

    ``ids`` are those of the tokenizers library for the whole text without added special
    tokens; special strings in a text become their ids. Null and empty texts give an empty
    list. Repeated rows and rows with a null id are kept, other columns are not read. Texts may be of any
    length: chunks are bounded, a task holds its longest text. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    full, bitmap_bits = _shared(rows, bitmap_bits)
    shared = spark.sparkContext.broadcast(full)  # its size follows the number of shared chunks, 32 MB at most
    result = f"id {kind}, ids array<int>" + ", decoded string" * decode

    def texts_of_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, texts = [], []
            for _, text, ends, own in _chunked(batch, 0):
                if own:
                    for a, b, n, hit in zip([0, *ends], ends, own, bitmap_has(own, shared.value, bitmap_bits, PROBES)):
                        if hit:
                            names.append(n)
                            texts.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], names=["name", "text"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in sliced(batches):
            ids = [array(enc.packed, enc.encode(t.decode())).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["name", "ids"])

    def waiting(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """Documents that may hold shared chunks: with their texts, or with the names of these chunks."""
        for batch in sliced(batches):
            keep, names = [], []
            for row, _, _, own in _chunked(batch, 2):
                if own and any(hit := bitmap_has(own, shared.value, bitmap_bits, PROBES)):
                    keep.append(row)
                    names.append([n for n, h in zip(own, hit) if h])
            kept = batch.take(pa.array(keep, pa.int32()))
            if whole:
                yield kept
            else:
                yield pa.RecordBatch.from_arrays([*kept.columns[:2], pa.array(names, pa.list_(pa.binary()))], names=["id", "mark", "names"])

    def finished(column: pa.Array, ids: list[array], enc: Encoder) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32)
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        out = [column, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        if decode:
            out.append(pa.array([enc.decode(x) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    def assemble(enc: Encoder, text: bytes, ends: list[int], known: list[array | None]) -> array:
        pieces = [text[a:b].decode() for a, b in zip([0, *ends], ends)]
        return enc.joined("".join(pieces), np.cumsum([len(p) for p in pieces]).tolist(), known)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in sliced(batches):
            keep, out = [], []
            for row, text, ends, own in _chunked(batch, 1):
                if not own or not any(bitmap_has(own, shared.value, bitmap_bits, PROBES)):
                    keep.append(row)
                    out.append(assemble(enc, text, ends, [None] * len(ends)))
            kept = batch.column(0).take(pa.array(keep, pa.int32()))
            yield finished(kept, out, enc)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in sliced(batches):
            given, out = batch.column(2).to_pylist(), []
            for row, text, ends, own in _chunked(batch, 1):
                have = {x["name"]: x["ids"] for x in given[row] or ()}
                known = [array("i", array(enc.packed, have[n])) if n in have else None for n in own]
                out.append(assemble(enc, text, ends, known))
            yield finished(batch.column(0), out, enc)

    chunks = rows.select("text").mapInArrow(texts_of_hits, "name binary, text binary")
    chunks = chunks.groupBy("name").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = stored(chunks.select("name", "text").mapInArrow(encode_chunks, "name binary, ids binary"), "chunks")
    named = stored(rows.mapInArrow(lambda batches: waiting(batches, False), f"id {kind}, mark long, names array<binary>"), "pending")
    wanted = named.select("id", "mark", F.explode("names").alias("name")).distinct().join(chunks, "name")
    # a document's own chunks: never more than it has
    wanted = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("name", "ids")).alias("given"))
    wanted = wanted.withColumnsRenamed({"id": "wid", "mark": "wmark"})
    # found again, not stored: naming chunks costs little, a table of these texts would be some 0.3 of the input
    pending = rows.mapInArrow(lambda batches: waiting(batches, True), f"id {kind}, mark long, text binary")
    full = pending.join(wanted, tied(pending["id"], F.col("wid")) & (pending["mark"] == F.col("wmark")), "left")
    full = full.select("id", "text", "given").mapInArrow(together, result)
    return rows.select("id", "text").mapInArrow(alone, result).unionByName(full).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded``: the text of each id list, special tokens included; null lists count as empty."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in sliced(batches):
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
