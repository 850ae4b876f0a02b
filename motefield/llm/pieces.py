"""SentencePiece encoding and decoding over a table of distinct chunks.

A text gets the marker U+2581 in front and in place of each space. Where no piece of the model
has a marker behind another character, no merge can cross from a character to a marker, so
the text falls into chunks - markers and the word behind them - that are segmented one by one:
merges in one chunk neither see nor change another. The same holds around a character that
no longer piece has (the line feed). ``PieceModel`` checks both on the model's own pieces; with a
model that has such pieces a text is one chunk, and all else stays.

Each task keeps a table of the distinct chunks of its texts: chunk, ids, ids as written
numbers, decoded text. A chunk is segmented when the table first meets it; a text is the row
numbers of its chunks in order, and its ids and decoded text are joined back from the table
by position. The table is bounded: full, it starts anew between two batches of texts, which costs
time and changes nothing.

Segmentation of a chunk: the best-scored pair of neighbours that is a piece merges first, the
leftmost of equals; a character that is no piece becomes the ids of its UTF-8 bytes, or the
unknown id in a model without byte pieces.

Null text counts as empty; an empty text has the end id alone and decodes to an empty text. A
literal U+2581 reads as a space and decodes as one. Texts are processed whole; repeated rows give
repeated results, rows of null id too; other columns are not carried, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model format: the marker, and the kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks, and characters of them, that a task's table holds before it starts anew.
MEMORY, MEMORY_CHARS = 400_000, 16 << 20
#: Up to so many characters, looking at all pairs again is faster than a queue.
SHORT = 40
#: Rank of a pair that is no piece.
NEVER = 1 << 60


def _number(raw: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer and the place behind it."""
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message of the model file."""
    at = 0
    while at < len(raw):
        tag, at = _number(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(raw, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(raw, at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A BPE model file whose normalizer is the identity with a dummy prefix."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a BPE model")
        if normal.get(2) or normal.get(3, 1) != 1 or normal.get(4, 1) != 0 or normal.get(5, 1) != 1 or trainer.get(24):
            raise ValueError("the model's normalizer does more than mark spaces")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("the model has user-defined or unused pieces")
        normal_pieces = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal_pieces}, reverse=True))}
        self.rank = {self.pieces[i]: order[scores[i]] for i in normal_pieces}
        self.number = {self.pieces[i]: i for i in normal_pieces}
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = next(i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL and p.encode() == trainer.get(47, b"</s>"))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        longer = [p for p in self.rank if len(p) > 1]
        apart = not any(MARK in p.lstrip(MARK) for p in longer)
        lines = apart and not any("\n" in p for p in longer)
        self.chunk = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s:.+)")

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk."""
        symbols = self._short(list(chunk)) if len(chunk) <= SHORT else self._long(list(chunk))
        ids: list[int] = []
        for symbol in symbols:
            if (found := self.number.get(symbol)) is not None:
                ids.append(found)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in symbol.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _short(self, symbols: list[str]) -> list[str]:
        """Merges by looking at all pairs' ranks again; the same result as ``_long``."""
        rank = self.rank.get
        ranks = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            symbols[at] += symbols.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + symbols[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank(symbols[at] + symbols[at + 1], NEVER)
        return symbols

    def _long(self, symbols: list[str | None]) -> list[str]:
        """Merges from a queue over a doubly linked list, in time n log n."""
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for at in range(n - 1):
            joined = symbols[at] + symbols[at + 1]
            if (found := rank.get(joined)) is not None:
                queue.append((found, at, joined, at + 1))
        heapq.heapify(queue)
        while queue:
            _, at, joined, follow = heapq.heappop(queue)
            left, right = symbols[at], symbols[follow] if after[at] == follow else None
            if left is None or right is None or left + right != joined:
                continue  # stale: one of the two has been merged since
            symbols[at], symbols[follow] = joined, None
            after[at] = beyond = after[follow]
            if beyond < n:
                before[beyond] = at
                if (found := rank.get(more := joined + symbols[beyond])) is not None:
                    heapq.heappush(queue, (found, at, more, beyond))
            if (ahead := before[at]) >= 0 and (found := rank.get(more := symbols[ahead] + joined)) is not None:
                heapq.heappush(queue, (found, ahead, more, at))
        return [s for s in symbols if s is not None]

    def surface(self, ids: list[int]) -> str:
        """The text of pieces: runs of byte pieces read as UTF-8, markers as spaces, control pieces as nothing."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                held.append(byte)
                continue
            if held:
                out.append(_utf8(held))
                held.clear()
            if i == self.unknown:
                out.append(self.unknown_text)
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(_utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their surface without the one space that stands for the text's own marker."""
        marked = next((self.pieces[i].startswith(MARK) for i in ids if self.kinds[i] != CONTROL), False)
        said = self.surface(ids)
        return said[1:] if marked else said


def _utf8(held: bytearray) -> str:
    """Bytes as text; each byte that begins no character becomes U+FFFD by itself."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, raw = [], bytes(held)
        while raw:
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[:size].decode())
                    raw = raw[size:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                raw = raw[1:]
        return "".join(out)


class ChunkTable:
    """Distinct chunks in the order in which they were met; columns by row number."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.number: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.size: list[int] = []
        self.written: list[str] = []
        self.said: list[str] = []
        self.chars = 0

    def rows(self, text: str) -> list[int]:
        """The row numbers of a text's chunks in order; chunks met first become rows."""
        if not text:
            return []
        chunks = self.model.chunk.findall(MARK + text.replace(" ", MARK))
        number = self.number
        found = list(map(number.get, chunks))
        if None in found:
            for at, row in enumerate(found):
                if row is None:
                    chunk = chunks[at]
                    found[at] = number[chunk] if chunk in number else self._add(chunk)
        return found

    def _add(self, chunk: str) -> int:
        ids = self.model.segment(chunk)
        row = self.number[chunk] = len(self.ids)
        self.ids.append(ids)
        self.size.append(len(ids))
        self.written.append(" ".join(map(str, ids)))
        self.said.append(self.model.surface(ids))
        self.chars += len(chunk)
        return row

    def full(self) -> bool:
        return len(self.ids) >= MEMORY or self.chars >= MEMORY_CHARS

    def joined(self, rows: list[int]) -> tuple[int, str, str]:
        """Number of ids, ids as written numbers, decoded text; the end id included."""
        end = str(self.model.end)
        if not rows:
            return 1, end, ""
        written = " ".join(map(self.written.__getitem__, rows))
        return sum(map(self.size.__getitem__, rows)) + 1, f"{written} {end}", "".join(map(self.said.__getitem__, rows))[1:]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """This Python worker's table for the model at ``path``, anew once it is full."""
    held = _TABLES.get(path)
    if held is None or held.full():
        held = _TABLES[path] = ChunkTable(held.model if held else PieceModel(path))
    return held


def _rows(docs: DataFrame, key: str, text: Column | None) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    return rows, f"`{key}` {docs.schema[key].dataType.simpleString()}"


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``key``, ``ids`` (array of int, the end id last) and ``decoded`` (string) of every row of ``docs``."""
    rows, field = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = chunk_table(path)
            at = [table.rows(value.as_py()) for value in batch.column(1)]
            bounds = np.cumsum([0] + [sum(map(table.size.__getitem__, rows)) + 1 for rows in at])
            ids = np.fromiter((i for rows in at for part in (*map(table.ids.__getitem__, rows), (table.model.end,)) for i in part), dtype=np.int32, count=bounds[-1])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([table.joined(rows)[2] for rows in at], pa.string())], [key, "ids", "decoded"])

    return rows.mapInArrow(run, f"{field}, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded`` of every row's ``ids``; null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chunk_table(path).model
        for batch in batches:
            said = [None if value is None else model.decode(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], [key, "decoded"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, decoded string")


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row of ``docs``.

    The same tables and joins as ``encode_documents``; digests are taken where the ids are
    made, so neither ids nor texts go back to the JVM.
    """
    rows, field = _rows(docs, key, text)
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = chunk_table(path)
            n, a, b = [], [], []
            for value in batch.column(1):
                size, written, said = table.joined(table.rows(value.as_py()))
                n.append(size)
                a.append(hashlib.sha256(written.encode()).hexdigest())
                b.append(hashlib.sha256(said.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names)

    return rows.mapInArrow(run, f"{field}, n_tokens long, ids_sha256 string, decoded_sha256 string")
