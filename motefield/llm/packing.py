"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Harmonic packing puts a piece of length in (C/(k+1), C/k] into class k and fills each bin
of that class with exactly k pieces, so that bins of a class need nothing but a counter and
every worker fills its own. Because documents may be cut, a document is cut into whole
capacities and then into the binary digits of what is left, and only the classes
k = 1, 2, 4, ... C occur: k pieces of C/k tokens fill a bin without padding. A worker's
last, unfilled bin of a class is dealt out again as bins whose number of pieces, and so
whose total, is a power of two; those need no padding either. A worker holds at most k - 1
pieces of each class back, 2C in all, whatever it has read.

No shuffle, no state between workers: a task that is run again gives the same sequences.

Pieces are many for that: a document of n tokens has n / C whole ones and one for each binary
digit of the rest that is set, five on average at C = 1,024.

Null text counts as empty; an empty text is the end mark alone. Repeated rows are packed as
documents of their own. An empty table gives no pieces. Other columns are not carried.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.bpe import byte_letters

#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the white space of that pattern. A run of so many is one pre-token, but for its
#: last character before other text; it is encoded apart, as the pattern matcher keeps a state
#: for each character of a run and gives up at about a million.
#: Texts of at most ``WIDE`` characters can hold no run that long and are not searched for one.
WIDE = 500_000
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"

_LOADED: dict[str, tiktoken.Encoding] = {}


def byte_vocabulary(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary file at ``path``, read once in each Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)
    return _LOADED[path]


def encode(vocab: tiktoken.Encoding, text: str, wide: int = WIDE) -> np.ndarray:
    """Ids of a whole text, special tokens in it included."""
    if len(text) <= wide:
        return vocab.encode_to_numpy(text, allowed_special="all").astype("<u4")
    parts, at = [], 0
    for run in LONG_SPACE.finditer(text):
        # the last character belongs to what follows, unless the text or its special token does
        last = run.end() == len(text) or any(text.startswith(mark, run.end()) for mark in vocab.special_tokens_set)
        stop = run.end() if last else run.end() - 1
        parts += [vocab.encode_to_numpy(text[at : run.start()], allowed_special="all"), np.array(vocab._encode_single_piece(text[run.start() : stop].encode()), dtype="<u4")]
        at = stop
    parts.append(vocab.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(parts).astype("<u4")


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities, then falling powers of two."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Bins:
    """One worker's open bins: for each class, the pieces that wait for their bin to fill."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next = capacity, worker << 36
        self.waiting: dict[int, list[tuple]] = {}

    def put(self, piece: tuple) -> list[tuple]:
        """The rows of the bin that this piece fills, if it fills one."""
        length = piece[2]
        open_bin = self.waiting.setdefault(length, [])
        open_bin.append(piece)
        if len(open_bin) < self.capacity // length:
            return []
        del self.waiting[length]
        return self.close(open_bin)

    def close(self, pieces: list[tuple]) -> list[tuple]:
        length = pieces[0][2]
        total = length * len(pieces)
        rows = [(*piece, self.next, i * length, total) for i, piece in enumerate(pieces)]
        self.next += 1
        return rows

    def rest(self) -> Iterator[tuple]:
        """The rows of bins that never filled, dealt out by powers of two."""
        for length in sorted(self.waiting, reverse=True):
            pieces, at = self.waiting[length], 0
            for count in cuts(len(pieces), 1 << 62):
                yield from self.close(pieces[at : at + count])
                at += count
        self.waiting.clear()


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: Column | None = None, capacity: int = 1024, end: int = 0) -> DataFrame:
    """One row for each piece: ``key``, where the piece lies in its document and in its
    sequence, and the checksum of its ids. ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    field = f"`{key}` {docs.schema[key].dataType.simpleString()}"
    names = [key, *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = byte_vocabulary(path)
        bins = Bins(capacity, TaskContext.get().partitionId())
        kind = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(vocab, value.as_py()), np.uint32(end)).astype("<u4")
                raw, n, start, name = ids.tobytes(), len(ids), 0, name.as_py()
                for length in cuts(n, capacity):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    out += bins.put((name, start, length, crc, n))
                    start += length
                if len(out) > 50_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)
        if last := list(bins.rest()):
            yield table(last)

    rows = docs.select(F.col(key), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"{field}, {PIECES}")
