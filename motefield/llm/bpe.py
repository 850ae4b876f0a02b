"""BPE encoding and decoding with a priority queue over a doubly linked symbol list.

A pre-token starts as one symbol per byte. Every adjacent pair that the vocabulary can
merge enters a heap under its merge rank; popping the least rank merges the pair in the
linked list and pushes the two new neighbour pairs. An entry whose symbols have changed
since it was pushed is stale and is skipped. Decoding concatenates vocabulary strings.

Texts are cut into pre-tokens by the vocabulary file's own normalizer and pre-tokenizer, whose
Unicode tables decide what is a letter or a number and how it is lower-cased; texts of Latin
letters and ASCII alone, on which the standard engine agrees with them, take that shorter way.

Pre-tokens repeat, so each Python worker keeps a bounded table of those it has encoded;
the table only saves time, its loss never changes a result.

Null text counts as empty; an empty text has no ids, an empty decoded text and the digest
of no bytes. Texts are processed whole. Repeated rows give repeated results and columns of
the input other than the two named are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pre-tokens that one worker remembers before it starts its table anew.
MEMORY = 300_000

#: The pre-token pattern of the vocabulary file for texts of the letters below,
#: where the standard engine's faster classes agree with it.
PLAIN_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
NOT_PLAIN = r"[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-ɏ]"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else spare))
        spare += b not in shown
    return letters


class WordBpe:
    """A word-level BPE vocabulary file: lower-cased words that end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.strings = {i: t for t, i in spec["model"]["vocab"].items()}
        ids = spec["model"]["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        suffix = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.special.items()}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.plain = re.compile(PLAIN_PRE_TOKENS)
        self.odd = re.compile(NOT_PLAIN)
        #: By pre-token: as text, and as the letters that stand for its bytes.
        self.memory: dict[str, tuple[bytes, str]] = {}
        self.spelled: dict[str, tuple[bytes, str]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols: list[int] = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for at in range(n - 1):
            if found := merges.get((symbols[at], symbols[at + 1])):
                queue.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, made = heapq.heappop(queue)
            follow = after[at]
            if symbols[at] != left or follow >= n or symbols[follow] != right:
                continue  # stale: one of the two has been merged since
            symbols[at], symbols[follow] = made, -1
            after[at] = beyond = after[follow]
            if beyond < n:
                before[beyond] = at
                if found := merges.get((made, symbols[beyond])):
                    heapq.heappush(queue, (found[0], at, made, symbols[beyond], found[1]))
            if (ahead := before[at]) >= 0 and (found := merges.get((symbols[ahead], made))):
                heapq.heappush(queue, (found[0], ahead, symbols[ahead], made, found[1]))
        out, at = [], 0
        while at < n:
            out.append(symbols[at])
            at = after[at]
        return out

    def plain_words(self, text: str) -> list[str] | None:
        """Pre-tokens of a text without special tokens, where it has plain letters alone."""
        if self.odd.search(text) is not None:
            return None
        low = text.lower()
        if not low.isascii():
            low = unicodedata.normalize("NFC", text).lower()
            if self.odd.search(low) is not None:
                return None
        return self.plain.findall(low)

    def known(self, memory: dict[str, tuple[bytes, str]], word: str, raw: bytes) -> tuple[bytes, str]:
        ids = self.merge(raw)
        found = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.strings.__getitem__, ids))
        if len(memory) >= MEMORY:
            memory.clear()
        if len(word) <= 64:
            memory[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their decoded text."""
        ids: list[bytes] = []
        words: list[str] = []
        parts = self.marks.split(text) if self.marks else [text]
        for part in parts:
            if (special := self.special.get(part)) is not None:
                ids.append(struct.pack("<I", special))
                words.append(part)
                continue
            if (plain := self.plain_words(part)) is not None:
                memory = self.memory
                for word in plain:
                    a, b = memory.get(word) or self.known(memory, word, word.encode())
                    ids.append(a)
                    words.append(b)
                continue
            memory = self.spelled
            for word, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                a, b = memory.get(word) or self.known(memory, word, bytes(map(self.byte.__getitem__, word)))
                ids.append(a)
                words.append(b)
        return b"".join(ids), " ".join(words)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, one space between two, special tokens included."""
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (string) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids, decoded = [], []
            for value in batch.column(1):
                raw, said = vocab.encode(value.as_py() or "")
                ids.append(list(struct.unpack(f"<{len(raw) // 4}I", raw)))
                decoded.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    rows = docs.select(F.col(key), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"{_field(docs, key)}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row of ``docs``.

    The same encoding as ``encode_documents`` without carrying ids and texts back to the
    JVM: the digests are taken where the ids are made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n, a, b = [], [], []
            for value in batch.column(1):
                raw, said = vocab.encode(value.as_py() or "")
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(said.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"{_field(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"
