"""BPE, packing and Matroska held against libraries, brute force and exact round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from motefield.llm import bpe, matroska, packing

ODD = ["", " ", "\n\n", "A", "It's WE'LL 12 ²³ Ⅷ x", "ΑΣ Σ ς İI ǅ", "é ﬁ 日本語 🙂👍🏽", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "a\x1fb\x85c\xa0d e​f\x00g", "_a_b__c '' 's's", "x" * 5000, "ab" * 3000 + " %%% ***"]
ALPHABET = "abcé 'sßÄ12\n\t.,_%́ \x1c日ΣÇ<|>"


def corpus():
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(400)]
    return ODD + made + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate([*texts, None, texts[5]])], "doc_id long, text string, ids int, decoded string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    assert len(got) == len(texts) + 2
    lib = Tokenizer.from_file(path)
    for i, text in enumerate([*texts, "", texts[5]]):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), repr(text)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), repr(text)
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), repr(text)


def test_bpe_of_all_code_points():
    """Letters, numbers and cases are the library's own, whatever Unicode version this Python has."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b1" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    for text, found in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text)[0] == struct.pack(f"<{len(found.ids)}I", *found.ids), f"from {text[1]!r}"


@pytest.mark.parametrize("unit", [" ", "\n", " \n\u3000", "a", "!", "é", "1"])
def test_very_long_texts(unit):
    """Three million characters of one kind, which pattern matchers of two libraries give up on."""
    text = "say" + (unit * 3_000_000)[:3_000_000]
    byte_path = public_tokenizers.path("byte_bpe_50k.json")
    byte, byte_lib = packing.byte_vocabulary(byte_path), Tokenizer.from_file(byte_path)
    for tail in ("", "end", "<|endoftext|>", "\x1f."):
        if unit.isspace() or not tail:
            some = text[:20_000] if tail else text
            assert packing.encode(byte, some + tail, wide=0).tolist() == byte_lib.encode(some + tail, add_special_tokens=False).ids
    word_path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(word_path).encode(text[:300_000], add_special_tokens=False).ids
    assert bpe.vocabulary(word_path).encode(text[:300_000])[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_documents_and_decode(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    row = bpe.encode_documents(spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string"), path).first()
    assert bpe.vocabulary(path).decode(row.ids) == row.decoded
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


@pytest.mark.parametrize("capacity", [1024, 8])
def test_packing_holds_each_id_once_without_padding(spark, capacity):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = corpus() if capacity == 1024 else ODD
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None])], "doc_id long, text string, start int").repartition(3)
    rows = packing.pack_documents(docs, path, capacity=capacity).collect()
    lib = Tokenizer.from_file(path)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate([*texts, ""]):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
        assert len({r.length for r in pieces}) == 1
    assert packing.pack_documents(spark.createDataFrame([], docs.schema), path).count() == 0


def test_packing_needs_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), "", capacity=1000)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 7, 576 * 8 + 1, 576 * 700])
def test_matroska_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = matroska.padded(raw)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[:n] == raw and set(payload[n:]) <= {255}
    stored = matroska.mux(payload)
    found = matroska.packets(stored)
    assert not found.error and matroska.payload_of(stored, found) == payload
    assert matroska.cues_point_to_clusters(found)
    assert [p[1] for p in found.packets] == [12 * i for i in range(len(payload) // 576)]


def test_matroska_lacings_of_unequal_frames():
    frames = [b"a" * n for n in (300, 1, 70_000, 255, 254, 9)]
    for how in (1, 3):
        held = matroska.element(matroska.SIMPLE, matroska.block(frames, 5, -3, how, False))
        raw = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.number(matroska.TIME, 10) + held))
        found = matroska.packets(raw)
        assert [raw[p[2] : p[2] + p[3]] for p in found.packets] == frames
        assert found.packets[0][:2] == (5, 7) and not found.packets[0][4]


def test_matroska_unknown_sizes_and_faults(spark):
    stored = matroska.mux(matroska.padded(b"x" * 9000))
    for end in (0, 1, 5, 60, 500, 4000, len(stored) - 3):
        found = matroska.packets(stored[:end])
        assert found.error
    open_end = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.element(matroska.CLUSTER, matroska.number(matroska.TIME, 0) + matroska.element(matroska.SIMPLE, matroska.block([b"z"], 1, 0, 0, True)))
    assert len(matroska.packets(open_end).packets) == 1
    media = matroska.to_media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"))
    assert matroska.packet_table(media, "doc_id", "media").where("error is null").count() == 2
    broken = spark.createDataFrame([(1, b"\x00"), (2, None)], "doc_id long, media binary")
    assert matroska.packet_table(broken, "doc_id", "media").where("error is not null").count() == 2


def _unknown(name, body):
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7 + body


def test_matroska_live_recording():
    """Thousands of clusters of unknown size, and masters nested as deep, as a stream writes them."""
    clusters = [_unknown(matroska.CLUSTER, matroska.number(matroska.TIME, 5 * i) + matroska.element(matroska.SIMPLE, matroska.block([b"ab"], 1, 0, 0, i % 2 == 0))) for i in range(3000)]
    found = matroska.packets(_unknown(matroska.SEGMENT, b"".join(clusters) + matroska.element(matroska.CUES, b"")))
    assert not found.error and len(found.clusters) == 3000 and [p[1] for p in found.packets] == [5 * i for i in range(3000)]
    assert [p[6] for p in found.packets] == list(range(3000)) and [p[4] for p in found.packets[:3]] == [True, False, True]
    deep = b""
    for _ in range(3000):
        deep = matroska.element(matroska.GROUP, deep)
    assert not matroska.packets(deep).error


def test_matroska_durations_and_references():
    track = lambda n, more=b"": matroska.element(matroska.TRACK, matroska.number(matroska.NUMBER, n) + more)
    tracks = matroska.element(matroska.TRACKS, track(1, matroska.number(matroska.DEFAULT_DURATION, 2_500_000)) + track(2))
    frames = [b"a", b"b", b"c"]
    group = lambda t, more: matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, matroska.block(frames, t, 4, 2, False)) + more)
    body = matroska.number(matroska.TIME, 100) + group(1, b"") + group(2, matroska.number(matroska.BLOCK_DURATION, 30) + matroska.number(matroska.REFERENCE, 1)) + group(2, b"")
    info = matroska.element(matroska.INFO, matroska.number(matroska.SCALE, 500_000))
    found = matroska.packets(matroska.element(matroska.SEGMENT, info + tracks + matroska.element(matroska.CLUSTER, body)))
    assert found.tracks == [(1, ""), (2, "")] and found.scale == 500_000
    assert [(p[0], p[1], p[4]) for p in found.packets] == [(1, 104, True), (1, 109, True), (1, 114, True), (2, 104, False), (2, 114, False), (2, 124, False), (2, 104, True), (2, 104, True), (2, 104, True)]
    assert [p[7] for p in found.packets[:3]] == [52_000_000, 54_500_000, 57_000_000]


def test_matroska_faults_never_raise():
    rng = random.Random(3)
    stored = bytearray(matroska.mux(matroska.padded(b"y" * 20_000)))
    for _ in range(300):
        raw = bytearray(stored)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        matroska.packets(bytes(raw))


def test_matroska_digests(spark):
    docs = spark.createDataFrame([(1, "é" * 300, 0), (2, None, 0), (3, "é" * 300, 1)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in matroska.media_digests(docs).collect()}
    payload = "é".encode() * 300 + b"\xff" * 552
    assert got[1].n_bytes == 600 and got[1].payload_bytes == 1152
    assert got[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[1].tail_crc32 == zlib.crc32(payload[-32:])
    assert got[2].n_bytes == 0 and got[2].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert got[1][2:] == got[3][2:]
