"""Piece encoding and decoding against the standard library, on odd texts and whole tables."""

import hashlib
import random

import sentencepiece
from pyspark.sql import functions as F

from motefield.llm import pieces
from motefield.llm.queries import op13_pieces, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LETTERS = "aab cde  \n\t▁éßж中文🎉\0\r<0x41>the in on.'�\U0010ffff"


def expected(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return ids, LIBRARY.decode(ids)


def test_random_texts_equal_the_library():
    table = pieces.ChunkTable(pieces.PieceModel(PATH))
    draw = random.Random(5)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(30))) for _ in range(4000)]
    texts += ["".join(chr(draw.choice([draw.randrange(0x250), draw.randrange(0xE000, 0x10FFFF), draw.randrange(0x3000, 0xA000), 32])) for _ in range(draw.randrange(20))) for _ in range(4000)]
    for text in texts:
        ids, said = expected(text)
        rows = table.rows(text)
        assert [i for r in rows for i in table.ids[r]] + [table.model.end] == ids, text
        assert table.joined(rows) == (len(ids), " ".join(map(str, ids)), said), text
        assert table.model.decode(ids) == said, text


def test_short_and_long_chunks_merge_alike():
    model = pieces.PieceModel(PATH)
    draw = random.Random(6)
    for _ in range(2000):
        chunk = "▁" * draw.randrange(4) + "".join(draw.choice("thereinaonsd.é中") for _ in range(draw.randrange(1, 60)))
        assert model._short(list(chunk)) == model._long(list(chunk))


def test_any_ids_decode_as_the_library_decodes_them():
    model = pieces.PieceModel(PATH)
    draw = random.Random(7)
    for _ in range(3000):
        ids = [draw.randrange(draw.choice([300, 32000])) for _ in range(draw.randrange(9))]
        assert model.decode(ids) == LIBRARY.decode(ids), ids


def test_very_long_texts_and_a_table_that_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 3)
    monkeypatch.setattr(pieces, "_TABLES", {})
    for text in [" " * 50_000, "x" * 50_000, "中" * 30_000, " a b" * 100_000]:
        table = pieces.chunk_table(PATH)
        ids, said = expected(text)
        assert table.joined(table.rows(text)) == (len(ids), " ".join(map(str, ids)), said)
    assert len(pieces.chunk_table(PATH).ids) <= 4


def test_models_whose_pieces_cross_markers_take_whole_texts():
    model = pieces.PieceModel(PATH)
    assert model.chunk.findall("▁a▁▁b\nc") == ["▁a", "▁▁b", "\n", "c"]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, 5), (1, None, 6), (None, "two words", 7), (3, "", 8), (3, " spaced  out ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("decoded", F.lit("x"))
    found = pieces.encode_documents(docs, PATH).collect()
    assert sorted(((r.doc_id or 0), list(r.ids), r.decoded) for r in found) == sorted(((a or 0), *expected(t)) for a, t, _ in rows)
    digests = pieces.encode_digests(docs, PATH)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 5
    assert pieces.encode_digests(docs.limit(0), PATH).count() == 0
    back = pieces.decode_ids(spark.createDataFrame([(1, [264, 2]), (2, None), (3, [])], "doc_id long, ids array<int>"), PATH)
    assert sorted(map(tuple, back.collect())) == [(1, LIBRARY.decode([264, 2])), (2, None), (3, "")]


def test_query_equals_the_library_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op13_pieces(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids, said = expected(row.text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (found[row.doc_id].n_tokens, found[row.doc_id].ids_sha256, found[row.doc_id].decoded_sha256) == (len(ids), digest, hashlib.sha256(said.encode()).hexdigest())
