"""The pipeline's stages held against plain versions of them, on tables with nulls, repeated
rows, ties, empty tables and columns whose names clash with those of the operators."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from motefield.storage import materialize, temporary

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _text string, _doc long, _first long, _starts long, tag long, band long, doc long"


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(n)]


def corpus():
    rng = random.Random(12)
    texts = {}
    shared = "the same long footer line stands below very many of the documents"
    passage = " ".join(words(rng, 70))
    for i in range(60):
        body = words(rng, rng.randrange(20, 160))
        texts[i] = " ".join(body) + (f"\n{shared}" if i % 3 == 0 else "") + (f" {passage}" if i % 20 == 4 else "")
    for i, of in ((60, 5), (61, 5), (62, 7)):
        texts[i] = texts[of]  # exact copies
    long = words(rng, 300)
    texts[63], texts[64], texts[65] = " ".join(long), " ".join([*long[:150], "other", *long[151:]]), " ".join([*long[:290], *words(rng, 8)])
    texts |= {66: "", 67: None, 68: " \n\n", 69: "x" * 30_000, 70: "a b " * 4000}
    for i in range(100, 140):  # toxic, by words that stand after different others
        texts[i] = " ".join(w for a in words(rng, 12) for w in (a, rng.choice(("idiot", "moron"))))
    rows = list(texts.items()) + [(3, texts[3]), (None, texts[8]), (None, None), (None, texts[8])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), False, "t", 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 100)) for i, _ in rows if i is not None] + [(None, 0, 1), (5, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_lines(rows):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(k := key_of(line)) >= 40:
                held.setdefault(k, set()).add(i)
    goes = lambda i, k: i is not None and len(k) >= 40 and len(held[k]) >= 5 and max(held[k]) != i
    return [(i, "\n".join(line for line in (t or "").split("\n") if not goes(i, key_of(line)))) for i, t in rows]


def plain_minhash(rows):
    def shingles(t):
        w = (t or "").encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    told = [(i, t or "", shingles(t)) for i, t in rows if i is not None]
    for a, (i, t, s) in enumerate(told):
        for j, u, r in told[a + 1 :]:
            if t == u or s and r and len(s & r) >= 0.8 * len(s | r):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [(i, t) for i, t in rows if i is None or find(i) == i]


def plain_substrings(rows, size=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - size + 1) if i is not None else ():
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {q for p in range(len(w) - size + 1) if i is not None and first[tuple(w[p : p + size])] < i for q in range(p, p + size)}
        out.append((i, [x.decode() for k, x in enumerate(w) if k not in gone], not gone, t))
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_every_stage(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "minhash", "substrings", "packing"]
    kept = materialize(by_name["toxicity"](spark, docs, folder), "t1")
    # toxic documents go, also those whose labels were held out; nothing else does
    assert pairs(kept) == sorted(((i, t) for i, t in rows if i is None or i < 100), key=str)
    assert any(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(100, 140)) and kept.columns == docs.columns
    now = [(r.doc_id, r.text) for r in kept.collect()]

    lined = materialize(by_name["lines"](spark, kept, folder), "t2")
    assert pairs(lined) == sorted(plain_lines(now), key=str) and lined.columns == docs.columns
    assert lined.where("n_chars <> length(text)").count() == 0 and lined.where("_doc <> 1 or tag <> 4").count() == 0
    now = [(r.doc_id, r.text) for r in lined.collect()]

    one = materialize(by_name["minhash"](spark, lined, folder), "t3")
    assert pairs(one) == sorted(plain_minhash(now), key=str) and one.columns == docs.columns
    now = [(r.doc_id, r.text) for r in one.collect()]
    assert {60, 61, 62, 64, 65} & {i for i, _ in now} == set()

    cut = materialize(by_name["substrings"](spark, one, folder), "t4")
    want = {(i, t): (w, same) for i, w, same, t in plain_substrings(now)}
    got = {}
    for r in cut.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert cut.count() == len(now) and cut.columns == docs.columns
    for (i, t), (w, same) in want.items():
        assert any((x == t) if same else (x.split() == w) for x in got[i]), i
    assert any(not same for _, same in want.values())

    packed = by_name["packing"](spark, cut, folder).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 0] for r in cut.collect() if r.doc_id is not None}
    seen = {}
    for r in packed:
        if r.doc_id is not None and r.doc_id != 3:
            seen.setdefault(r.doc_id, []).append(r)
    for i, pieces in seen.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[i])


def test_whole_run_equals_its_stages(spark, tables):
    folder, _ = tables
    with temporary(spark):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, folder), "step")
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        want = sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, docs, folder).select(columns).collect()))
        assert sorted(map(str, corpus_pipeline.run(spark, folder).select(columns).collect())) == want


def test_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from motefield.llm import toxicity

    assert toxicity.clean_documents(docs, None).count() == len(rows)
    assert toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where(F.col("toxic") == 0)) is None
