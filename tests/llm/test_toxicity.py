"""The random field held against enumeration, and its scores against held-out labels."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from motefield.llm import queries, toxicity


def tokens_of(texts):
    ((_, t),) = toxicity.token_chunks(pa.array(texts, pa.string()))
    return t


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(toxicity.Lookup(np.zeros(0, dtype=np.uint64)), np.zeros(0), rng.standard_normal((2, 2)), rng.standard_normal(2))
    lengths = np.array([3, 1, 5])
    first = np.array([0, 3, 4])
    e = rng.standard_normal(9)
    p, moves, z = field.marginals(e, first, lengths, moves=True)
    want, total, log_z = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, n in zip(first, lengths):
        ways = []
        for y in itertools.product((0, 1), repeat=int(n)):
            s = field.begin[y[0]] + sum(e[a + i] for i in range(n) if y[i]) + sum(field.moves[y[i - 1], y[i]] for i in range(1, n))
            ways.append((np.exp(s), y))
        whole = sum(w for w, _ in ways)
        log_z += np.log(whole)
        for w, y in ways:
            for i in range(n):
                want[a + i] += y[i] * w / whole
                if i:
                    total[y[i - 1], y[i]] += w / whole
    assert np.allclose(p, want) and np.allclose(moves, total) and np.isclose(z, log_z)


def test_tokens_sentences_and_letters():
    t = tokens_of(["ÉTÉ, été. X1y", "", "a\nb"])
    assert (t.features[0] == t.features[1]).all()
    assert t.doc.tolist() == [0, 0, 0, 0, 2, 2] and t.length.tolist() == [2, 2, 1, 1]
    assert tokens_of(["w " * 600]).length.tolist() == [600]
    ((_, pieces),) = toxicity.token_chunks(pa.array(["w " * 600]), 256)
    assert pieces.length.tolist() == [256, 256, 88]


def test_long_chains_are_one_chain(monkeypatch):
    """Blocks of any size give the marginals, transitions and log Z of whole chains."""
    rng = np.random.default_rng(1)
    field = toxicity.Field(toxicity.Lookup(np.zeros(0, dtype=np.uint64)), np.zeros(0), rng.standard_normal((2, 2)), rng.standard_normal(2))
    lengths = np.array([1, 700, 4, 5, 3, 64, 8, 9])
    first = np.cumsum(lengths) - lengths
    e = 3 * rng.standard_normal(lengths.sum())
    got = {}
    for block in (1, 2, 4, 7, 256, 10_000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got[block] = field.marginals(e, first, lengths, moves=True)
    for p, moves, z in got.values():
        assert np.allclose(p, got[10_000][0], atol=1e-9) and np.allclose(moves, got[10_000][1]) and np.isclose(z, got[10_000][2])


def test_a_mark_reaches_over_blocks():
    """What one token says goes on along a chain of sticky states, beyond the end of a block."""
    field = toxicity.Field(toxicity.Lookup(np.zeros(0, dtype=np.uint64)), np.zeros(0), np.array([[0.0, -9.0], [-9.0, 0.0]]), np.zeros(2))
    e = np.zeros(600)
    e[250] = 6.0
    p = field.marginals(e, np.array([0]), np.array([600]))
    assert p[257] > 0.9 and abs(p[255] - p[256]) < 0.01
    assert len(field.marginals(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))) == 0


def test_the_bar_follows_labels_and_features(spark):
    """Of 2,000 words that are alike in both kinds few pass, and the words of toxic documents
    all do; with 9 toxic documents as with 300."""
    for toxic, clean, told in ((9, 55, 9), (300, 2000, 60)):
        rng = np.random.default_rng(toxic)
        plain = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.binomial(toxic, 0.3, 2000), rng.binomial(clean, 0.3, 2000)))]
        counts = spark.createDataFrame(plain + [(9000 + i, told, 0) for i in range(10)], "feature long, toxic long, clean long")
        found = set(toxicity.telling(counts, toxic, clean).keys.view(np.int64).tolist())
        assert found >= {9000 + i for i in range(10)} and len(found) <= 12
    assert len(toxicity.telling(counts.limit(0), 3, 5).keys) == 0


def test_training_tags_the_labelled_words():
    texts = ["good nice fine day bad word here", "fine day nice", "bad idea good day"] * 30
    t = tokens_of(texts)
    bad = tokens_of(["bad"]).features[0][0]
    labels = (t.features[:, 0] == bad).astype(np.int64)
    p = toxicity.train(t, labels).score(t)
    assert p[labels == 1].min() > 0.9 and p[labels == 0].max() < 0.1


def test_held_out_labels(spark):
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    clean = [rows[r.doc_id].predicted for r in labels if not r.toxic and rows[r.doc_id].held_out]
    assert sum(clean) <= 0.05 * len(clean)  # 399 labels of which 300 train
    # 37 toxic documents train; the words of some that are held out stand in too few of them
    bad = [rows[r.doc_id].predicted for r in labels if r.toxic and rows[r.doc_id].held_out]
    assert sum(bad) >= 0.6 * len(bad)


def test_held_out_quality(spark):
    """3,980 labels, of which 990 are held out, 120 of these toxic."""
    scored = queries.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    told = scored.join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").select("toxic", "score", "predicted").toPandas()
    bad, good = told[told.toxic == 1], told[told.toxic == 0]
    assert bad.predicted.mean() >= 0.9 and good.predicted.mean() <= 0.01
    ranks = told.score.rank()[told.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2
    assert ranks / (len(bad) * len(good)) >= 0.95


def test_evidence_weighs_length():
    hits, n = np.array([0.0, 1.0, 1.0, 5.0, 5.0] * 20), np.array([100.0, 20.0, 2000.0, 300.0, 9000.0] * 20)
    w = toxicity.logistic(toxicity.evidence(hits, n), np.array([0.0, 1.0, 0.0, 1.0, 0.0] * 20))
    p = 1 / (1 + np.exp(-toxicity.evidence(hits, n) @ w))
    assert p[1] > 0.7 and p[3] > 0.7 and max(p[0], p[2], p[4]) < 0.3


def test_edges(spark):
    letters = "abcdefghijklmnopqrst"
    name = lambda i: letters[i % 20] + letters[i // 20] + "x"
    # the word stands after different words; copies of one text would not tell
    docs = [(i, f"{name(i)} idiot {name(2 * i)}", 0.5) for i in range(60)] + [(100 + i, "kind words all day", 0.5) for i in range(60)] + [(900, None, 0.5), (901, "", 0.5), (900, "IDIOT " * 3000, 0.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(None, 1), (901, None), (5555, 1)], "doc_id long, toxic int")
    field = toxicity.fit(df, labels)
    got = toxicity.score_documents(df, field).collect()
    assert len(got) == len(docs)
    assert all((r.score > 0.5) == (r.doc_id < 60 or r.n_tokens == 3000) for r in got)
    assert [(s.start, s.end) for s in got[0].spans] if got[0].doc_id < 60 else True
    assert toxicity.fit(df, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_documents(df, None).collect()} == {0.0}
    assert toxicity.score_documents(df.limit(0), field).count() == 0
