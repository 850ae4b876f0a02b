"""MinHash near-dedup held against all pairs, and its signatures against the similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest

from motefield.llm import minhash
from motefield.llm.words import chunks


def parts(texts, threshold, weights):
    from collections import Counter

    bags = []
    for t in texts:
        w = (t or "").encode().split()
        some = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        bags.append(Counter(some) if weights == "count" else Counter(set(some)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            whole = sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (whole and shared / whole >= threshold):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for size in (1, 1, 3, 25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 300))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    out += ["", None, " ", "a", "a b", "a  b", "a b c d", "a b c d e", "x " * 300, "x " * 301, "é ü " * 40, out[3], out[4] + " tail"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "weights"), [(0, "set"), (1, "set"), (2, "count")])
def test_against_all_pairs(spark, seed, weights, monkeypatch):
    if seed:
        monkeypatch.setattr(minhash, "BLOCK", 4)
        monkeypatch.setattr(minhash, "EXACT_BLOCK", 3)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, doc int, n int").repartition(3)
    got = {r.doc_id: r for r in minhash.near_duplicate_classes(df, weights=weights).collect()}
    assert [got[i].class_id for i in range(len(texts))] == parts(texts, 0.8, weights)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    value = minhash.mix(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    text = np.repeat([0, 1], 300)
    both = np.concatenate((value[:300], value[100:]))
    weight = rng.integers(1, 9, 400).astype(float)
    weights = np.concatenate((weight[:300], weight[100:] * 1.5))
    sig = minhash.signatures(text, both, weights, 3, 2000)
    a, b = np.zeros(400), np.zeros(400)
    a[:300], b[100:] = weight[:300], weight[100:] * 1.5
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig[:2] != 0).all() and (sig[2] == 0).all()


def test_signature_does_not_depend_on_neighbours():
    texts = ["a b c d e f g " * 9, "p q r s t u v w x y z", "x"]
    alone = []
    for t in texts:
        (words,) = chunks(pa.array([t]))
        alone.append(minhash.signatures(*[x.astype(float) if i == 2 else x for i, x in enumerate(minhash.shingles(words))], 1)[0])
    (words,) = chunks(pa.array(texts))
    text, value, times = minhash.shingles(words)
    assert (minhash.signatures(text, value, times.astype(float), 3) == np.stack(alone)).all()


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicate_classes(spark.createDataFrame([], schema)).count() == 0
    rows = minhash.near_duplicate_classes(spark.createDataFrame([(2, "a b"), (2, "a b"), (1, "a b")], schema)).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(1, 1), (2, 1), (2, 1)]


def test_null_ids_are_kept_as_classes_of_their_own(spark):
    from corpus_pipeline import keep_one_of_each_class

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long), (None, None), (None, "a b"), (3, long), (4, long + " tail"), (5, "a b"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash.near_duplicate_classes(df).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, classes)) == [(-1, -1, True)] * 4 + [(3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True)]
    stayed = keep_one_of_each_class(spark, df, "").collect()
    assert sorted(map(str, stayed)) == sorted(str(r) for r in df.collect() if r.doc_id != 4)
