"""Substring dedup held against every window of small corpora."""

import hashlib
import random

import pyarrow as pa
import pytest

from motefield.llm import substrings
from motefield.llm.words import chunks


def brute(docs, size):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone |= {*range(p, p + size)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    space = lambda: rng.choice([" ", "\n", "\t ", "\x0b", "  "])
    vocab = [f"w{i}" for i in range(rng.choice([1, 2, 5, 400]))]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(45, 120))] for _ in range(4)]
    docs = []
    for i in range(30):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        docs.append((i * 3, "".join(x + space() for x in w)))
    docs += [(200, docs[3][1]), (1, docs[7][1]), (300, None), (301, ""), (302, " \n"), (303, "a " * 49), (304, "a " * 50), (305, "é b " * 700), (306, "é b " * 900)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, doc int, name string").repartition(3)
    got = sorted(tuple(r)[:4] for r in substrings.dedup_substrings(df).collect())
    assert got == brute(docs, 50)


def test_kept_text_and_edges(spark):
    twice = "pre\n\tpre " + "x y " * 40 + "post \n"
    docs = [(1, "x y " * 40, 7), (2, twice, 8), (2, twice, 9), (3, "x y " * 40, 1), (4, " un\ttouched ", 2), (5, None, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, first int")
    got = substrings.cut_documents(df).orderBy("doc_id", "first").collect()
    assert [tuple(r) for r in got] == [(1, "x y " * 40, 7), (2, "pre\n\tpre post", 8), (2, "pre\n\tpre post", 9), (3, "", 1), (4, " un\ttouched ", 2), (5, None, 3)]
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_equal_windows_hold_equal_symbols():
    rng = random.Random(1)
    for _ in range(20):
        vocab = [f"{rng.random():.4f}" for _ in range(rng.choice([2, 6, 1000]))]
        core = [rng.choice(vocab) for _ in range(50)]
        found = []
        for _ in range(2):
            before = [rng.choice(vocab) for _ in range(rng.randrange(40))]
            after = [rng.choice(vocab) for _ in range(rng.randrange(40))]
            (words,) = chunks(pa.array([" ".join(before + core + after)]))
            name, _, low, high = substrings.symbols(words)
            k = len(before)
            found.append({(int(n), int(a) - k, int(b) - k) for n, a, b in zip(name, low, high) if a >= k and b <= k + 50})
        assert found[0] == found[1]


@pytest.mark.parametrize("size", [20, 100])
def test_other_sizes_against_brute_force(spark, size):
    rng = random.Random(size)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(25)] + ["a"] * 60 + [word() for _ in range(40)]
    docs = corpus(3) + [(1000 + i, " ".join([*(word() for _ in range(9 + i)), *passage, *(word() for _ in range(5))])) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, size)
    assert sorted(map(tuple, substrings.dedup_substrings(df, size=size).collect())) == want
    words = {r.doc_id: len((r.text or "").split()) for r in substrings.cut_documents(df, size=size).collect()}
    assert words == {i: n - gone for i, n, gone, _ in want}


@pytest.mark.parametrize("size", [20, 50, 150])
def test_other_window_sizes_with_runs_of_one_word(spark, size):
    rng = random.Random(size)
    word = lambda: f"w{rng.randrange(500)}"
    passages = [[word() for _ in range(size // 3)] + ["same"] * (2 * size // 3) + [word() for _ in range(size // 3)] for _ in range(3)]
    docs = []
    for i in range(24):
        w = [word() for _ in range(rng.randrange(0, 2 * size))]
        if i % 2:
            w[len(w) // 2 : len(w) // 2] = passages[i % 3]
        docs.append((i, " ".join(w)))
    docs += [(50, "same " * (4 * size)), (51, "same " * (5 * size))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in substrings.dedup_substrings(df, size=size).collect())
    assert got == brute(docs, size) and sum(r[2] for r in got) > 5 * size


def test_other_texts_under_one_id_and_null_ids(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(3))
    docs = [(1, a), (2, a), (2, b), (3, f"x {b}"), (3, f"{c} y"), (None, a), (None, None), (4, c), (5, "")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, _doc int, _starts int, tag int")
    got = sorted((str(r.doc_id), str(r.text)) for r in substrings.cut_documents(df).collect())
    # of id 2 the copy goes and the other text stays; of 3 the part that 2 has; 4 repeats 3
    assert got == sorted([("1", a), ("2", ""), ("2", b), ("3", "x"), ("3", f"{c} y"), ("None", a), ("None", "None"), ("4", ""), ("5", "")])
    assert substrings.cut_documents(df).columns == df.columns
