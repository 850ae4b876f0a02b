"""Periodic runs against a plain search, on small alphabets, long texts and odd tables."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from motefield.llm import runs
from motefield.llm.queries import op12_runs, planted_repeats


def plain_runs(words, least=24, times=3):
    """By comparing all words at each distance; the smallest distance of each stretch is its period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, size, q) for (i, size), q in found.items())


def draw_text(draw):
    letters = "abcdefghijklmnopqrst"[: draw.choice([1, 2, 2, 3, 3, 5, 20])]
    words = [draw.choice(letters) for _ in range(draw.randrange(60))]
    if words and draw.random() < 0.5:
        a, p = draw.randrange(len(words)), draw.randrange(1, 8)
        words[a:a] = [words[a:][i % min(p, len(words) - a)] for i in range(draw.randrange(50))]
    return " ".join(words)


def test_equal_to_a_plain_search():
    draw = random.Random(3)
    for _ in range(1200):
        texts = [draw_text(draw) for _ in range(draw.randrange(1, 6))]
        least, times = draw.choice([(2, 2), (4, 2), (6, 3), (24, 3), (3, 3)])
        for text, (words, found) in zip(texts, runs.text_runs(texts, least, times), strict=True):
            assert [w.decode() for w in words] == text.split()
            assert list(map(tuple, found.tolist())) == plain_runs(text.split(), least, times), text


def test_long_texts_of_few_words():
    assert [f.tolist() for _, f in runs.text_runs(["a " * 150_000, "a b " * 60_000])] == [[[0, 150_000, 1]], [[0, 120_000, 2]]]
    (_, found), = runs.text_runs([("x y z " * 500 + "q ") * 9])
    assert found[0].tolist() == [0, 1500, 3] and [0, 9 * 1501, 1501] in found.tolist() and len(found) == 10


def test_squares_cover_every_leftmost_square():
    draw = random.Random(4)
    for _ in range(300):
        words = np.array([draw.randrange(2) for _ in range(draw.randrange(2, 30))])
        n = len(words)
        suffixes = runs.Suffixes(words, np.full(n, n))
        repeated = np.bincount(words, minlength=n)[words] > 1
        start, root = runs.covering_squares(suffixes, runs.blocks(runs.previous_factors(suffixes, repeated)), np.zeros(n, dtype=np.int64))
        reached = set()
        for s, k in zip(start.tolist(), root.tolist(), strict=True):
            while s + 2 * k <= n and (words[s : s + k] == words[s + k : s + 2 * k]).all():
                reached.add((s, k))
                s += 1
        seen = set()
        for s in range(n):
            for k in range(1, (n - s) // 2 + 1):
                square = tuple(words[s : s + 2 * k].tolist())
                if square[:k] == square[k:] and square not in seen:
                    seen.add(square)
                    assert (s, k) in reached


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None), (1, "w " * 30), (None, "w " * 30), (2, ""), (3, "a b " * 20 + "c"), (3, "a b " * 20 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("runs", F.lit(7))
    got = sorted((r.doc_id or 0, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs, r.collapsed) for r in runs.collapse_runs(docs).collect())
    none = (None, None, None, None, "", "")
    same = (3, 1, 0, 40, 2, 20_000, "0,40,2\n", "a b c")
    one = (1, 0, 30, 1, 30_000, "0,30,1\n", "w")
    assert sorted(map(repr, got)) == sorted(map(repr, [(0, *one), (1, 0, *none), (1, *one), (2, 0, *none), same, same]))
    listed = runs.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.start, r.length, r.period, r.root) for r in listed) == [(0, 0, 30, 1, "w"), (1, 0, 30, 1, "w"), (3, 0, 40, 2, "a b"), (3, 0, 40, 2, "a b")]
    for made in (runs.periodic_runs, runs.collapse_runs, runs.run_digests):
        assert made(docs.limit(0)).count() == 0


def test_greatest_run_by_exact_exponent_with_ties():
    found = np.array([[0, 40, 10], [50, 40, 10], [100, 33, 8], [200, 24, 6]])
    assert runs._greatest(found) == (100, 33, 8, 4125)
    assert runs._greatest(found[[0, 1, 3]]) == (0, 40, 10, 4000)


def test_query_equals_a_plain_search_on_a_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in op12_runs(spark, sf_dir).collect()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in planted_repeats(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(rows) == len(found) and any(r.n_runs for r in found.values())
    for row in rows:
        words, h = (row.text or "").encode().split(), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert words == (texts[row.doc_id] or "").encode().split()
        if n > 3000:
            continue  # the plain search takes n^2 steps
        runs_here = plain_runs(words)
        written = "".join(f"{s},{size},{q}\n" for s, size, q in runs_here)
        gone = {i for s, size, q in runs_here for i in range(s + q, s + size)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert (found[row.doc_id].n_runs, found[row.doc_id].runs_sha256) == (len(runs_here), hashlib.sha256(written.encode()).hexdigest())
        assert found[row.doc_id].collapsed_sha256 == hashlib.sha256(kept).hexdigest()
