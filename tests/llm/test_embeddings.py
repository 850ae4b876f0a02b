"""Embedding near-dedup held against all pairs."""

import numpy as np
import pyarrow.parquet as pq

from motefield.llm import embeddings


def brute(ids, vectors, threshold=0.95):
    """(links, component) of each id; None for vectors that link with nothing."""
    units = []
    for v in vectors:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None)
    n = len(ids)
    links = [{j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold} for i in range(n)]
    part, seen = {}, set()
    for i in sorted(range(n), key=lambda i: ids[i]):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                part[k] = ids[i]
                todo += links[k]
    return {ids[i]: (len(links[i]), part[i]) for i in range(n)}


def check(spark, ids, vectors):
    vectors = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, rep int, links int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df.repartition(3)).collect()}
    want = brute(ids, [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors])
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 0, 0, 0], [0.99, 0.1, 0, 0]
    vectors = [a, b, a, None, [], [0.0, 0, 0, 0], [nan, 1, 0, 0], [inf, 1, 0, 0], [None, 1, 0, 0], [1.0, 0], [-1.0, 0, 0, 0], [1e30, 0, 0, 0], [1e-30, 0, 0, 0], [-0.0, 0, 0, 1], [0.0, 0, 0, 1], [3.0], [5.0]]
    check(spark, [7, 3, 9, *range(20, 20 + len(vectors) - 3)], vectors)


def test_random_groups(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for size in (1, 1, 2, 5, 40, 300):
        centre = rng.standard_normal(24)
        centre /= np.linalg.norm(centre)
        vectors += [centre + 0.045 * rng.standard_normal(24) for _ in range(size)]
    vectors += list(rng.standard_normal((200, 24)))
    check(spark, [int(x) for x in rng.permutation(len(vectors))], [list(map(float, v)) for v in vectors])


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").slice(0, 300)
    check(spark, t["vec_id"].to_pylist(), t["embedding"].to_pylist())


def test_planted_groups_over_many_blocks(spark, monkeypatch):
    """Four groups of 1,200 vectors about the threshold: blocks, probes and links counted once."""
    monkeypatch.setattr(embeddings, "BLOCK", 128)
    rng = np.random.default_rng(11)
    parts = []
    for spread in (0.01, 0.025, 0.029, 0.032):
        centre = rng.standard_normal(64)
        parts.append(centre / np.linalg.norm(centre) + spread * rng.standard_normal((1200, 64)))
    x = np.concatenate((*parts, rng.standard_normal((600, 64)))).astype(np.float32)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df.repartition(5)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    true, found = near.sum(1), np.array([got[int(i)].n_links for i in ids])
    assert (found <= true).all() and true.sum() > 1_000_000
    assert found.sum() >= 0.999 * true.sum()  # recall of links
    component = np.array([got[int(i)].component_id for i in ids])
    a, b = np.nonzero(near)
    assert (component[a] == component[b]).mean() >= 0.9999


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(1, 1, 1), (2, 1, 1)]
    rows = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in rows) == [("3", 0, 3, True), ("None", 0, None, True), ("None", 0, None, True)]


def test_plan_widens_with_the_table():
    assert embeddings.plan(1000, 64, 0.95)[1] == 1 and embeddings.plan(10**9, 64, 0.95)[1] == 3
