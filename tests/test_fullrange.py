"""Full-range correlations against direct sums, with gaps, blocks and far-off places."""

import random

import pytest
from pyspark.sql import functions as F

from motefield.operators import dynamics, fullrange


def walks(seed=1):
    draw = random.Random(seed)
    rows = []
    for p in range(6):
        x, y = 1e6 * p, 0.0
        for t in range(draw.randrange(1, 90)):
            x, y = x + draw.gauss(0, 1), y + draw.gauss(0, 1)
            if draw.random() > 0.2:
                rows.append((p, t + 5 * p, x, y))
    return rows


def direct(rows, f, max_lag=None):
    sums, counts = {}, {}
    for p, t, *a in rows:
        for q, s, *b in rows:
            if p == q and s >= t and (max_lag is None or s - t <= max_lag):
                sums[s - t] = sums.get(s - t, 0.0) + f(a, b)
                counts[s - t] = counts.get(s - t, 0) + 1
    return {k: (sums[k] / counts[k], counts[k]) for k in sums}


@pytest.mark.parametrize("block,max_lag", [(1 << 16, None), (7, None), (16, 33), (1, 5)])
def test_equal_to_direct_sums(spark, block, max_lag):
    rows = walks()
    frame = spark.createDataFrame(rows, "particle long, frame long, x double, y double").withColumn("lag", F.lit("x"))
    square = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    found = fullrange.msd_full(frame, ("x", "y"), block=block, max_lag=max_lag).collect()
    want = direct(rows, square, max_lag)
    assert {r.lag: r.n for r in found} == {k: n for k, (_, n) in want.items()}
    assert all(r.msd == pytest.approx(want[r.lag][0], rel=1e-6, abs=1e-5) for r in found)
    dot = lambda a, b: sum(u * v for u, v in zip(a, b, strict=True))
    near = [(p, t, x - 1e6 * p, y) for p, t, x, y in rows]
    found = fullrange.acf_full(spark.createDataFrame(near, frame.drop("lag").schema), ("x", "y"), block=block, max_lag=max_lag).collect()
    want = direct(near, dot, max_lag)
    assert {r.lag: r.n for r in found} == {k: n for k, (_, n) in want.items()}
    assert all(r.acf == pytest.approx(want[r.lag][0], rel=1e-6, abs=1e-6) for r in found)


def test_equal_to_the_lag_join(spark):
    frame = spark.createDataFrame(walks(2), "particle long, frame long, x double, y double")
    joined = {r.lag: (r.msd, r.n) for r in dynamics.msd_window(frame, 130, ("x", "y")).collect()}
    found = {r.lag: (r.msd, r.n) for r in fullrange.msd_full(frame, ("x", "y"), block=50).collect()}
    assert set(joined) == set(found)
    assert all(found[k][1] == joined[k][1] and found[k][0] == pytest.approx(joined[k][0], rel=1e-6) for k in found)


def test_no_group_holds_more_than_two_blocks_and_odd_rows(spark):
    rows = [(t, float(t % 7)) for t in range(-50, 500)] + [(None, 1.0), (600, None), (601, float("nan"))]
    frame = spark.createDataFrame(rows[:-1], "frame long, v double")
    found = {r.lag: (r.acf, r.n) for r in fullrange.acf_full(frame, ("v",), keys=(), block=32).collect()}
    clean = [(0, t, v) for t, v in rows[:550]]
    want = direct(clean, lambda a, b: a[0] * b[0])
    assert {k: n for k, (_, n) in found.items()} == {k: n for k, (_, n) in want.items()}
    assert all(found[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)
    assert fullrange.msd_full(frame.limit(0), ("v",), keys=()).count() == 0
    with pytest.raises(ValueError):
        fullrange.msd_full(frame, ("v",), keys=(), block=0)
