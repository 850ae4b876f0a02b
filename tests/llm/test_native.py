"""Line dedup, URL filters and tool calls on hand-made edges and against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from motefield.llm import lines, toolcalls, urls

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(docs, min_chars, min_docs):
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = lower(line.strip(SPACE))
            if len(k) >= min_chars:
                held.setdefault(k, set()).add(i)
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        keep = [not (len(k := lower(x.strip(SPACE))) >= min_chars and len(held[k]) >= min_docs and max(held[k]) != i) for x in all_lines]
        out.append((i, len(keep), keep.count(False), "\n".join(x for x, y in zip(all_lines, keep) if y), tuple(keep)))
    return sorted(out)


def bitmap(runs):
    return tuple(x for i, n in enumerate(runs) for x in [i % 2 == 0] * n)


@pytest.mark.parametrize("seed", range(4))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["Aa bb", "aA BB ", "\taa bb\r", "x" * 9, "É" * 6, "é" * 6, "ab", "", "  ", "$1 \\d .*", "日本語テキスト"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(100, None), (101, ""), (102, "\n\n"), (103, "aa bb\n" * 500)]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, doc int, pos int").repartition(3)
    got = lines.dedup_lines(df, min_chars=5, min_docs=3).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept, bitmap(r.keep_runs)) for r in got) == brute_lines(docs, 5, 3)


def test_lines_of_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "long enough"), (1, "long enough"), (2, "long enough")], "doc_id long, text string")
    assert [r.n_dropped for r in lines.dedup_lines(df, 5, 3).collect()] == [0, 0, 0]  # two documents only
    assert sorted((r.doc_id, r.n_dropped) for r in lines.dedup_lines(df, 5, 2).collect()) == [(1, 1), (1, 1), (2, 0)]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_null_ids_and_of_other_texts_under_one_id(spark):
    df = spark.createDataFrame([(None, "long enough\nx")] * 6 + [(1, "long enough\nx"), (1, "x\nlong enough"), (1, None), (2, "long enough")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.kept, tuple(r.keep_runs)) for r in lines.dedup_lines(df, 5, 2).collect())
    assert got == sorted([("None", "long enough\nx", (2,))] * 6 + [("1", "x", (0, 1, 1)), ("1", "x", (1, 1)), ("1", "", (1,)), ("2", "long enough", (1,))])


def test_lines_of_a_long_document(spark):
    text = lambda i: "\n".join(f"a line that all have {j}" if j % 2 else f"{i} {j}" for j in range(50_000))
    df = spark.createDataFrame([(i, text(i)) for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(df, 15, 3).collect()}
    assert [got[i].n_dropped for i in range(3)] == [25_000, 25_000, 0]
    assert got[0].kept == "\n".join(f"0 {j}" for j in range(0, 50_000, 2)) and got[0].keep_runs == [1] * 50_000 and got[2].kept == text(2)


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("twice.net", "/", "allow"), ("twice.net", "/", "block"), (None, "/", "block")]
    cases = {
        "http://a.EXAMPLE.org/en/17?x": ("a.example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://org/#f": ("org", "/", "org/", "allow"),
        "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "http://x.com/de/\nq": ("x.com", "/de/\nq", "com/de/", "block"),
        "a://b://c.org/": ("b:", "//c.org/", None, "allow"),
        "http://www.twice.net/": ("www.twice.net", "/", "twice.net/", "block"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://" + "a." * 3000 + "org/" + "p" * 5000: ("a." * 3000 + "org", "/" + "p" * 5000, "org/", "allow"),
    }
    keys = list(cases)
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate([*keys, keys[0]])], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: cases[u] for i, u in enumerate([*keys, keys[0]])}
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.filter_urls(pages, empty).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), empty).count() == 0


CALLS = "conv_id long, turn long, call_id string, parent_id string, name string, arguments string, level int, status int"
RESULTS = "conv_id long, turn long, call_id string, content string, name string"
SCHEMA = "tool string, argument string, type string, required boolean, minimum double, maximum double"


def test_tool_calls(spark):
    rules = spark.createDataFrame([("f", "n", "integer", True, 0.0, 9.0), ("f", "s", "string", False, None, None), ("f", "o", "object", False, None, None)], SCHEMA)
    rows = [
        (1, 1, "a", None, "f", '{"s": "é\\n\\"", "n": 3, "o": {"z": 1, "b": [true, null]}}'),
        (1, 3, "b", "a", "f", '{"n": "3"}'),
        (1, 5, "c", "b", "f", '{"n": 10, "q": 1}'),
        (1, 7, "d", "c", "g", "{}"),
        (1, 8, "e", "gone", "f", "[1]"),
        (1, 9, "f", None, "f", "not json"),
        (1, 9, "h", None, "f", None),
        (2, 1, "x", "y", "f", '{"n": 1}'),
        (2, 2, "y", "x", "f", '{"n": 1}'),
        (2, 3, "z", "y", "f", "{}"),
        (3, 9, "a", "x", "g", "{}"),
        (4, 1, None, "a", "f", '{"n": 1}'),
    ]
    results = [(1, 2, "a", "ok"), (1, 4, "a", "later"), (9, 1, "nobody", None), (9, 2, None, "stray")]
    df = toolcalls.link_tool_calls(spark.createDataFrame([(*r, 1, 1) for r in rows], CALLS).repartition(3), spark.createDataFrame([(*r, "n") for r in results], RESULTS), rules)
    assert [(r.conv_id, r.status, r.level, r.name) for r in df.where("call_id = 'a'").orderBy("conv_id").collect()] == [(1, "linked", 0, "f"), (3, "pending", 0, "g")]
    order = [(r.conv_id, r.call_id) for r in toolcalls.in_order(df.where("call_id is not null and conv_id = 1")).collect()]
    assert [c for _, c in order] == ["a", "e", "f", "h", "b", "c", "d"]
    assert {r.call_id: r.repeats for r in df.collect() if r.repeats} == {"a": 1}
    got = {r.call_id: r for r in df.orderBy(F.desc("conv_id")).collect() if r.call_id}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "f": 0, "h": 0, "x": None, "y": None, "z": None, "nobody": None}
    assert {k: r.violations for k, r in got.items()} == {
        "a": [], "b": ["type of n"], "c": ["range of n", "unknown q"], "d": ["unknown tool"], "e": ["not an object"], "f": ["not an object"],
        "h": ["not an object"], "x": [], "y": [], "z": ["missing n"], "nobody": None,
    }
    assert got["a"].record == '{"arguments":{"n":3,"o":{"b":[true,null],"z":1},"s":"é\\n\\""},"id":"a","level":0,"name":"f","result":"ok"}'
    assert all(json.loads(r.record) for r in got.values())
    assert (got["a"].status, got["b"].status, got["nobody"].status) == ("linked", "pending", "orphan")
    assert df.where("status = 'unidentified'").count() == 2


def test_long_chains_and_nothing(spark):
    rules = spark.createDataFrame([], SCHEMA)
    chain = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("parent_id"))
    got = {int(r.call_id): r.level for r in toolcalls.levels(chain).collect()}
    assert got == {i: i for i in range(300)}
    assert toolcalls.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), rules).count() == 0


def test_a_url_that_half_of_all_pages_share_is_dealt_over_tasks(spark):
    rules = spark.createDataFrame([("example.org", "/a", "block")], "host string, path string, verdict string")
    pages = spark.range(0, 200_000, 1, 20).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.lit("http://example.org/abc")).when(F.col("id") % 4 == 1, F.concat(F.lit("http://h.com/"), F.col("id").cast("string"))).alias("url"))
    set_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "40", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        found = urls.filter_urls(pages, rules)
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 200_000 and sizes[-1] < 50_000  # the shared url alone has 100,000
        assert {tuple(r) for r in found.groupBy("verdict", "rule").count().collect()} == {("block", "example.org/a", 100_000), ("allow", None, 100_000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
