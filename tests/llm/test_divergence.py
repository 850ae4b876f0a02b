"""Term counts and divergences of sources against plain counting, in exact whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) of (lang, source, text)."""
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lowered(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        v = len(kept)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n[s] + v) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (sum(n.values()) + v) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top]
    return sorted(out)


def audit(spark, rows, **options):
    frame = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("range", F.lit("x"))
    return sorted(tuple(r) for r in divergence.divergence_audit(frame, **options).collect())


def drawn(seed, n, letters="abcéß中 ABZ 09_-"):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
    return [(draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None, "é"]), draw.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("least,top", [(3, 200), (1, 4)])
def test_equal_to_plain_counting(spark, least, top):
    rows = drawn(least, 250)
    assert audit(spark, rows, least=least, top=top) == plain(rows, least, top)


def test_small_tries_batches_and_tables_change_nothing(spark, monkeypatch):
    rows = drawn(8, 200)
    expected = audit(spark, rows)
    monkeypatch.setattr(divergence, "CHUNK", 200)
    monkeypatch.setattr(divergence, "LEAVES", 40)
    monkeypatch.setattr(divergence, "CELLS", 16)
    monkeypatch.setattr(divergence, "SQUARE", 2)
    monkeypatch.setattr(divergence, "PARTS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert audit(spark, rows) == expected == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_terms_ties_groups_without_terms_and_empty_tables(spark):
    long = "中" * 40_000
    rows = [("en", "a", long + "x")] * 3 + [("en", "b", long)] * 3 + [("en", "c", None), ("de", "a", "once"), ("de", "b", ""), ("fr", "only", "so so")]
    rows += [("en", s, "tie eit ite") for s in "abc"]
    found = audit(spark, rows)
    assert found == plain(rows)
    assert ("de", "a", "pair", "b", 0, 1) in found and not [r for r in found if r[0] == "fr"]
    assert audit(spark, []) == []


def test_a_trie_orders_its_leaves_by_bytes():
    words = ["b", "a", "ab", "abcdefgh", "abcdefghi", "abcdefgh", "é", "zz", "a" * 40, "a" * 41, "a" * 40]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    order, leaf = divergence.leaves(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(w) for w in raw], ends, np.zeros(len(raw), dtype=np.int64))
    assert [raw[i] for i in order] == sorted(raw)
    assert [raw[order[i]] for i in leaf] == sorted(raw)


def test_probabilities_are_exact_beyond_64_bits():
    count, whole = np.array([8 * 10**15, 1, 7]), np.array([8 * 10**15 + 5, 3, 7])
    assert divergence.parts(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]
