"""Patterns, choices and edits against brute force on small graphs."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from motefield.operators import matching
from motefield.operators.matching import Pattern


def small_graph(spark, seed=1, n=14, bonds=22):
    draw = random.Random(seed)
    labels = {i: draw.choice("AB") for i in range(n)}
    ends = {tuple(sorted(draw.sample(range(n), 2))): draw.randrange(1, 3) for _ in range(bonds)}
    atoms = spark.createDataFrame([(i, c, float(i)) for i, c in labels.items()], "atom long, label string, charge double")
    links = spark.createDataFrame([(b, a, k) if draw.random() < 0.5 else (a, b, k) for (a, b), k in ends.items()], "atomi long, atomj long, kind int")
    return atoms, links, labels, ends


PATTERNS = {
    "edge": Pattern({"a": None, "b": None}, [("a", "b")]),
    "star": Pattern({"c": "label = 'A'", "x": "label = 'B'", "y": "label = 'B'", "z": None}, [("c", "x"), ("c", "y"), ("c", "z", "kind = 1")]),
    "triangle": Pattern({"a": None, "b": None, "c": None}, [("a", "b"), ("b", "c"), ("c", "a")]),
    "square": Pattern({"a": None, "b": "label = 'A'", "c": None, "d": None}, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]),
    "lasso": Pattern({"a": None, "b": None, "c": None, "t": "label = 'B'"}, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "t", "kind = 2")]),
    "node": Pattern({"a": "label = 'B'"}),
}


def brute(pattern, labels, ends, once):
    names = list(pattern.nodes)
    holds = lambda c, label: c is None or label == c[-2]
    found = set()
    for pick in permutations(labels, len(names)):
        at = dict(zip(names, pick, strict=True))
        if all(holds(c, labels[at[n]]) for n, c in pattern.nodes.items()):
            kinds = [(ends.get(tuple(sorted((at[e[0]], at[e[1]])))), e[2] if len(e) > 2 else None) for e in pattern.edges]
            if all(k is not None and (c is None or k == int(c[-1])) for k, c in kinds):
                found.add(pick)
    if once:
        groups = {frozenset(tuple(dict(zip(names, m, strict=True))[s[n]] for n in names) for s in pattern.symmetries()) for m in found}
        return found, groups
    return found


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_matches_equal_brute_force(spark, name):
    pattern = PATTERNS[name]
    atoms, links, labels, ends = small_graph(spark)
    every = [tuple(r) for r in matching.find_matches(atoms, links, pattern, once=False).collect()]
    found, groups = brute(pattern, labels, ends, True)
    assert len(every) == len(set(every)) and set(every) == found
    one = [tuple(r) for r in matching.find_matches(atoms, links, pattern).collect()]
    # one match of each group of symmetric ones, and no group twice
    assert len(one) == len(groups) and all(sum(m in g for m in one) == 1 for g in groups)


def test_nulls_loops_parallel_bonds_and_unlisted_atoms(spark):
    atoms = spark.createDataFrame([(1, "A"), (2, None), (3, "B"), (None, "A"), (1, "A")], "atom long, label string")
    bonds = spark.createDataFrame([(1, 3, 1), (3, 1, 2), (1, 1, 1), (1, 2, 1), (None, 1, 1), (9, 1, 1)], "atomi long, atomj long, kind int")
    pattern = Pattern({"a": "label = 'A'", "b": None}, [("a", "b", "kind = 2")])
    assert [tuple(r) for r in matching.find_matches(atoms, bonds, pattern).collect()] == [(1, 3)]
    both = Pattern({"a": "label = 'A'", "b": "label is null"}, [("a", "b")])
    assert [tuple(r) for r in matching.find_matches(atoms, bonds, both).collect()] == [(1, 2)]
    assert matching.find_matches(atoms.limit(0), bonds, both).count() == 0
    with pytest.raises(ValueError, match="connected"):
        matching.find_matches(atoms, bonds, Pattern({"a": None, "b": None, "c": None}, [("a", "b")]))


def test_choice_is_greedy_for_any_dealing(spark):
    draw = random.Random(2)
    rows = list({tuple(draw.sample(range(40), 3)) for _ in range(120)})
    taken, used = set(), set()
    for row in sorted(rows, key=lambda r: ((r[0] * 31 + r[1] * 17 + r[2]) % 50, r)):
        if not used & set(row):
            taken.add(row)
            used |= set(row)
    for parts in (1, 5):
        frame = spark.createDataFrame(rows + rows[:9], "x long, y long, z long").repartition(parts)
        chosen = matching.disjoint_matches(frame, priority=F.expr("(x * 31 + y * 17 + z) % 50"))
        assert {tuple(r) for r in chosen.collect()} == taken and chosen.count() == len(taken)
    seeds = [{tuple(r) for r in matching.disjoint_matches(spark.createDataFrame(rows, "x long, y long, z long"), seed=s).collect()} for s in (1, 1, 2)]
    assert seeds[0] == seeds[1] != seeds[2]
    assert matching.disjoint_matches(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("limit,conversion", [(1, 1.0), (3, 0.5), (None, 0.3), (2, 0.0)])
def test_limited_pairs_equal_going_through_them(spark, limit, conversion):
    draw = random.Random(3)
    rows = list({(draw.randrange(2), draw.randrange(30), draw.randrange(30)) for _ in range(300)})
    want = set()
    for frame in (0, 1):
        mine = [r for r in rows if r[0] == frame]
        taken, sites, counts = [], set(), {}
        for _, i, j in sorted(mine, key=lambda r: ((r[1] * 7 + r[2] * 13) % 23, r)):
            mols = {i % 4, j % 5}
            if ("i", i) in sites or ("j", j) in sites or (limit is not None and any(counts.get(m, 0) >= limit for m in mols)):
                continue
            sites |= {("i", i), ("j", j)}
            counts |= {m: counts.get(m, 0) + 1 for m in mols}
            taken.append((frame, i, j))
        most = -(-conversion * min(len({r[1] for r in mine}), len({r[2] for r in mine})) // 1)
        want |= set(taken[: int(most)])
    frame = spark.createDataFrame(rows, "frame long, i long, j long").withColumns({"mol_i": F.col("i") % 4, "mol_j": F.col("j") % 5})
    found = matching.limited_pairs(frame, limit, ("frame",), conversion, priority=F.expr("(i * 7 + j * 13) % 23"))
    assert sorted(map(tuple, found.select("frame", "i", "j").collect())) == sorted(want)


def test_rewrite_edits_folds_and_conserves(spark):
    atoms = spark.createDataFrame([(i, "C", 0.5 * i, None) for i in range(8)], "atom long, label string, charge double, note string")
    bonds = spark.createDataFrame([(0, 1, "s"), (1, 2, "s"), (2, 3, "s"), (4, 5, "s"), (5, 6, "s"), (6, 7, "s")], "atomi long, atomj long, kind string")
    matches = spark.createDataFrame([(0, 1, 2), (4, 5, 6)], "x long, y long, z long")
    new, left = matching.rewrite(atoms, bonds, matches, delete=("x",), cut=(("z", "y"),), form=(("y", "z", {"kind": "concat(a.label, b.label)"}),), assign={"z": {"label": "concat(label, '*')"}}, fold={"charge": "y"}, conserve=("charge",))
    assert sorted((r.atom, r.label, r.charge) for r in new.collect()) == [(1, "C", 0.5), (2, "C*", 1.0), (3, "C", 1.5), (5, "C", 4.5), (6, "C*", 3.0), (7, "C", 3.5)]
    assert sorted((r.atomi, r.atomj, r.kind) for r in left.collect()) == [(1, 2, "CC"), (2, 3, "s"), (5, 6, "CC"), (6, 7, "s")]
    with pytest.raises(ValueError, match="sum of charge"):
        matching.rewrite(atoms, bonds, matches.where("x = 4"), delete=("x",), conserve=("charge",))
    with pytest.raises(ValueError, match="two matches"):
        matching.rewrite(atoms, bonds, matches.union(matches))
    with pytest.raises(ValueError, match="goes"):
        matching.rewrite(atoms, bonds, matches, delete=("x",), form=(("x", "y"),))
    same, kept = matching.rewrite(atoms, bonds, matches.limit(0), delete=("x",), form=(("y", "z"),), cut=(("x", "y"),))
    assert same.count() == 8 and kept.count() == 6
    again, more = matching.rewrite(atoms, bonds, matches, form=(("x", "z"), ("x", "y")))
    assert again.count() == 8 and more.count() == 8


def test_choice_by_parts_equals_choice_by_rounds(spark, monkeypatch):
    """Every choice went through rounds of joins over all matches."""
    rows = [(a, a + 1 + a * 7 % 3, a + 5 + a * 11 % 7) for a in range(0, 400, 2)] * 2 + [(1000 + i, 1000 + i, 1001 + i) for i in range(60)]
    matches = spark.createDataFrame(rows, "x long, y int, z long")
    asked, choose = [], matching._choose
    monkeypatch.setattr(matching, "_choose", lambda *a: asked.append(1) or choose(*a))
    told = []
    for most in (matching.MATCH_PART, 40):
        monkeypatch.setattr(matching, "MATCH_PART", most)
        told.append(sorted(map(tuple, matching.disjoint_matches(matches, priority=F.expr("nullif(x * 31 % 17, 3)")).collect())))
        assert len(asked) == (most == 40)
    assert told[0] == told[1] and len(told[0]) > 50
    more = matching.disjoint_matches(matches.withColumn("k", F.lit("a")), ["x", "y", "z"], F.expr("nullif(x * 31 % 17, 3)"))
    assert sorted(tuple(r)[:3] for r in more.collect()) == told[0] and more.columns == ["x", "y", "z", "k"]
