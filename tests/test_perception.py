"""Equivalence, rings and regions against brute force on many small graphs at once."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from motefield.operators import perception


def graphs(seed, kinds=24):
    """Small graphs in disjoint ranges of ids: random ones, cages, ladders, spirals of rings, stars, chains, one ring."""
    draw, out = random.Random(seed), []
    for k in range(kinds):
        n = draw.randrange(3, 9)
        out.append((n, {tuple(sorted(draw.sample(range(n), 2))) for _ in range(draw.randrange(n - 1, n + 5))}))
    out.append((8, {(a, b) for a in range(8) for b in range(a) if bin(a ^ b).count("1") == 1}))  # a cube
    out.append((10, {(i, (i + 1) % 5) for i in range(5)} | {(5 + i, 5 + (i + 2) % 5) for i in range(5)} | {(i, i + 5) for i in range(5)}))
    out.append((9, {(i, (i + 1) % 9) for i in range(9)}))
    out.append((30, {(0, i) for i in range(1, 30)} | {(i, i + 1) for i in range(1, 29, 4)}))
    out.append((12, {(i, i + 1) for i in range(11)}))
    return [(n, {(min(e), max(e)) for e in edges}) for n, edges in out]


def bonds_of(spark, all_):
    rows = [(1000 * g + a, 1000 * g + b) for g, (_, edges) in enumerate(all_) for a, b in edges]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + rows[:5] + [(7, 7), (None, 3)], "atomi long, atomj long")


def cycle_sizes(n, edges):
    """Sizes of a smallest cycle basis: all simple cycles by size, kept while independent modulo two."""
    near = {a: [b for e in edges for b in e if a in e and b != a] for a in range(n)}
    found = set()

    def walk(path):
        for b in near[path[-1]]:
            if b == path[0] and len(path) > 2:
                found.add(frozenset(tuple(sorted(p)) for p in zip(path, path[1:] + path[:1], strict=True)))
            elif b > path[0] and b not in path:
                walk([*path, b])

    for a in range(n):
        walk([a])
    basis, sizes = {}, []
    for cycle in sorted(found, key=len):
        rest = set(cycle)
        while rest and max(rest) in basis:
            rest ^= basis[max(rest)]
        if rest:
            basis[max(rest)] = rest
            sizes.append(len(cycle))
    return sorted(sizes)


def test_ring_sizes_equal_a_smallest_basis(spark):
    all_ = graphs(3)
    rings = perception.smallest_rings(bonds_of(spark, all_)).collect()
    assert len({r.ring for r in rings}) == len(rings)
    for g, (n, edges) in enumerate(all_):
        mine = [r for r in rings if r.part // 1000 == g]
        assert sorted(r.size for r in mine) == cycle_sizes(n, edges), g
        for r in mine:
            ends = [(e.a % 1000, e.b % 1000) for e in r.edges]
            assert set(ends) <= edges and len(ends) == len(r.atoms) == r.size
            assert all(sum(a % 1000 in e for e in ends) == 2 for a in r.atoms)
    assert perception.smallest_rings(spark.createDataFrame([(1, 2), (2, 3)], "atomi long, atomj long")).count() == 0
    assert perception.smallest_rings(spark.createDataFrame([], "atomi long, atomj long")).count() == 0


def test_classes_equal_plain_refinement(spark):
    all_ = graphs(4)
    draw = random.Random(5)
    labels = {1000 * g + a: draw.choice(["C", "C", "N", None]) for g, (n, _) in enumerate(all_) for a in range(n)}
    strength = {(1000 * g + a, 1000 * g + b): draw.randrange(1, 3) for g, (_, edges) in enumerate(all_) for a, b in edges}
    colour, count = {a: str(c) for a, c in labels.items()}, 0
    while len(set(colour.values())) != count:
        count = len(set(colour.values()))
        near = {a: [] for a in labels}
        for (a, b), s in strength.items():
            near[a].append((s, colour[b]))
            near[b].append((s, colour[a]))
        ranks = {v: i for i, v in enumerate(sorted({(colour[a], tuple(sorted(near[a]))) for a in labels}))}
        colour = {a: str(ranks[colour[a], tuple(sorted(near[a]))]) for a in labels}
    want = {a: min(b for b in labels if colour[b] == colour[a]) for a in labels}
    atoms = spark.createDataFrame(list(labels.items()), "atom long, label string")
    bonds = spark.createDataFrame([(*e, s) for e, s in strength.items()], "atomi long, atomj long, s int")
    classes, rounds = perception.equivalence_classes(atoms, bonds, F.col("label"), F.col("s"))
    assert dict(map(tuple, classes.collect())) == want and 1 <= rounds <= 30
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "atomi long, atomj long")
    found, rounds = perception.equivalence_classes(spark.range(7).toDF("atom"), chain)
    assert dict(map(tuple, found.collect())) == {i: min(i, 6 - i) for i in range(7)} and rounds == 3
    assert perception.equivalence_classes(atoms.limit(0), bonds)[0].count() == 0


def test_regions_are_alike_as_isomorphism_says(spark):
    all_ = graphs(6, 10)[:14]
    draw = random.Random(7)
    labels = {1000 * g + a: draw.choice("CCN") for g, (n, _) in enumerate(all_) for a in range(n)}
    edges = {(1000 * g + a, 1000 * g + b) for g, (_, e) in enumerate(all_) for a, b in e}
    near = {a: {b for e in edges for b in e if a in e and b != a} for a in labels}
    atoms = spark.createDataFrame(list(labels.items()), "atom long, label string")
    bonds = spark.createDataFrame(list(edges), "atomi long, atomj long")
    same, places = perception.alike_regions(atoms, bonds, atoms.select(F.col("atom").alias("center"), "atom"), 1, F.col("label"))
    region, inside = dict(map(tuple, same.collect())), {}
    for row in places.collect():
        inside.setdefault(row.center, {})[row.place] = row.atom
    assert set(region) == set(labels)

    def alike(a, b):
        x, y = [a, *sorted(near[a])], [b, *sorted(near[b])]
        if sorted(labels[v] for v in x) != sorted(labels[v] for v in y) or len(x) > 8:
            return None if len(x) > 8 and len(x) == len(y) else False
        for pick in permutations(y[1:]):
            m = dict(zip(x, [b, *pick], strict=True))
            if all(labels[v] == labels[m[v]] for v in x) and all((v in near[w]) == (m[v] in near[m[w]]) for v in x for w in x):
                return True
        return False

    for a in labels:
        assert set(inside[a].values()) == {a} | near[a]
        # an equal place is an atom of equal label and bonds
        m = [(inside[a][p], inside[region[a]][p]) for p in inside[a]]
        assert all(labels[u] == labels[v] for u, v in m)
        assert all((u in near[w]) == (v in near[x]) for u, v in m for w, x in m)
    picked = draw.sample(sorted(labels), 40)
    for a in picked:
        for b in picked:
            if (told := alike(a, b)) is not None:
                assert told == (region[a] == region[b])


def test_each_kind_of_region_is_evaluated_once(spark):
    atoms = spark.createDataFrame([(i, "C" if i % 3 else "N") for i in range(300)], "atom long, label string")
    bonds = spark.createDataFrame([(i, i + 1) for i in range(299) if i % 3 != 2], "atomi long, atomj long")
    centers = atoms.where("label = 'N'").select(F.col("atom").alias("center"), "atom")
    same, places = perception.alike_regions(atoms, bonds, centers, 2, F.col("label"))
    seen = []

    def evaluate(picked):
        seen.extend(picked.collect())
        return picked.select("region", "place", F.concat("label", F.col("hops").cast("string")).alias("kind"))

    found = perception.evaluate_once(atoms, same, places, evaluate).collect()
    assert len(seen) == 3 and len(found) == 300
    assert {(r.atom % 3, r.kind) for r in found} == {(0, "N0"), (1, "C1"), (2, "C2")}
    assert places.where("center is null").count() == 0


def test_largest_matchings_equal_trying_all():
    draw = random.Random(8)

    def best(edges):
        if not edges:
            return 0
        (a, b), *rest = edges
        return max(best(rest), 1 + best([e for e in rest if not {a, b} & set(e)]))

    for _ in range(1500):
        n = draw.randrange(1, 11)
        edges = sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(draw.randrange(0, 14))}) if n > 1 else []
        mate = perception.most_pairs([[b for e in edges for b in e if a in e and b != a] for a in range(n)])
        assert all(m < 0 or (mate[m] == a and tuple(sorted((a, m))) in edges) for a, m in enumerate(mate))
        assert sum(m >= 0 for m in mate) == 2 * best(edges)


def test_double_bonds_of_fused_odd_rings_and_atoms_left_over(spark):
    azulene = [(i, i + 1) for i in range(9)] + [(0, 9), (3, 7)]  # rings of five and seven
    rows = [(*e, "ar") for e in azulene] + [(20, 21, "ar"), (21, 22, "ar"), (22, 20, "ar"), (20, 1, "s"), (30, 31, None), (5, 4, "ar"), (None, 3, "ar")]
    bonds = spark.createDataFrame(rows, "atomi long, atomj long, kind string")
    atoms = spark.createDataFrame([(i, i != 31) for i in [*range(10), 20, 21, 22, 30, 31, 40]], "atom long, need boolean")
    ordered, left = perception.kekule_orders(atoms, bonds, F.col("need"), F.col("kind") == "ar")
    found = ordered.collect()
    assert len(found) == len(rows) and all((r.order is None) == (r.kind != "ar") for r in found)
    double = {tuple(sorted((r.atomi, r.atomj))) for r in found if r.order == 2}
    assert sorted(a for e in double if max(e) < 10 for a in e) == list(range(10))
    over = sorted(map(tuple, left.collect()))
    assert len(over) == 3 and over[0][0] == 20 and over[1:] == [(30, 30), (40, 40)]


def test_regions_cut_no_small_ring(spark):
    """Centers on a tail before two fused rings of six, a ring of five on one atom, and a ring of nine."""
    ring = lambda *v: {tuple(sorted(e)) for e in zip(v, (*v[1:], v[0]), strict=True)}
    edges = {(0, 1), (1, 2), (2, 3)} | ring(3, 4, 5, 6, 7, 8) | ring(6, 7, 9, 10, 11, 12) | ring(10, 13, 14, 15, 16) | {(16, 20)} | ring(*range(20, 29))
    bonds = spark.createDataFrame(list(edges), "atomi long, atomj long")
    centers = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 22)], "center long, atom long")
    rows = perception.closed_regions(bonds, centers, 2, 6).collect()
    inside = {c: {r.atom: (r.hops, r.pulled) for r in rows if r.center == c} for c in (1, 2, 3)}
    assert inside[1] == {0: (0, False), 1: (1, False), 2: (2, False)}
    assert set(inside[2]) == set(range(17)) and inside[2][3] == (2, False) and inside[2][4] == (3, True) and inside[2][14] == (8, True)
    assert set(inside[3]) == {20, 21, 22, 23, 24}
    small = perception.smallest_rings(bonds, 5).collect()
    assert [(r.size, r.atoms) for r in small] == [(5, [10, 13, 14, 15, 16])]
    assert len(rows) == sum(map(len, inside.values()))


def test_rings_and_regions_of_parts_equal_those_of_joins(spark, monkeypatch):
    """Small parts went through rounds of joins for every path, so tables and seconds grew with all paths of a graph."""
    all_ = graphs(11, 8)
    bonds = bonds_of(spark, all_)
    centers = spark.createDataFrame([(c, 1000 * g + k) for g, (n, _) in enumerate(all_) for c, k in ((g, 0), (g, n - 1), (99, n // 2))], "center long, atom long")
    asked = []
    rounds = perception._rings_by_rounds
    monkeypatch.setattr(perception, "_rings_by_rounds", lambda *a: asked.append(a) or rounds(*a))
    told = []
    for most in (perception.RING_PART, 5):
        monkeypatch.setattr(perception, "RING_PART", most)
        rings = sorted((r.part, r.size) for r in perception.smallest_rings(bonds).collect())
        assert bool(asked) == (most == 5)
        told.append((rings, sorted(map(tuple, perception.closed_regions(bonds, centers, 1, 4).collect()))))
    assert told[0] == told[1] and told[0][0]


def test_parts_across_chunks_are_dealt_by_name(spark, monkeypatch):
    from motefield.operators import parts

    n = 3000
    bonds = spark.createDataFrame([(i, (i + n // 2) % n) for i in range(n // 2)] + [(i, i + 1) for i in range(0, n, 2)], "atomi long, atomj long")
    want = sorted((r.part, r.size) for r in perception.smallest_rings(bonds).collect())
    monkeypatch.setattr(parts, "CHUNK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    assert sorted((r.part, r.size) for r in perception.smallest_rings(bonds).collect()) == want and len(want) == n // 4
    star = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(1, 2), (500, 501)], "atomi long, atomj long")
    assert [(r.part, r.size) for r in perception.smallest_rings(star).collect()] == [(0, 3)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_classes_of_parts_equal_those_of_joins(spark, monkeypatch):
    """Every round joined all bonds of the graph; now only those of large parts, and classes go across both kinds of parts."""
    values = [-(2**63), -5, 0, 1, 7919, 2**40, 2**63 - 1]
    row = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).toPandas()
    assert (perception.hashed(row.a.to_numpy(), row.b.to_numpy()) == row.h.to_numpy()).all()
    ring = lambda first, n: [(first + i, first + (i + 1) % n) for i in range(n)]
    edges = ring(0, 6) + ring(100, 14) + ring(200, 3) + [(300 + i, 301 + i) for i in range(9)] + [(400 + i, 401 + i) for i in range(14)] + [(600, 0), (600, 100), (500, 501), (500, 502), (501, 502), (500, 503), (501, 503), (502, 503)]
    atoms = spark.createDataFrame([(a,) for a in sorted({a for e in edges for a in e} - {600} | {700})], "atom long")
    atoms = atoms.union(atoms.limit(5))  # 600 is not listed
    bonds = spark.createDataFrame(edges, "atomi long, atomj long")
    told = []
    for most in (perception.CLASS_PART, 10):
        monkeypatch.setattr(perception, "CLASS_PART", most)
        classes, rounds = perception.equivalence_classes(atoms, bonds)
        told.append((sorted(map(tuple, classes.collect())), rounds))
    assert told[0] == told[1]
    found, rounds = dict(told[0][0]), told[0][1]
    assert {found[a] for a in (0, 5, 100, 113, 200)} == {0} and found[500] == 500 and found[700] == 700 and rounds == 7
    assert found[300] == 300 and found[309] == 300 and found[400] == found[414] == 400


def test_balls_of_parts_equal_those_of_joins(spark, monkeypatch):
    """All atoms of all regions were joined in every round; regions of small and large parts must still be one kind if alike."""
    all_ = [(n, e) for n, e in graphs(13, 3) if n < 30]
    labels = [(1000 * g + a, "CN"[(a + g) % 2]) for g, (n, _) in enumerate(all_) for a in range(n)] + [(9000 + a, "CN"[a % 2]) for a in range(30)] + [(9900, None)]
    atoms = spark.createDataFrame(labels, "atom long, label string")
    bonds = spark.createDataFrame([(1000 * g + a, 1000 * g + b) for g, (_, e) in enumerate(all_) for a, b in e] + [(9000 + a, 9001 + a) for a in range(29)] + [(9001, 9002)], "atomi long, atomj long")
    centers = atoms.select(F.col("atom").alias("center"), "atom")
    told = []
    for most, ball in ((256, 4096), (8, 4096), (8, 5)):
        monkeypatch.setattr(perception, "BALL_PART", most)
        monkeypatch.setattr(perception, "BALL", ball)
        same, places = perception.alike_regions(atoms, bonds, centers, 2, F.col("label"))
        held = sorted((r.center, r.atom, r.hops) for r in places.collect())
        told.append((sorted(map(tuple, same.collect())), held))
    assert told[0] == told[1] == told[2]


def test_double_bonds_of_parts_equal_those_of_systems(spark, monkeypatch):
    """Every system was solved by itself after five joins; equal shapes are solved once now."""
    all_ = graphs(17, 10)
    bonds = bonds_of(spark, all_).where("atomi is not null")
    atoms = spark.createDataFrame([(1000 * g + a, (a + g) % 5 > 0) for g, (n, _) in enumerate(all_) for a in range(n)], "atom int, need boolean")
    told, calls = [], []
    large = perception._pairs_of_large
    monkeypatch.setattr(perception, "_pairs_of_large", lambda rows: calls.append(1) or large(rows))
    for most in (perception.SYSTEM_PART, 5):
        monkeypatch.setattr(perception, "SYSTEM_PART", most)
        ordered, left = perception.kekule_orders(atoms, bonds, F.col("need"), F.lit(True))
        double = {(r.atomi, r.atomj) for r in ordered.where("order = 2").collect()}
        over = left.collect()
        assert len({a for e in double for a in e}) == 2 * len(double)
        told.append((len(double), sorted(r.part for r in over)))
        assert {a for e in double for a in e} | {r.atom for r in over} == {r.atom for r in atoms.where("need").collect()}
    assert told[0] == told[1] and calls == [1]
