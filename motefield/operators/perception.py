"""What a topology graph says by itself: classes of equivalent atoms, rings, double bonds, regions that are alike.

Colours are pairs of 64-bit hashes. An atom's next colour is a hash of its own and of the sum of its
neighbours' hashed colours; sums are added up before they are shuffled, so an atom of very many
bonds is never gathered. All tables that a round joins are written, so hot keys are split.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.operators.components import connected_components, joined
from motefield.operators.graph import undirected
from motefield.operators.parts import Solve, by_parts, chunks, longs, whole_numbers
from motefield.storage import forget, materialize


def _hash(*values: Column | str | int) -> Column:
    return F.xxhash64(*(F.lit(v).cast("long") if isinstance(v, int) else v for v in values))


def _ways(bonds: DataFrame, label: Column | None) -> DataFrame:
    """(a, b, w) of each bond both ways, loops and nulls left out; parallel bonds stay, as they count."""
    ends = bonds.where("atomi <> atomj").select(F.col("atomi").alias("a"), F.col("atomj").alias("b"), (F.lit(0).cast("long") if label is None else _hash(label)).alias("w"))
    return ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _halves(value: Column, name: str) -> list[Column]:
    """Sums of the lower and the upper 32 bits: whole numbers that no number of rows lets overflow."""
    return [F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias(f"{name}l"), F.sum(F.shiftright(value, 32)).alias(f"{name}h")]


def _refined(state: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, atom, c1, c2) after a round."""
    near = ways.join(state.select(*keys, F.col("atom").alias("b"), "c1", "c2"), [*keys, "b"])
    sums = near.groupBy(*keys, F.col("a").alias("atom")).agg(*(c for i in (1, 2) for c in _halves(_hash(i, "w", "c1", "c2"), f"s{i}")))
    rows = state.join(sums, [*keys, "atom"], "left").fillna(0, ["s1l", "s1h", "s2l", "s2h"])
    return rows.select(*keys, "atom", _hash(3, "c1", "s1l", "s1h", "s2l", "s2h").alias("c1"), _hash(4, "c2", "s2l", "s2h", "s1l", "s1h").alias("c2"))


def hashed(*values: np.ndarray | int) -> np.ndarray:
    """``xxhash64`` of long columns."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h: np.ndarray = np.array([42], np.uint64)
    for value in values:
        x = (h + (p5 + np.uint64(8))) ^ (turn(np.atleast_1d(np.asarray(value, np.int64)).view(np.uint64) * p2, 31) * p1)
        x = turn(x, 27) * p1 + p4
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        h = x ^ (x >> np.uint64(32))
    return h.view(np.int64)


def _summed(value: np.ndarray, starts: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_halves`` of runs of rows from ``starts`` on, as the elements ``at`` of n."""
    out = []
    for half in (value & 0xFFFFFFFF, value >> 32):
        sums = np.zeros(n, np.int64)
        if len(at):
            sums[at] = np.add.reduceat(half, starts)
        out.append(sums)
    return out[0], out[1]


def _distinct(group: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, which rows in that order are the first of their group and colour); groups stay together."""
    order = np.lexsort((c1, group))
    g, x, y = group[order], c1[order], c2[order]
    return order, np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(order)]


def refine(c1: np.ndarray, c2: np.ndarray, group: np.ndarray, groups: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c1, c2, rounds that split a class of each group): rounds of ``_refined`` in many small graphs at once, in each until
    its number of colours stays, with one round more."""
    c1, c2, rounds = c1.copy(), c2.copy(), np.zeros(groups, np.int32)
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]

    def classes(group: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        order, first = _distinct(group, c1, c2)
        return np.bincount(group[order][first], minlength=groups)

    live, g, x, y, count = np.arange(len(c1)), group, c1, c2, classes(group, c1, c2)
    while len(live):
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
        s = [_summed(hashed(i, w, x[b], y[b]), starts, a[starts], len(live)) for i in (1, 2)]
        x, y = hashed(3, x, *s[0], *s[1]), hashed(4, y, *s[1], *s[0])
        more = classes(g, x, y)
        open_ = more != count
        rounds += open_
        stays = open_[g]
        done = ~stays
        c1[live[done]], c2[live[done]] = x[done], y[done]
        if done.any():
            at = np.cumsum(stays) - 1
            keep = stays[a]
            a, b, w = at[a[keep]], at[b[keep]], w[keep]
            live, g, x, y = live[stays], g[stays], x[stays], y[stays]
        count = more
    return c1, c2, rounds


def _settle(state: DataFrame, ways: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """Rounds until the number of classes stays: (colours, classes, rounds that split some class)."""
    classes, rounds = state.select(*keys, "c1", "c2").distinct().count(), 0
    while True:
        new = materialize(_refined(state, ways, keys), "colours")
        more = new.select(*keys, "c1", "c2").distinct().count()
        if more == classes:
            forget(new)
            return state, classes, rounds
        if rounds:
            forget(state)
        state, classes, rounds = new, more, rounds + 1


#: Atoms of a part whose classes are found in one task.
CLASS_PART = 4096


def _classes_of(table: pa.Table, part: np.ndarray) -> pa.Table:
    """(atom, c1, c2, rounds): final colours of rows (u, v, c1, c2) of whole parts; ways have their label as c1."""
    u, (v, way), (c1, _), (c2, _) = table.column("u").to_numpy(), *(longs(table.column(c)) for c in ("v", "c1", "c2"))
    names, first = np.unique(u[~way], return_index=True)
    c1_, c2_ = c1[~way][first], c2[~way][first]
    ends = []
    listed = way & (len(names) > 0)
    for end in (u, v):
        at = np.minimum(np.searchsorted(names, end), max(len(names) - 1, 0))
        if len(names):
            listed &= names[at] == end
        ends.append(at)
    a, b = ends[0][listed], ends[1][listed]
    # atoms that are not listed hold no part together
    root, group = np.unique(joined(len(names), a, b), return_inverse=True)
    x, y, rounds = refine(c1_, c2_, group, len(root), a, b, c1[listed])
    order, one = _distinct(group, x, y)
    told, g = hashed(6, x[order][one], y[order][one]), group[order][one]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    low, high = _summed(told, starts, g[starts], len(root))
    return pa.table({"atom": names, "c1": hashed(7, x, low[group], high[group])[: len(x)], "c2": hashed(8, y, high[group], low[group])[: len(x)], "rounds": rounds[group]})


def _classes_by_joins(state: DataFrame, ways: DataFrame) -> DataFrame:
    """(atom, c1, c2, rounds) as ``_classes_of`` finds it, of (atom, c1, c2) and (a, b, w), both written."""
    here = ways.join(state.select(F.col("atom").alias("a")), "a", "left_semi").join(state.select(F.col("atom").alias("b")), "b", "left_semi")
    part = materialize(connected_components(here, "a", "b").toDF("atom", "part"), "parts")
    state = materialize(state.join(part, "atom", "left").select(F.coalesce("part", "atom").alias("part"), "atom", "c1", "c2"), "colours")
    ways = materialize(here.join(part.withColumnRenamed("atom", "a"), "a").select("part", "a", "b", "w"), "ways")
    classes = lambda df, name: df.distinct().groupBy("part").agg(F.count("*").alias(name))
    rounds, done = 0, []
    count = materialize(classes(state.select("part", "c1", "c2"), "n"), "classes")
    while not state.isEmpty():
        new = materialize(_refined(state, ways, ["part"]), "colours")
        more = materialize(classes(new.select("part", "c1", "c2"), "m"), "classes")
        settled = materialize(more.join(count, "part").where("n = m").select("part", F.lit(True).alias("settled")), "settled")
        turned = new.join(settled, "part", "left")
        done.append(materialize(turned.where("settled").drop("settled").withColumn("rounds", F.lit(rounds)), "settled"))
        forget(state)
        state = materialize(turned.where("settled is null").drop("settled"), "colours")
        forget(new)
        count, rounds = more.toDF("part", "n"), rounds + 1
    final = reduce(DataFrame.union, done)
    signs = materialize(final.select("part", "c1", "c2").distinct().groupBy("part").agg(*_halves(_hash(6, "c1", "c2"), "s")), "signs")
    return final.join(signs, "part").select("atom", _hash(7, "c1", "sl", "sh").alias("c1"), _hash(8, "c2", "sh", "sl").alias("c2"), "rounds")


def equivalence_classes(atoms: DataFrame, bonds: DataFrame, label: Column | None = None, bond_label: Column | None = None) -> tuple[DataFrame, int]:
    """((atom, class), rounds): atoms that colour refinement can't tell apart; a class is named by its least atom.

    Two atoms of a class have equal labels, and their bonds lead to equal numbers of each class by
    each bond label, over the whole graph. A null label is a label. Rounds are at most the
    longest shortest path. Bonds to atoms that are not listed don't count; repeated atoms are one.

    Colours settle in each connected part by itself. Atoms of two parts are of one class if their last colours are equal and the
    sets of last colours in their parts are: a last colour tells its atom's class and those of its neighbours, so equal
    sets say that both parts have the same classes with the same bonds. So small parts are done in one task, larger ones
    by rounds of joins, and colours of both are compared.
    """
    start = atoms.where("atom is not null").select("atom", (F.lit(0) if label is None else label).alias("_l"))
    state = start.select("atom", _hash(1, "_l").alias("c1"), _hash(2, "_l").alias("c2"))
    ends = _ways(bonds, bond_label)
    if whole_numbers(atoms, "atom") and whole_numbers(bonds, "atomi", "atomj"):
        one = materialize(bonds.where("atomi <> atomj").select(F.col("atomi").cast("long").alias("u"), F.col("atomj").cast("long").alias("v"), (F.lit(0).cast("long") if bond_label is None else _hash(bond_label)).alias("c1")), "edges")
        nodes = state.select(F.col("atom").cast("long").alias("u"), F.lit(None).cast("long").alias("v"), "c1", "c2")
        rows = one.union(one.select("v", "u", "c1")).withColumn("c2", F.lit(0).cast("long")).union(nodes)
        found, large = by_parts(rows, ["v"], _classes_of, "atom long, c1 long, c2 long, rounds int", CLASS_PART)
        if large is not None:
            state = materialize(large.where("v is null").select(F.col("u").alias("atom"), "c1", "c2").dropDuplicates(["atom"]), "colours")
            ends = materialize(large.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("c1").alias("w")), "ways")
            found = found.union(materialize(_classes_by_joins(state, ends), "large"))
        found = found.withColumn("atom", F.col("atom").cast(atoms.schema["atom"].dataType))
    else:
        found = materialize(_classes_by_joins(materialize(state.dropDuplicates(["atom"]), "colours"), materialize(ends, "ways")), "classes")
    least = materialize(found.groupBy("c1", "c2").agg(F.min("atom").alias("class")), "classes")
    return found.join(least, ["c1", "c2"]).select("atom", "class"), found.agg(F.coalesce(F.max("rounds"), F.lit(0)).alias("n")).first()["n"]


# --- rings ---------------------------------------------------------------------------------


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges without most of those that lead to an end: no ring has them. Long tails may stay, they only cost time."""
    n = edges.count()
    while n:
        ends = edges.select(F.explode(F.array("atomi", "atomj")).alias("atom")).groupBy("atom").count()
        inner = materialize(ends.where("count > 1").select("atom"), "inner")
        kept = materialize(edges.join(inner.toDF("atomi"), "atomi", "left_semi").join(inner.toDF("atomj"), "atomj", "left_semi"), "core")
        left = kept.count()
        edges, gone, n = kept, n - left, left
        if gone * 20 <= n:
            break
    return edges


def _path_edges(path: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.least(F.get(path, i - 1), F.get(path, i)).alias("a"), F.greatest(F.get(path, i - 1), F.get(path, i)).alias("b")))


def _difference(a: Column, b: Column) -> Column:
    """Edges of one of two cycles only: their sum modulo two."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def _eliminate(new: DataFrame, basis: DataFrame | None) -> DataFrame:
    """Those of ``new`` (id, part, size, ring, rest) that are no sum of smaller ones and of the basis, with what is
    left of them and its greatest edge (id, part, size, ring, rest, pivot).

    Each row's pivot is its greatest edge. Of the rows that share a pivot the one of the basis, else the smallest,
    keeps it and is added to the others, whose pivots so become smaller. A round does so everywhere at once.
    """
    fixed, rows = basis, new
    while True:
        rows = materialize(rows.where(F.size("rest") > 0).withColumn("pivot", F.array_max("rest")), "cycles")
        own = rows.groupBy("pivot").agg(F.min_by("rest", F.struct("size", "id")).alias("other"), F.min(F.struct("size", "id")).alias("first")).withColumn("rank", F.lit(1))
        owners = own if fixed is None else own.union(fixed.join(rows.select("pivot").distinct(), "pivot", "left_semi").select("pivot", F.col("rest").alias("other"), F.struct("size", "id").alias("first"), F.lit(0).alias("rank")))
        owners = materialize(owners.groupBy("pivot").agg(F.min_by(F.struct("other", "first"), "rank").alias("o")).select("pivot", "o.*"), "owners")
        joined = rows.join(owners, "pivot").withColumn("mine", (F.col("first.size") == F.col("size")) & (F.col("first.id") == F.col("id")))
        if joined.where(~F.col("mine")).isEmpty():
            return rows.select("id", "part", "size", "ring", "rest", "pivot")
        rows = joined.select("id", "part", "size", "ring", F.when(F.col("mine"), F.col("rest")).otherwise(_difference(F.col("rest"), F.col("other"))).alias("rest"))


#: Atoms of a part whose rings are found in one task; of larger parts they are found by rounds of joins.
RING_PART = 256


def _blocks(near: dict[int, list[int]]) -> Iterator[list[tuple[int, int]]]:
    """Bonds of each block that has rings: no atom or bond alone holds it together."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        held: list[tuple[int, int]] = []
        stack = [(root, -1, iter(near[root]))]
        while stack:
            v, up, rest = stack[-1]
            for w in rest:
                if w == up:
                    continue
                if w not in order:
                    held.append((v, w))
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(near[w])))
                    break
                if order[w] < order[v]:
                    held.append((v, w))
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if stack:
                    top = stack[-1][0]
                    low[top] = min(low[top], low[v])
                    if low[v] >= order[top]:
                        at = held.index((top, v))
                        if len(held) - at > 1:
                            yield held[at:]
                        del held[at:]


@lru_cache(4096)
def _smallest_basis(edges: tuple[tuple[int, int], ...]) -> list[tuple[int, ...]]:
    """A smallest set of rings, each the numbers of its edges, of a connected graph of nodes 0, 1, ...

    Edges weigh one and a different tiny amount each (bit i of the weight below the length), so shortest paths are unique; each
    ring of the set is then two shortest paths from one of its nodes and the edge between their ends.
    """
    n, m = 1 + max(map(max, edges)), len(edges)
    if n == m:
        simple = [0] * n
        for a, b in edges:
            simple[a] += 1
            simple[b] += 1
        if all(d == 2 for d in simple):
            return [tuple(range(m))]
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, (a, b) in enumerate(edges):
        near[a].append((b, (1 << m) + (1 << i)))
        near[b].append((a, (1 << m) + (1 << i)))
    rings = set()
    for root in range(n):
        far, heap = {}, [(0, root)]
        while heap:
            w, v = heappop(heap)
            if v not in far:
                far[v] = w
                for b, more in near[v]:
                    if b not in far:
                        heappush(heap, (w + more, b))
        bits = (1 << m) - 1
        for i, (a, b) in enumerate(edges):
            p, q = far[a] & bits, far[b] & bits
            if not p & q and not (p | q) >> i & 1:
                rings.add(far[a] + far[b] + (1 << m) + (1 << i))
    basis: dict[int, int] = {}
    kept = []
    for ring in sorted(rings):
        rest = ring & ((1 << m) - 1)
        while rest and rest.bit_length() in basis:
            rest ^= basis[rest.bit_length()]
        if rest:
            basis[rest.bit_length()] = rest
            kept.append(tuple(i for i in range(m) if ring >> i & 1))
            if len(kept) == m - n + 1:
                break
    return kept


def _nearby(part: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, dict[int, list[int]]]]:
    """(part, the neighbours of each of its atoms) of ways both ways; parallel ones are one."""
    order = np.lexsort((v, u, part))
    ends = np.stack([part, u, v], axis=1)[order]
    ends = ends[np.append(True, (ends[1:] != ends[:-1]).any(axis=1))[: len(ends)]]
    starts = np.flatnonzero(np.append(True, ends[1:, 0] != ends[:-1, 0])[: len(ends)])
    for start, stop in zip(starts.tolist(), np.append(starts[1:], len(ends)).tolist(), strict=False):
        near: dict[int, list[int]] = {}
        for a, b in ends[start:stop, 1:].tolist():
            near.setdefault(a, []).append(b)
        yield int(ends[start, 0]), near


def _part_rings(near: dict[int, list[int]]) -> Iterator[list[tuple[int, int]]]:
    """Bonds of each ring of a smallest set."""
    if sum(map(len, near.values())) < 2 * len(near):
        return  # a tree
    for block in _blocks(near):
        names = sorted({x for e in block for x in e})
        number = {x: i for i, x in enumerate(names)}
        shape = tuple(sorted((number[a], number[b]) if a < b else (number[b], number[a]) for a, b in block))
        for ring in _smallest_basis(shape):
            yield [(names[shape[i][0]], names[shape[i][1]]) for i in ring]


def _rings_of(table: pa.Table, part: np.ndarray) -> pa.Table:
    """(part, size, ring) of rows (u, v) of whole parts."""
    parts, size, ends = [], [], []
    for name, near in _nearby(part, *(table.column(c).to_numpy() for c in "uv")):
        for ring in _part_rings(near):
            parts.append(name)
            size.append(len(ring))
            ends += ring
    edges = pa.StructArray.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), edges)
    return pa.table({"part": pa.array(parts, pa.int64()), "size": pa.array(size, pa.int32()), "ring": rings})


def smallest_rings(bonds: DataFrame, max_size: int | None = None) -> DataFrame:
    """(ring, part, size, atoms, edges): a smallest set of rings of which all rings are sums; ``part``: the
    least atom of the connected part that it is in. A part of E bonds and V atoms has E - V + 1 rings.

    Parts of up to ``RING_PART`` atoms are dealt whole (``by_parts``) and their blocks done one by one; rings of larger
    parts, and of atoms that are no whole numbers, come from rounds of joins (``_rings_by_rounds``).

    With ``max_size`` only rings of at most so many atoms are given.

    Which of several rings of one size is kept is a matter of names; sizes are the same for any
    choice. Loops and nulls are left out, parallel bonds are one, no bonds have no rings.
    """
    if not whole_numbers(bonds, "atomi", "atomj"):
        rings = _rings_by_rounds(bonds, max_size)
    else:
        kind = "bigint" if "long" in {bonds.schema[c].dataType.typeName() for c in ("atomi", "atomj")} else bonds.schema["atomi"].dataType.simpleString()
        ends = materialize(bonds.where("atomi <> atomj").select(F.col("atomi").cast("long").alias("u"), F.col("atomj").cast("long").alias("v")), "edges")
        rings, large = by_parts(ends.union(ends.select("v", "u")), ["v"], _rings_of, "part long, size int, ring array<struct<a:bigint,b:bigint>>", RING_PART)
        if large is not None:
            rings = rings.union(_rings_by_rounds(large.where("u < v").select(F.col("u").alias("atomi"), F.col("v").alias("atomj")), max_size))
        rings = rings.select(F.col("part").cast(kind).alias("part"), "size", F.col("ring").cast(f"array<struct<a:{kind},b:{kind}>>").alias("ring"))
    if max_size is not None:
        rings = rings.where(F.col("size") <= max_size)
    atoms = F.array_sort(F.array_distinct(F.flatten(F.transform("ring", lambda e: F.array(e["a"], e["b"])))))
    return rings.select(F.sha2(F.to_json(F.array_sort("ring")), 256).alias("ring"), "part", "size", atoms.alias("atoms"), F.array_sort("ring").alias("edges"))


def _rings_by_rounds(bonds: DataFrame, max_size: int | None) -> DataFrame:
    """(part, size, ring) by joins alone; rings larger than ``max_size`` may be among them.

    Ends are peeled off. A part that is one ring is known at once. In the others shortest paths start at every
    atom and go over atoms of fewer bonds only (then of smaller hash), a step a round, so an atom of very many bonds is
    passed by no path but its own. Two paths that meet at an atom or by a bond are a candidate: at an
    atom the first path with each other one, as other pairs are sums of these. Candidates are kept,
    smallest first, if they are no sum of those kept (``_eliminate``); a part with all its rings takes part no
    longer. So rounds are half the largest ring of a fused part, and no part is gathered in one task.
    """
    given = materialize(undirected(bonds), "edges")
    edges = _peeled(given)
    part = materialize(connected_components(given, "atomi", "atomj").select(F.col("node").alias("atom"), F.col("component").alias("part")), "parts")
    edges = materialize(edges.join(part.select(F.col("atom").alias("atomi"), "part"), "atomi"), "edges")
    degree = materialize(edges.select("part", F.explode(F.array("atomi", "atomj")).alias("atom")).groupBy("part", "atom").agg(F.count("*").alias("d")), "degrees")
    sizes = materialize(degree.groupBy("part").agg((F.sum("d") / 2 - F.count("*") + 1).cast("long").alias("rings")).where("rings > 0"), "sizes")
    plain = materialize(degree.groupBy("part").agg(F.max("d").alias("d")).where("d = 2").join(sizes.where("rings = 1"), "part", "left_semi").select("part"), "plain")
    whole = edges.join(plain, "part", "left_semi").groupBy("part").agg(F.collect_list(F.struct(F.col("atomi").alias("a"), F.col("atomj").alias("b"))).alias("ring"))
    found = [whole.select("part", F.size("ring").alias("size"), "ring")]
    open_ = materialize(sizes.join(plain, "part", "left_anti"), "open")
    key = materialize(degree.join(open_, "part", "left_semi").select("part", "atom", F.struct("d", _hash("atom").alias("h"), "atom").alias("key")), "keys")
    ends = edges.join(open_, "part", "left_semi").select("part", "atomi", "atomj")
    both = ends.select("part", F.col("atomi").alias("a"), F.col("atomj").alias("b")).union(ends.select("part", F.col("atomj").alias("a"), F.col("atomi").alias("b")))
    ways = materialize(both.join(key.select(F.col("atom").alias("b"), F.col("key").alias("kb")), "b").select("part", "a", "b", "kb"), "ways")
    level = materialize(key.select("part", F.col("atom").alias("root"), F.col("key").alias("kr"), "atom", F.array("atom").alias("path")), "level")
    before, basis, kept, reach = level.limit(0), None, [], 1  # the smallest ring that a round can close
    while not open_.isEmpty() and (max_size is None or reach <= max_size):
        reach += 2
        step = level.join(ways.drop("part"), F.col("atom") == F.col("a")).where("kb < kr").select("part", "root", "kr", F.col("b").alias("atom"), F.concat("path", F.array("b")).alias("path"))
        step = step.join(before.select("root", "atom"), ["root", "atom"], "left_anti")
        # paths that meet at a bond: both its ends are of this level
        far = level.select("root", F.col("atom").alias("to"), F.col("path").alias("other"))
        odd = step.withColumn("to", F.col("atom")).join(far, ["root", "to"]).where(F.get("path", F.size("path") - 2) < F.col("to")).select("part", "path", "other")
        step = materialize(step.join(level.select("root", "atom"), ["root", "atom"], "left_anti"), "steps")
        # paths that meet at an atom: the first of them with each other one
        next_ = materialize(step.groupBy("part", "root", "kr", "atom").agg(F.min("path").alias("path")), "level")
        even = step.join(next_.select("root", "atom", F.col("path").alias("other")), ["root", "atom"]).where("path <> other").select("part", "path", "other")
        made = odd.union(even).where(F.size(F.array_intersect("path", "other")) == 2)  # root and end
        ring = F.array_sort(F.array_union(_path_edges("path"), _path_edges("other")))
        new = made.select("part", ring.alias("ring")).distinct().select(F.sha2(F.to_json("ring"), 256).alias("id"), "part", F.size("ring").alias("size"), "ring", F.col("ring").alias("rest"))
        new = materialize(new, "candidates")
        if not new.isEmpty():
            basis_new = _eliminate(new, basis)
            kept.append(basis_new)
            basis = materialize(reduce(DataFrame.union, kept), "basis")
            kept = [basis]
            have = basis.groupBy("part").agg(F.count("*").alias("n"))
            open_ = materialize(open_.join(have, "part", "left").where(F.coalesce("n", F.lit(0)) < F.col("rings")).drop("n"), "open")
        before, level = level, materialize(next_.join(open_, "part", "left_semi"), "level")
        if level.isEmpty():
            break
    if basis is not None:
        found.append(basis.select("part", "size", "ring"))
    return reduce(DataFrame.union, found)


# --- double bonds --------------------------------------------------------------------------


def most_pairs(near: list[list[int]]) -> list[int]:
    """The partner of each node in a largest matching, -1 for none; ``near`` lists each node's neighbours.

    From each free node a search tree grows over pairs; two even nodes that meet close an odd ring, which from then on
    counts as its base, and a free node that is met ends a path along which pairs are swapped.
    """
    n = len(near)
    mate = [-1] * n
    for a in range(n):  # a start that is near a largest one: the neighbour of fewest bonds first
        if mate[a] < 0:
            free = [b for b in near[a] if mate[b] < 0]
            if free:
                b = min(free, key=lambda v: len(near[v]))
                mate[a], mate[b] = b, a
    for root in range(n):
        if mate[root] < 0:
            _augment(root, near, mate)
    return mate


def _augment(root: int, near: list[list[int]], mate: list[int]) -> None:
    # only nodes that the search meets have entries
    base: dict[int, int] = {}
    parent: dict[int, int] = {}
    even, queue = {root}, deque([root])
    at = lambda v: base.get(v, v)

    def up(v: int) -> Iterator[int]:
        """Bases of even nodes from ``v`` to the root."""
        while True:
            v = at(v)
            yield v
            if v == root or mate[v] < 0:
                return
            v = parent[mate[v]]

    def close(v: int, top: int, child: int, ring: set[int]) -> None:
        while at(v) != top:
            ring |= {at(v), at(mate[v])}
            parent[v] = child
            child = mate[v]
            v = parent[child]

    while queue:
        v = queue.popleft()
        for w in near[v]:
            if at(v) == at(w) or mate[v] == w:
                continue
            if w in even:
                above = set(up(v))
                top = next(b for b in up(w) if b in above)
                ring: set[int] = set()
                close(v, top, w, ring)
                close(w, top, v, ring)
                for u in [u for u in (even | set(parent)) if at(u) in ring]:
                    base[u] = top
                    if u not in even:
                        even.add(u)
                        queue.append(u)
            elif w not in parent:
                parent[w] = v
                if mate[w] < 0:
                    while w >= 0:
                        v = parent[w]
                        following = mate[v]
                        mate[w], mate[v], w = v, w, following
                    return
                even.add(mate[w])
                queue.append(mate[w])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of (part, atomi, atomj) rows that come part by part."""

    def solve(part: int, ends: list[tuple[int, int]]) -> pa.RecordBatch:
        names = sorted({v for e in ends for v in e})
        number = {v: i for i, v in enumerate(names)}
        near: list[list[int]] = [[] for _ in names]
        for a, b in ends:
            near[number[a]].append(number[b])
            near[number[b]].append(number[a])
        mate = most_pairs(near)
        found = [(names[i], names[m]) for i, m in enumerate(mate) if m > i]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([part] * len(found), [a for a, _ in found], [b for _, b in found])], ["part", "atomi", "atomj"])

    now, ends = None, []
    for batch in batches:
        for part, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if part != now:
                if ends:
                    yield solve(now, ends)
                now, ends = part, []
            ends.append((a, b))
    if ends:
        yield solve(now, ends)


#: Atoms of a part whose systems are dealt by ranges of atoms.
SYSTEM_PART = 1 << 14


@lru_cache(1 << 14)
def _pairs_of_shape(near: tuple[tuple[int, ...], ...]) -> list[int]:
    return most_pairs([list(x) for x in near])


def _pairs_of(table: pa.Table, part: np.ndarray) -> pa.Table:
    """(part, atomi, atomj), atoms left over without atomj, of rows (u, v) of whole parts. Many systems have one shape, which is solved once."""
    u, (v, way) = table.column("u").to_numpy(), longs(table.column("v"))
    names = np.unique(u[~way])
    listed = way & np.isin(u, names) & np.isin(v, names)
    a, b = np.searchsorted(names, u[listed]), np.searchsorted(names, v[listed])
    root = joined(len(names), a, b)  # atoms without a need hold no system together
    mate = np.full(len(names), -1)
    for _, near in _nearby(root[a], a, b):
        own = list(near)
        number = {x: i for i, x in enumerate(own)}
        pairs = _pairs_of_shape(tuple(tuple(number[y] for y in x) for x in near.values()) if len(own) <= 64 else ()) or most_pairs([[number[y] for y in x] for x in near.values()])
        mate[own] = [own[m] if m >= 0 else -1 for m in pairs]
    here = np.flatnonzero((mate < 0) | (mate > np.arange(len(names))))
    other = pa.array(names[mate[here]] if len(names) else names, pa.int64(), mask=mate[here] < 0)
    return pa.table({"part": names[root[here]] if len(names) else names, "atomi": names[here], "atomj": other})


def kekule_orders(atoms: DataFrame, bonds: DataFrame, takes: Column, aromatic: Column) -> tuple[DataFrame, DataFrame]:
    """(bonds with ``order``, (part, atom) of atoms left over): single and double bonds of aromatic systems.

    ``takes`` says which atoms must have a double bond, ``aromatic`` which bonds may be one (null: no). The double bonds are
    a largest matching of each system, a connected part of such atoms and bonds; a system that has
    atoms left over has no legal set of double bonds, and they are named. ``order`` is 2 or 1 for aromatic bonds and null
    for others; of parallel bonds each has the order.

    Systems are independent: dealt by ranges of atoms where they are small, else by their name, and solved one after the other; one
    system is in one task, whose memory grows with the largest system, not with the number of them. Atoms are whole numbers.
    """
    inside = atoms.where(F.coalesce(takes, F.lit(False)) & F.col("atom").isNotNull()).select("atom")
    edges = bonds.where(F.coalesce(aromatic, F.lit(False)) & (F.col("atomi") != F.col("atomj"))).select("atomi", "atomj")
    edges = materialize(edges.select(*(F.col(c).cast("long").alias(n) for c, n in (("atomi", "u"), ("atomj", "v")))), "aromatic")
    rows = edges.union(edges.select("v", "u")).union(inside.select(F.col("atom").cast("long").alias("u"), F.lit(None).cast("long")))
    pairs, large = by_parts(rows, ["v"], _pairs_of, "part long, atomi long, atomj long", SYSTEM_PART)
    if large is not None:
        pairs = pairs.union(_pairs_of_large(large))
    double = pairs.where("atomj is not null").select(F.col("atomi").alias("_a"), F.col("atomj").alias("_b"), F.lit(True).alias("_double"))
    with_ends = bonds.withColumns({"_a": F.least("atomi", "atomj"), "_b": F.greatest("atomi", "atomj")})
    order = F.when(F.coalesce(aromatic, F.lit(False)), F.when(F.col("_double"), 2).otherwise(1))
    ordered = with_ends.join(double, ["_a", "_b"], "left").withColumn("order", order).drop("_a", "_b", "_double")
    left = pairs.where("atomj is null").select("part", F.col("atomi").cast(atoms.schema["atom"].dataType).alias("atom"))
    return ordered, left


def _pairs_of_large(rows: DataFrame) -> DataFrame:
    """(part, atomi, atomj), atoms left over without atomj, of rows (u, v) of large parts: a system is one task's."""
    inside = materialize(rows.where("v is null").select(F.col("u").alias("atom")).distinct(), "takes")
    edges = rows.where("u < v").select(F.col("u").alias("atomi"), F.col("v").alias("atomj")).distinct()
    for end in ("atomi", "atomj"):
        edges = edges.join(inside.withColumnRenamed("atom", end), end, "left_semi")
    edges = materialize(edges.select("atomi", "atomj"), "aromatic")
    part = materialize(connected_components(edges, "atomi", "atomj").select(F.col("node").alias("atom"), F.col("component").alias("part")), "systems")
    named = edges.join(part.withColumnRenamed("atom", "atomi"), "atomi").select("part", "atomi", "atomj")
    pairs = materialize(named.repartition("part").sortWithinPartitions("part", "atomi", "atomj").mapInArrow(_paired, "part long, atomi long, atomj long"), "pairs")
    taken = pairs.select(F.explode(F.array("atomi", "atomj")).alias("atom"))
    left = inside.join(taken, "atom", "left_anti").join(part, "atom", "left")
    return pairs.union(left.select(F.coalesce("part", "atom"), "atom", F.lit(None).cast("long")))


# --- regions -------------------------------------------------------------------------------


def regions(bonds: DataFrame, centers: DataFrame, radius: int) -> DataFrame:
    """(center, atom, hops) of all atoms within ``radius`` bonds of each center; ``centers``: (center, atom), one or
    more atoms each. All centers go on together, one join a step."""
    ways = materialize(_ways(undirected(bonds), None).select("a", "b"), "ways")
    level = materialize(centers.where("center is not null and atom is not null").select("center", "atom").distinct().withColumn("hops", F.lit(0)), "level")
    seen, before = [level], level.limit(0)
    for hops in range(1, radius + 1):
        near = level.join(ways, F.col("atom") == F.col("a")).select("center", F.col("b").alias("atom")).distinct()
        new = near.join(level, ["center", "atom"], "left_anti").join(before, ["center", "atom"], "left_anti")
        before, level = level, materialize(new.withColumn("hops", F.lit(hops)), "level")
        seen.append(level)
    return reduce(DataFrame.union, seen)


def ring_systems(bonds: DataFrame, max_size: int) -> DataFrame:
    """(atom, system): atoms of rings of at most ``max_size`` atoms; rings that share an atom are one system,
    named by its least atom.

    Every ring of that size is a sum of smallest rings no larger than itself, so their bonds hold it.
    """
    ends = smallest_rings(bonds, max_size).select(F.explode("edges").alias("e")).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
    return connected_components(ends).toDF("atom", "system")


def _closed_of(radius: int, max_ring_size: int) -> Solve:
    """Rows (center, atom, hops, pulled) of whole parts with their centers."""

    def solve(table: pa.Table, part: np.ndarray) -> pa.Table:
        u, (v, way), (center, _) = table.column("u").to_numpy(), longs(table.column("v")), longs(table.column("center"))
        begin: dict[int, dict[int, set[int]]] = {}
        for p, c, atom in zip(part[~way].tolist(), center[~way].tolist(), u[~way].tolist(), strict=True):
            begin.setdefault(p, {}).setdefault(c, set()).add(atom)
        out: list[tuple[int, int, int, bool]] = []

        def spread(c: int, near: dict[int, list[int]], system: dict[int, int], members: dict[int, list[int]]) -> None:
            level, hops, held = set(begin[p][c]), 0, {}
            while level:
                held |= dict.fromkeys(level, hops)
                out.extend((c, atom, hops, False) for atom in level)
                if hops == radius:
                    break
                hops += 1
                level = {w for x in level for w in near.get(x, ()) if w not in held}
            pulled = {x for s in {system[x] for x in held if x in system} for x in members[s]} - held.keys()
            while pulled:
                hops += 1
                level = {w for x in level for w in near.get(x, ()) if w in pulled}
                out.extend((c, atom, hops, True) for atom in level)
                pulled -= level

        met = np.isin(part, np.fromiter(begin, np.int64, len(begin))) & way
        for p, near in _nearby(part[met], u[met], v[met]):
            system: dict[int, int] = {}
            members: dict[int, list[int]] = {}
            for ring in _part_rings(near):
                if len(ring) <= max_ring_size:
                    one = {x for e in ring for x in e}
                    whole = one.union(*(members.pop(s) for s in {system[x] for x in one if x in system}))
                    name = min(whole)
                    members[name] = sorted(whole)
                    system |= dict.fromkeys(whole, name)
            for c in begin[p]:
                spread(c, near, system, members)
            del begin[p]
        for p in list(begin):  # atoms without bonds
            for c in begin[p]:
                spread(c, {}, {}, {})
        kinds = {"center": pa.int64(), "atom": pa.int64(), "hops": pa.int32(), "pulled": pa.bool_()}
        return pa.table({name: pa.array([row[k] for row in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    return solve


def closed_regions(bonds: DataFrame, centers: DataFrame, radius: int, max_ring_size: int) -> DataFrame:
    """(center, atom, hops, pulled): ``regions`` in which no ring of at most ``max_ring_size`` atoms is cut.

    A ring that the radius reaches comes in whole, with all rings that share atoms with it; ``pulled`` marks what came
    in so, and its ``hops`` go on within the region. Larger rings are cut like any path.

    Parts of up to ``RING_PART`` atoms are dealt whole with their centers, larger ones go on by joins.
    """
    if not (whole_numbers(bonds, "atomi", "atomj") and whole_numbers(centers, "center", "atom")):
        return _closed_by_joins(bonds, centers, radius, max_ring_size)
    ends = materialize(bonds.where("atomi <> atomj").select(F.col("atomi").cast("long").alias("u"), F.col("atomj").cast("long").alias("v")), "edges")
    from_ = materialize(centers.where("center is not null and atom is not null").select(F.col("atom").cast("long").alias("u"), F.col("center").cast("long").alias("center")), "centers")
    ways = ends.union(ends.select("v", "u")).withColumn("center", F.lit(None).cast("long"))
    rows = ways.union(from_.select("u", F.lit(None).cast("long"), "center"))
    found, large = by_parts(rows, ["v"], _closed_of(radius, max_ring_size), "center long, atom long, hops int, pulled boolean", RING_PART)
    if large is not None:
        more = large.where("u < v").select(F.col("u").alias("atomi"), F.col("v").alias("atomj"))
        found = found.union(_closed_by_joins(more, large.where("v is null").select("center", F.col("u").alias("atom")), radius, max_ring_size))
    return found.select(F.col("center").cast(centers.schema["center"].dataType), F.col("atom").cast(centers.schema["atom"].dataType), "hops", "pulled")


def _closed_by_joins(bonds: DataFrame, centers: DataFrame, radius: int, max_ring_size: int) -> DataFrame:
    held = materialize(regions(bonds, centers, radius), "regions")
    system = materialize(ring_systems(bonds, max_ring_size), "systems")
    touched = materialize(held.join(system, "atom").select("center", "system").distinct(), "touched")
    pulled = materialize(touched.join(system, "system").select("center", "atom").join(held, ["center", "atom"], "left_anti"), "pulled")
    ways = materialize(_ways(undirected(bonds), None).select("a", "b"), "ways")
    level, found, hops = held.where(F.col("hops") == radius).select("center", "atom"), [held.withColumn("pulled", F.lit(False))], radius
    rest = pulled
    while not rest.isEmpty():
        hops += 1
        near = level.join(ways, F.col("atom") == F.col("a")).select("center", F.col("b").alias("atom")).distinct()
        level = materialize(rest.join(near, ["center", "atom"], "left_semi"), "level")
        found.append(level.select("center", "atom", F.lit(hops).alias("hops"), F.lit(True).alias("pulled")))
        rest = materialize(rest.join(level, ["center", "atom"], "left_anti"), "rest")
    return reduce(DataFrame.union, found)


def alike_regions(atoms: DataFrame, bonds: DataFrame, centers: DataFrame, radius: int, label: Column, bond_label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((center, region), (center, atom, hops, place)): which regions are the same but for the names of atoms.

    ``region`` is the least center of equal regions and ``place`` an atom's number in its region, so that atoms
    of one place correspond in all regions that are equal. Labels, bonds and distances from the center are compared.

    Atoms of a region are refined by colour until the number of classes stays; where several atoms share a
    colour, one of them is told apart and refinement goes on. The numbered region is then written out, and regions
    are equal if what is written is equal, not if hashes are. Regions are at times told apart although equal,
    where refinement alone can't see that some atoms may be exchanged (regular graphs of several rings);
    nothing different is ever taken for equal.
    """
    if not (whole_numbers(atoms, "atom") and whole_numbers(bonds, "atomi", "atomj") and whole_numbers(centers, "center", "atom")) or not centers.where("center <> atom").isEmpty():
        written, places = _alike_by_joins(atoms, bonds, centers, radius, label, bond_label)
    else:
        written, places = _alike_by_parts(atoms, bonds, centers, radius, label, bond_label)
    first = materialize(written.groupBy("form").agg(F.min("center").alias("region")), "first")
    same = written.join(first, "form").select("center", "region")
    return same, places


def _alike_by_parts(atoms: DataFrame, bonds: DataFrame, centers: DataFrame, radius: int, label: Column, bond_label: Column | None) -> tuple[DataFrame, DataFrame]:
    """((center, form), (center, atom, hops, place)) where each center is an atom's own name: regions of small parts are found and
    numbered in one task, those of larger parts are found by joins and dealt by center, and only regions of more than ``BALL`` atoms go on by joins."""
    none, kind = F.lit(None).cast("long"), F.lit("") if bond_label is None else bond_label
    told = lambda c: F.to_json(F.array(c.cast("string")))
    one = materialize(bonds.where("atomi <> atomj").select(F.col("atomi").cast("long").alias("u"), F.col("atomj").cast("long").alias("v"), _hash(kind.cast("string")).alias("h"), told(kind).alias("s")), "edges")
    named = atoms.where("atom is not null").select(F.col("atom").cast("long").alias("u"), none.alias("v"), none.alias("center"), _hash(label.cast("string")).alias("h"), told(label).alias("s"))
    from_ = centers.where("center is not null and atom is not null").select(F.col("atom").cast("long").alias("u"), none.alias("v"), F.col("center").cast("long").alias("center"), none.alias("h"), F.lit(None).cast("string").alias("s"))
    ways = one.union(one.select("v", "u", "h", "s")).select("u", "v", none.alias("center"), "h", "s")
    found, large = by_parts(ways.union(named).union(from_), ["v"], _balls_of(radius), _BALLS, BALL_PART)
    more = []
    if large is not None:
        ends = materialize(large.where("u < v").select(F.col("u").alias("atomi"), F.col("v").alias("atomj"), "h", "s"), "edges")
        nodes = materialize(large.where("v is null and center is null").select(F.col("u").alias("atom"), "h", "s").dropDuplicates(["atom"]), "atoms")
        begin = large.where("center is not null").select("center", F.col("u").alias("atom"))
        held = materialize(regions(ends, begin, radius), "regions")
        big = materialize(held.groupBy("center").agg(F.count("*").alias("n")).where(F.col("n") > BALL).select("center"), "big")
        held = materialize(held.join(big, "center", "left_anti").join(nodes, "atom"), "inside")
        a, b = held.select("center", F.col("atom").alias("u")), held.select("center", F.col("atom").alias("v"))
        both = ends.toDF("u", "v", "h", "s").union(ends.select("atomj", "atomi", "h", "s"))
        links = both.join(a, "u").join(b, ["center", "v"]).select("center", "u", "v", F.lit(0).alias("hops"), "h", "s")
        rows = held.select("center", F.col("atom").alias("u"), none.alias("v"), "hops", "h", "s").union(links)
        found = found.union(materialize(rows.repartition("center").sortWithinPartitions("center").mapInArrow(_balls_dealt, _BALLS), "balls"))
        if not big.isEmpty():
            more.append(_alike_by_joins(nodes.select("atom", "s"), ends, begin.join(big, "center", "left_semi"), radius, F.col("s"), F.col("s")))
    written, places = found.select("center", "form"), found.select("center", F.posexplode(F.arrays_zip("atoms", "hops")).alias("place", "p")).select("center", "p.atoms", "p.hops", "place").toDF("center", "atom", "hops", "place")
    for w, p in more:
        written, places = written.union(w), places.union(p)
    return written, places


def _alike_by_joins(atoms: DataFrame, bonds: DataFrame, centers: DataFrame, radius: int, label: Column, bond_label: Column | None) -> tuple[DataFrame, DataFrame]:
    """((center, form), (center, atom, hops, place)) of regions of any size."""
    held = materialize(regions(bonds, centers, radius), "regions")
    named = atoms.select("atom", label.alias("_l")).dropDuplicates(["atom"])
    inside = materialize(held.join(named, "atom").select("center", "atom", "hops", "_l"), "inside")
    ends = bonds.where("atomi <> atomj").select(F.col("atomi").alias("a"), F.col("atomj").alias("b"), (F.lit("") if bond_label is None else bond_label.cast("string")).alias("_w"))
    a, b = inside.select("center", F.col("atom").alias("a")), inside.select("center", F.col("atom").alias("b"))
    links = materialize(ends.join(a, "a").join(b, ["center", "b"]).select("center", "a", "b", "_w"), "links")
    way = links.select("center", "a", "b", _hash("_w").alias("w"))
    ways = materialize(way.union(way.select("center", F.col("b").alias("a"), F.col("a").alias("b"), "w")), "ways")
    state = materialize(inside.select("center", "atom", _hash(1, "_l", "hops").alias("c1"), _hash(2, "_l", "hops").alias("c2")), "colours")
    while True:
        state, _, _ = _settle(state, ways, ["center"])
        shared = state.groupBy("center", "c1", "c2").agg(F.count("*").alias("n"), F.min("atom").alias("atom")).where("n > 1")
        # of each region the first colour that atoms share loses its least atom to a colour of its own
        one = materialize(shared.groupBy("center").agg(F.min_by("atom", F.struct("c1", "c2")).alias("atom")).withColumn("apart", F.lit(True)), "apart")
        if one.isEmpty():
            break
        moved = state.join(one, ["center", "atom"], "left")
        state = materialize(moved.select("center", "atom", F.when(F.col("apart"), _hash(5, "c1")).otherwise(F.col("c1")).alias("c1"), "c2"), "colours")
    place = F.row_number().over(Window.partitionBy("center").orderBy("c1", "c2")) - 1
    placed = materialize(state.select("center", "atom", place.alias("place")), "places")
    nodes = inside.join(placed, ["center", "atom"]).groupBy("center").agg(F.array_sort(F.collect_list(F.struct("place", "hops", F.col("_l").cast("string").alias("l")))).alias("nodes"))
    ends = links.join(placed.toDF("center", "a", "pa"), ["center", "a"]).join(placed.toDF("center", "b", "pb"), ["center", "b"])
    lines = ends.groupBy("center").agg(F.array_sort(F.collect_list(F.struct(F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q"), "_w"))).alias("lines"))
    written = materialize(nodes.join(lines, "center", "left").select("center", F.to_json(F.struct("nodes", "lines")).alias("form")), "forms")
    return written, inside.join(placed, ["center", "atom"]).select("center", "atom", "hops", "place")


#: Centers whose regions a task numbers together, and atoms of a part whose regions are found in one task.
BALLS, BALL_PART = 8192, 256
#: Atoms of a region that is numbered in one task.
BALL = 4096
_BALLS = "center long, form string, atoms array<bigint>, hops array<int>"


def _numbered(center: np.ndarray, g: np.ndarray, atom: np.ndarray, hops: np.ndarray, h: np.ndarray, s: pa.Array, a: np.ndarray, b: np.ndarray, w: np.ndarray, t: pa.Array) -> pa.Table:
    """``_BALLS`` of regions: g, atom, hops, label (hash, text) of each atom, ends and label of each bond both ways, all in rows
    of atoms; g counts from 0 to the last center."""
    k, n = len(center), len(g)
    c1, c2 = (hashed(i, h, hops)[:n] for i in (1, 2))
    live = np.ones(k, bool)
    while live.any():
        node, way = live[g], live[g[a]]
        at, group = np.cumsum(node) - 1, np.cumsum(live) - 1
        x, y, _ = refine(c1[node], c2[node], group[g[node]], int(live.sum()), at[a[way]], at[b[way]], w[way])
        c1[node], c2[node] = x, y
        here = np.flatnonzero(node)
        here = here[np.lexsort((atom[here], c2[here], c1[here], g[here]))]
        same = (g[here[1:]] == g[here[:-1]]) & (c1[here[1:]] == c1[here[:-1]]) & (c2[here[1:]] == c2[here[:-1]])
        shared = here[:-1][same]  # the least atom of the first colour that atoms share comes first
        groups, first = np.unique(g[shared], return_index=True)
        c1[shared[first]] = hashed(5, c1[shared[first]])[: len(first)]
        live = np.zeros(k, bool)
        live[groups] = True
    order = np.lexsort((c2, c1, g))
    ends = np.concatenate([[0], np.cumsum(np.bincount(g, minlength=k))]).astype(np.int32)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - ends[g[order]]
    text = lambda x: pa.array(x).cast(pa.string())
    nodes = pc.binary_join_element_wise(text(hops[order]), s.take(pa.array(order)), "")
    p, q = place[a], place[b]
    code = np.unique(t.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1] if len(t) else np.zeros(0, int)
    one = np.flatnonzero(p < q)
    one = one[np.lexsort((code[one], q[one], p[one], g[a[one]]))]
    lines = pc.binary_join_element_wise(text(p[one]), text(q[one]), t.take(pa.array(one)), " ")
    stops = np.concatenate([[0], np.cumsum(np.bincount(g[a[one]], minlength=k))]).astype(np.int32)
    form = pc.binary_join_element_wise(*(pc.binary_join(pa.ListArray.from_arrays(pa.array(o), v), ";") for o, v in ((ends, nodes), (stops, lines))), "|")
    return pa.table({"center": center, "form": form, "atoms": pa.ListArray.from_arrays(pa.array(ends), pa.array(atom[order])), "hops": pa.ListArray.from_arrays(pa.array(ends), pa.array(hops[order].astype(np.int32)))})


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of the ranges."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _balls_of(radius: int) -> Solve:
    """``_BALLS`` of rows of whole parts: (u, h, s) atoms, (u, center) centers, (u, v, h, s) ways."""

    def solve(table: pa.Table, part: np.ndarray) -> pa.Table:
        u, (v, way), (c, start), (h, _) = table.column("u").to_numpy(), *(longs(table.column(x)) for x in ("v", "center", "h"))
        s = table.column("s").combine_chunks()
        nodes = np.unique(u)
        n = len(nodes)
        rows = np.flatnonzero(~way & ~start)
        listed, first = np.unique(u[rows], return_index=True)
        row_of = np.full(n, -1)
        row_of[np.searchsorted(nodes, listed)] = rows[first]
        ways = np.flatnonzero(way)
        ways = ways[np.argsort(u[ways], kind="stable")]
        to, size = np.searchsorted(nodes, v[ways]), np.bincount(np.searchsorted(nodes, u[ways]), minlength=n)
        begin = np.cumsum(size) - size
        centers = np.unique(c[start])
        made = []
        for lo in range(0, max(len(centers), 1), BALLS):
            some = centers[lo : lo + BALLS]
            level = np.arange(len(some)) * n + np.searchsorted(nodes, some)
            keys, hops = level, np.zeros(len(level), np.int64)
            for step in range(1, radius + 1):
                which, at = _gathered(begin[level % n], size[level % n]) if n else (level, level)
                level = np.setdiff1d(level[which] // max(n, 1) * n + to[at], keys)
                keys, hops = np.append(keys, level), np.append(hops, np.full(len(level), step))
            order = np.argsort(keys)
            keys, hops = keys[order], hops[order]
            if n:
                told = row_of[keys % n] >= 0
                keys, hops = keys[told], hops[told]
            g, node = (keys // n, keys % n) if n else (keys, keys)
            a, at = _gathered(begin[node], size[node])
            goal = g[a] * n + to[at]
            b = np.minimum(np.searchsorted(keys, goal), max(len(keys) - 1, 0))
            inside = keys[b] == goal
            a, b, at = a[inside], b[inside], ways[at[inside]]
            row = row_of[node]
            kept = np.unique(g)  # a center that is not listed may have nothing near it
            made.append(_numbered(some[kept], np.searchsorted(kept, g), nodes[node], hops, h[row], s.take(pa.array(row)), a, b, h[at], s.take(pa.array(at))))
        return pa.concat_tables(made)

    return solve


def _balls_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_BALLS`` of rows (center, u, v, hops, h, s) that come center by center: atoms have no v."""
    for table in chunks(batches, "center", 1 << 16):
        (v, way), (hops, _), (h, _) = (longs(table.column(x)) for x in ("v", "hops", "h"))
        center, u, s = table.column("center").to_numpy(), table.column("u").to_numpy(), table.column("s").combine_chunks()
        rows = np.flatnonzero(~way)
        rows = rows[np.lexsort((u[rows], center[rows]))]
        names, g = np.unique(center[rows], return_inverse=True)
        nodes, of = np.unique(u[rows], return_inverse=True)
        keys, ways = g * len(nodes) + of, np.flatnonzero(way)
        a, b = (np.searchsorted(keys, np.searchsorted(names, center[ways]) * len(nodes) + np.searchsorted(nodes, x[ways])) for x in (u, v))
        yield from _numbered(names, g, u[rows], hops[rows], h[rows], s.take(pa.array(rows)), a, b, h[ways], s.take(pa.array(ways))).to_batches()


def evaluate_kinds(atoms: DataFrame, same: DataFrame, places: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``evaluate`` finds, once for each kind of region: it gets (region, atom, hops, place, the other columns of ``atoms``)
    of the regions that others are equal to."""
    kinds = materialize(same.where("center = region"), "kinds")
    picked = places.join(kinds, "center").select("region", "atom", "hops", "place")
    return materialize(evaluate(materialize(picked.join(atoms, "atom"), "picked")), "values")


def evaluate_once(atoms: DataFrame, same: DataFrame, places: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``evaluate`` finds for one region of each kind, written back to every region of that kind.

    ``evaluate`` gets (region, atom, hops, place, the other columns of ``atoms``) of the regions that others are equal to,
    and returns (region, place, more columns). The result has center, atom and those columns; places it leaves out have none.
    """
    kinds = materialize(same, "same")
    values = evaluate_kinds(atoms, kinds, places, evaluate)
    return places.join(kinds, "center").select("center", "region", "atom", "place").join(values, ["region", "place"]).drop("region", "place")
