"""Labelled patterns in a topology graph: matches, choices among them, and edits by them.

A pattern is a few named nodes and edges with conditions on atoms and bonds. Its matches are a
chain of equi-joins over the bonds, in an order chosen by how many atoms each node allows; bonds
carry one bit per node and edge that they can stand for, so a step is a filter and a join. A bond
that closes a cycle is a semi-join. Matches that only differ by a symmetry of the pattern are one
match: for each orbit its first node has the least atom. Only the pattern is looked at on the driver.

A choice of matches that share no atom takes, in rounds, each match that is the first at all its
atoms. That is what going through all matches in their order one by one would take, whichever way rows are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.operators.parts import by_parts, longs, whole_numbers
from motefield.storage import forget, materialize


@dataclass(frozen=True)
class Pattern:
    """``nodes``: names with an SQL condition on the columns of atoms, or None for any atom.
    ``edges``: (node, node) or (node, node, SQL condition on the columns of bonds). It must be connected."""

    nodes: dict[str, str | None]
    edges: list[tuple] = field(default_factory=list)

    def conditions(self) -> dict[frozenset, str | None]:
        return {frozenset(e[:2]): (e[2] if len(e) > 2 else None) for e in self.edges}

    def symmetries(self) -> list[dict[str, str]]:
        """Every renaming of nodes that leaves conditions and edges as they are."""
        names, links = list(self.nodes), self.conditions()
        found: list[dict[str, str]] = []

        def extend(image: dict[str, str]) -> None:
            if len(image) == len(names):
                found.append(image)
                return
            node = names[len(image)]
            for other in names:
                if other in image.values() or self.nodes[other] != self.nodes[node]:
                    continue
                pairs = ((frozenset((node, a)), frozenset((other, b))) for a, b in image.items())
                if all((e in links) == (g in links) and links.get(e) == links.get(g) for e, g in pairs):
                    extend(image | {node: other})

        extend({})
        return found

    def least_first(self) -> list[tuple[str, str]]:
        """Pairs of nodes whose first has the smaller atom, so that one match of each symmetric set is left."""
        group, order = self.symmetries(), []
        for node in self.nodes:
            orbit = {s[node] for s in group} - {node}
            order += [(node, other) for other in self.nodes if other in orbit]
            group = [s for s in group if s[node] == node]
        return order


def _bits(conditions: list[str | None]) -> Column:
    """One bit for each condition that holds."""
    parts = [F.when(F.expr(c) if c else F.lit(True), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(conditions)]
    return reduce(Column.bitwiseOR, parts)


def _has(bits: str, at: int) -> Column:
    return F.col(bits).bitwiseAND(F.lit(1 << at)) != 0


def join_order(pattern: Pattern, counts: dict[str, int]) -> list[str]:
    """Nodes from the rarest on, each next to one before it, the rarest of those first."""
    links = [tuple(e[:2]) for e in pattern.edges]
    near = {n: {b if a == n else a for a, b in links if n in (a, b)} for n in pattern.nodes}
    order = [min(pattern.nodes, key=lambda n: counts[n])]
    while len(order) < len(pattern.nodes):
        # a node that closes a cycle narrows the matches, so more neighbours come first
        reach = [n for n in pattern.nodes if n not in order and near[n] & set(order)]
        if not reach:
            raise ValueError("the pattern is not connected")
        order.append(min(reach, key=lambda n: (-len(near[n] & set(order)), counts[n])))
    return order


def find_matches(atoms: DataFrame, bonds: DataFrame, pattern: Pattern, once: bool = True) -> DataFrame:
    """A row per match, a column per node of the pattern with its atom; no atom twice in a match.

    ``once``: one of the matches that differ by a symmetry of the pattern, else all of them. A
    condition that is null does not hold; loops and bonds to atoms that are not listed match
    nothing; parallel bonds are one bond that meets what any of them meets.
    """
    names = list(pattern.nodes)
    if not 0 < len(names) < 63 or len(pattern.edges) > 62 or any(set(e[:2]) - set(names) or e[0] == e[1] for e in pattern.edges):
        raise ValueError("a pattern has 1 to 62 nodes and edges between two of them")
    links = pattern.conditions()
    allowed = materialize(atoms.where("atom is not null").select("atom", _bits(list(pattern.nodes.values())).alias("m")).where("m <> 0").groupBy("atom").agg(F.bit_or("m").alias("m")), "allowed")
    row = allowed.agg(*(F.count_if(_has("m", i)).alias(n) for i, n in enumerate(names))).first()
    order = join_order(pattern, row.asDict())
    before = pattern.least_first() if once else []

    def ordered(known: list[str], new: str) -> Column:
        tests = [F.col(n) != F.col(new) for n in known]
        tests += [F.col(a) < F.col(b) for a, b in before if new in (a, b) and {a, b} <= {*known, new}]
        return reduce(Column.__and__, tests, F.lit(True))

    first = names.index(order[0])
    found = allowed.where(_has("m", first)).select(F.col("atom").alias(order[0]))
    if len(order) == 1:
        return found
    ends = bonds.select(F.least("atomi", "atomj").alias("a"), F.greatest("atomi", "atomj").alias("b"), _bits(list(links.values())).alias("me")).where("a < b and me <> 0").groupBy("a", "b").agg(F.bit_or("me").alias("me"))
    ends = ends.join(allowed.select(F.col("atom").alias("a"), F.col("m").alias("ma")), "a").join(allowed.select(F.col("atom").alias("b"), F.col("m").alias("mb")), "b")
    # only bonds that can stand for an edge of the pattern, either way
    ends = ends.where(reduce(Column.__or__, [_has("me", i) & _has(x, names.index(u)) & _has(y, names.index(v)) for i, (u, v) in enumerate(map(tuple, links)) for x, y in (("ma", "mb"), ("mb", "ma"))]))
    turned = ends.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("mb").alias("ma"), F.col("ma").alias("mb"), "me")
    # written: a join of matches with bonds then shuffles plain rows, and an atom of very many bonds is split
    ways = materialize(ends.select("a", "b", "ma", "mb", "me").union(turned), "ways")
    numbers = {e: i for i, e in enumerate(links)}

    def way(a: str, b: str) -> DataFrame:
        return ways.where(_has("ma", names.index(a)) & _has("mb", names.index(b)) & _has("me", numbers[frozenset((a, b))])).select(F.col("a").alias(a), F.col("b").alias(b))

    for at in range(1, len(order)):
        known, new = order[:at], order[at]
        near = [n for n in known if frozenset((n, new)) in links]
        found = way(known[0], new) if at == 1 else found.join(way(near[0], new), near[0])
        found = found.where(ordered(known, new))
        for other in near[1:]:
            found = found.join(way(other, new), [other, new], "left_semi")
    return found.select(*names)


def disjoint_matches(matches: DataFrame, nodes: list[str] | None = None, priority: Column | None = None, seed: int = 0) -> DataFrame:
    """Matches of which no two share an atom, none of the rest fits in: those that greedy choice in
    the order of ``priority`` (then of the matches' atoms) takes. Without it the order is a hash of ``seed`` and the atoms.

    ``nodes``: the columns with atoms, all by default. Repeated rows are one; other columns stay. Each
    round decides the first match at least, and with a random order all but a fixed share, so rounds grow with the logarithm. Sets
    of matches that share up to ``MATCH_PART`` atoms are gone through in one task; rounds are for larger ones.
    """
    nodes = nodes or matches.columns
    first = F.xxhash64(F.lit(seed), *nodes) if priority is None else priority
    order = F.struct(first.alias("p"), *(F.col(n).alias(f"n{i}") for i, n in enumerate(nodes)))

    def by_rounds(rows: DataFrame) -> DataFrame:
        return _choose(rows.dropDuplicates(nodes).withColumn("_order", order), [F.array_distinct(F.array(*nodes))], None).drop("_order")

    more = [c for c in matches.columns if c not in nodes]
    given = materialize((matches.dropDuplicates(nodes) if more else matches).withColumn("_p", first), "matches")
    if not whole_numbers(given, "_p", *nodes) or not given.where(" or ".join(f"`{n}` is null" for n in nodes)).isEmpty():
        return by_rounds(given.drop("_p"))
    # a match is dealt to each of its atoms, so what share atoms meet in one task
    row = given.select(*(F.col(n).cast("long").alias(f"n{i}") for i, n in enumerate(nodes)), F.col("_p").cast("long").alias("p"))
    names = row.columns[:-1]
    found, large = by_parts(row.withColumn("u", F.explode(F.array_distinct(F.array(*names)))), names, _first_come, ", ".join(f"{n} long" for n in names), MATCH_PART)
    kinds = [(F.col(n).cast(given.schema[m].dataType).alias(m)) for n, m in zip(names, nodes, strict=True)]
    found = found.select(*kinds)
    rows = given.drop("_p")
    if large is not None:
        many = materialize(large.where("u = n0").select(*kinds).distinct(), "large")
        found = found.union(by_rounds(rows.join(many, nodes, "left_semi").select(rows.columns)).select(nodes))
    return (rows.join(found, nodes, "left_semi") if more else found).select(matches.columns)


#: Atoms of a set of matches that hang together, up to which it is one task's.
MATCH_PART = 1 << 14


def _first_come(table: pa.Table, part: np.ndarray) -> pa.Table:
    """The matches (n0, n1, ...) that a choice one by one in the order of (p, n0, n1, ...) takes."""
    names = [c for c in table.column_names if c not in ("u", "p")]
    nodes = [table.column(n).to_numpy() for n in names]
    p, given = longs(table.column("p"))
    rows = np.stack(nodes, axis=1)[np.lexsort((*nodes[::-1], p, given))]
    rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)]]
    used: set[int] = set()
    taken = []
    for at, atoms in enumerate(rows.tolist()):
        if used.isdisjoint(atoms):
            used.update(atoms)
            taken.append(at)
    return pa.table({n: rows[taken, k] if taken else np.zeros(0, np.int64) for k, n in enumerate(names)})


def limited_pairs(pairs: DataFrame, limit: int | None = None, by: tuple[str, ...] = (), conversion: float = 1.0, seed: int = 0, priority: Column | None = None) -> DataFrame:
    """Pairs of sites (``i``, ``j``) chosen at random: no site twice and, with ``limit``, at most so many
    pairs at each molecule (``mol_i``, ``mol_j``; a pair within one molecule counts once there).

    The choice is greedy in the order of ``priority``, a hash of ``seed`` and the pair by default, within
    each group of the columns ``by``; it is the same for any dealing of rows. Of the pairs chosen the first
    ceil(conversion x the smaller number of different sites on a side) stay, in a group each.
    """
    if not 0 <= conversion <= 1:
        raise ValueError(f"conversion must be in [0, 1], got {conversion}")
    keys = [*by, "i", "j"]
    order = F.struct((F.xxhash64(F.lit(seed), *keys) if priority is None else priority).alias("p"), *(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)))
    rows = pairs.dropDuplicates(keys).withColumn("_order", order)
    group = [F.col(c) for c in by]
    sites = F.array(F.struct(*group, F.lit(0).alias("_s"), F.col("i").cast("string").alias("_a")), F.struct(*group, F.lit(1).alias("_s"), F.col("j").cast("string").alias("_a")))
    kinds = None
    if limit is not None:
        kinds = (F.array_distinct(F.array(F.struct(*group, F.col("mol_i").alias("_m")), F.struct(*group, F.col("mol_j").alias("_m")))), limit)
    chosen = _choose(rows, [sites], kinds)
    if conversion < 1:
        most = pairs.groupBy(*by).agg(F.ceil(F.lit(conversion) * F.least(F.countDistinct("i"), F.countDistinct("j"))).alias("_most"))
        chosen = _first_in_order(chosen, list(by), materialize(most, "most"))
    return chosen.drop("_order")


def _choose(rows: DataFrame, unique: list[Column], limited: tuple[Column, int] | None) -> DataFrame:
    """Greedy choice in the order of ``_order`` by rounds: rows whose ``unique`` items nothing chosen has,
    and whose ``limited`` items fewer than the limit have."""
    live = materialize(rows.withColumn("_items", F.concat(*unique)).withColumn("_kinds", limited[0] if limited else F.lit(None).cast("array<int>")), "live")
    first, held = live, []
    chosen: DataFrame | None = None
    while not live.isEmpty():
        used = live.select("_order", F.explode("_items").alias("_item"))
        least = materialize(used.groupBy("_item").agg(F.min("_order").alias("_least")), "least")
        # a row waits while some item or kind of it has earlier rows
        waits = used.join(least, "_item").where("_order <> _least").select("_order")
        if limited:
            kind = live.select("_order", F.explode("_kinds").alias("_kind"))
            taken = chosen.select(F.explode("_kinds").alias("_kind")).groupBy("_kind").agg(F.count("*").alias("_taken")) if chosen is not None else None
            # at most ``limit`` rows a kind can be taken at once, so only they are ranked together
            ranked = kind.withColumn("_rank", F.row_number().over(Window.partitionBy("_kind").orderBy("_order"))).where(F.col("_rank") <= limited[1])
            room = ranked.join(materialize(taken, "taken"), "_kind", "left").where(F.col("_rank") + F.coalesce("_taken", F.lit(0)) <= limited[1]) if taken is not None else ranked
            within = materialize(room.groupBy("_order").agg(F.count("*").alias("_n")), "room")
            waits = waits.union(live.join(within, "_order", "left").where(F.coalesce("_n", F.lit(0)) < F.size("_kinds")).select("_order"))
        now = materialize(live.join(materialize(waits.distinct(), "waits"), "_order", "left_anti"), "chosen")
        chosen = now if chosen is None else chosen.union(now)
        gone = materialize(now.select(F.explode("_items").alias("_item")), "gone")
        out = used.join(gone, "_item", "left_semi").select("_order")
        if limited:
            full = materialize(chosen.select(F.explode("_kinds").alias("_kind")).groupBy("_kind").agg(F.count("*").alias("_taken")).where(F.col("_taken") >= limited[1]), "full")
            out = out.union(kind.join(full, "_kind", "left_semi").select("_order"))
        rest = materialize(live.join(materialize(out.distinct(), "out"), "_order", "left_anti").join(now, "_order", "left_anti"), "live")
        for old in held:
            forget(old)
        held, live = [live, least], rest
    return (first if chosen is None else chosen).drop("_items", "_kinds")


def _first_in_order(rows: DataFrame, by: list[str], most: DataFrame) -> DataFrame:
    """The first ``_most`` rows of each group in the order of ``_order``.

    Rows are dealt by ranges of (group, order) and counted by range; a row's number is its place in its range
    and the counts before it, so no group is sorted in one task.
    """
    dealt = materialize(rows.repartitionByRange(*by, "_order").withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_order")))
    placed = placed.join(materialize(shift.drop("_size"), "shift"), [*by, "_part"])
    numbered = placed.join(most, by) if by else placed.withColumn("_most", F.lit(most.first()["_most"]))
    return numbered.where(F.col("_place") + F.col("_before") <= F.col("_most")).select(rows.columns)


def rewrite(
    atoms: DataFrame, bonds: DataFrame, matches: DataFrame, *, delete: tuple[str, ...] = (), form: tuple[tuple, ...] = (), cut: tuple[tuple[str, str], ...] = (),
    assign: dict[str, dict[str, str]] | None = None, fold: dict[str, str] | None = None, conserve: tuple[str, ...] = (), tolerance: float = 1e-9,
) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) after one edit at every match, all at once.

    ``delete``: nodes whose atoms go, with all their bonds. ``form``: (node, node, {column: SQL on the two
    atoms' columns as ``a`` and ``b``}) bonds that come; one that is there already stays as it is. ``cut``: pairs
    of nodes whose bond goes. ``assign``: by node, columns and the SQL of their new values. ``fold``: columns whose
    values at deleted atoms are added to a node of the same match. ``conserve``: columns whose sum over all atoms
    must not change by more than ``tolerance``, else a ValueError.

    Matches must share no atom, else a ValueError names one (``disjoint_matches`` gives such matches). No matches change nothing.
    """
    nodes = matches.columns
    if named := {n for u, v, *_ in form for n in (u, v)} & set(delete):
        raise ValueError(f"a bond is formed at a node that goes: {sorted(named)}")
    matches = materialize(matches, "matches")
    long = materialize(matches.select(F.monotonically_increasing_id().alias("_m"), *nodes).select("_m", F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.col(n).alias("atom")) for n in nodes))).alias("e")).select("_m", "e.*"), "edited")
    twice = long.groupBy("atom").agg(F.count("*").alias("n")).where("n > 1").select("atom").first()
    if twice:
        raise ValueError(f"two matches name atom {twice['atom']}")
    gone = long.where(F.col("node").isin(*delete)).select("_m", "atom") if delete else long.limit(0).select("_m", "atom")
    after = atoms
    for column, node in (fold or {}).items():
        # what a match deletes goes to its node; the rows touched are as many as the matches
        extra = gone.join(atoms.select("atom", F.col(column).alias("_v")), "atom").groupBy("_m").agg(F.sum("_v").alias("_v"))
        to = long.where(F.col("node") == node).join(extra, "_m").select("atom", "_v")
        after = after.join(materialize(to, "fold"), "atom", "left").withColumn(column, F.when(F.col("_v").isNull(), F.col(column)).otherwise(F.coalesce(column, F.lit(0)) + F.col("_v")).cast(atoms.schema[column].dataType)).drop("_v")
    if assign:
        named = materialize(long.where(F.col("node").isin(*assign)).select("atom", F.col("node").alias("_node")), "assign")
        after = after.join(named, "atom", "left")
        columns = {c for new in assign.values() for c in new}
        values = {}
        for c in columns:
            value = F.col(c)
            for node, new in assign.items():
                if c in new:
                    value = F.when(F.col("_node") == node, F.expr(new[c])).otherwise(value)
            values[c] = value.cast(atoms.schema[c].dataType) if c in atoms.columns else value
        after = after.withColumns(values).drop("_node")
    removed = materialize(gone.select("atom"), "removed")
    after = after.join(removed, "atom", "left_anti").select(*atoms.columns, *(c for c in after.columns if c not in atoms.columns))
    left = bonds
    for end in ("atomi", "atomj"):
        left = left.join(removed.select(F.col("atom").alias(end)), end, "left_anti")
    pair = [F.least("atomi", "atomj").alias("_a"), F.greatest("atomi", "atomj").alias("_b")]
    if cut:
        ends = reduce(DataFrame.union, [matches.select(F.least(u, v).alias("_a"), F.greatest(u, v).alias("_b")) for u, v in cut])
        left = left.select("*", *pair).join(materialize(ends, "cut"), ["_a", "_b"], "left_anti").drop("_a", "_b")
    left = left.select(*bonds.columns)
    for u, v, *more in form:
        new = matches.select(F.least(u, v).alias("atomi"), F.greatest(u, v).alias("atomj"))
        for end, prefix in (("atomi", "a"), ("atomj", "b")):
            if more:
                new = new.join(atoms.select(F.struct("*").alias(prefix)), F.col(end) == F.col(f"{prefix}.atom"))
        new = new.select("atomi", "atomj", *(F.expr(sql).cast(bonds.schema[c].dataType).alias(c) for c, sql in (more[0] if more else {}).items()))
        there = materialize(left.select(*pair).distinct(), "there")
        left = left.unionByName(new.join(there.toDF("atomi", "atomj"), ["atomi", "atomj"], "left_anti"), allowMissingColumns=True)
    if conserve:
        before, now = (df.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in conserve)).first() for df in (atoms, after))
        for c in conserve:
            if abs(now[c] - before[c]) > tolerance:
                raise ValueError(f"the edit changes the sum of {c} by {now[c] - before[c]:+.6g}")
    return after, left
