"""Work on the connected parts of a graph, many whole parts in one task.

Rows are dealt by ranges of their node first. A part all of whose nodes are in one chunk of a range is seen
whole there and is done at once, so where names of near nodes are near, one shuffle does nearly all. Parts that
cross chunks are named by ``connected_components`` and dealt by that name. A part of too many nodes is
no task's: its rows go back to the caller, who has steps of joins for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from motefield.operators.components import connected_components, joined
from motefield.storage import materialize

#: Rows that a task looks at together.
CHUNK = 1 << 18

#: (rows, the part of each) to what is found in those parts.
Solve = Callable[[pa.Table, np.ndarray], pa.Table]


def whole_numbers(rows: DataFrame, *names: str) -> bool:
    return {rows.schema[c].dataType.typeName() for c in names} <= {"byte", "short", "integer", "long"}


def longs(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are not null); a null's value is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch], key: str, chunk: int) -> Iterator[pa.Table]:
    """Tables of about ``chunk`` sorted rows that end where the key changes, unless all have one key."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= chunk:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) or n
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
            if cut < chunk // 2:
                break
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts(table: pa.Table, to: list[str], cut: int | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, whether it is seen whole) of each row. A node is seen whole if the chunk has its own rows, so a
    part is if that holds for all nodes which its rows name."""
    u = table.column("u").to_numpy()
    nodes, at = np.unique(u, return_inverse=True)
    open_ = np.zeros(len(nodes), bool)
    if cut is not None:
        open_ |= nodes == cut
    a, b = [], []
    for name in to:
        v, given = longs(table.column(name))
        there = np.minimum(np.searchsorted(nodes, v), len(nodes) - 1)
        own = given & (nodes[there] == v)
        open_[at[given & ~own]] = True
        a.append(at[own])
        b.append(there[own])
    label = joined(len(nodes), np.concatenate(a), np.concatenate(b))
    bad = np.bincount(label, minlength=len(nodes)) > most
    bad[label[open_]] = True
    return nodes[label][at], ~bad[label][at]


def by_parts(rows: DataFrame, to: list[str], solve: Solve, found: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(what ``solve`` finds in parts of up to ``most`` nodes, written; rows of larger parts with ``part``, or None).

    ``rows`` has a node ``u`` and in the columns ``to`` the nodes that it is joined with (null: none), all long, and more columns.
    Whatever joins two nodes must have a row at each of them. ``solve`` gets all rows of the parts it is called
    for, in no order and at times none, and returns rows of the schema ``found``. A part is named by its least node. ``rows`` is read
    more than once.
    """
    chunk, result = CHUNK, StructType.fromDDL(found)
    both = StructType([*result.fields, *rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns)).schema.fields])
    for field in both:
        field.nullable = True

    def filled(table: pa.Table, names: list[str], like: pa.Table) -> Iterator[pa.RecordBatch]:
        """As rows with all columns of ``like``, nulls in the others."""
        columns = dict(zip(names, table.columns, strict=True))
        full = {f.name: columns.get(f.name, pa.nulls(table.num_rows, f.type)) for f in like.schema}
        yield from pa.table(full).cast(like.schema).to_batches()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for table in chunks(batches, "u", chunk):
            if table.num_rows >= chunk and table.column("u")[0] == table.column("u")[-1]:
                cut = table.column("u")[0].as_py()  # its rows are in several chunks
            part, whole = _parts(table, to, cut, most)
            done = solve(table.filter(pa.array(whole)), part[whole])
            moved = [f"_{c}" for c in table.column_names]
            like = pa.schema([*done.schema, *(pa.field(c, f.type) for c, f in zip(moved, table.schema, strict=True))]).empty_table()
            yield from filled(done, done.column_names, like)
            yield from filled(table.filter(pa.array(~whole)), moved, like)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "part", chunk):
            yield from solve(table.drop_columns(["part"]), table.column("part").to_numpy()).to_batches()

    first = materialize(rows.repartitionByRange("u").sortWithinPartitions("u").mapInArrow(near, both), "near")
    done = first.where("_u is null").select(result.names)
    rest = first.where("_u is not null").select(*(F.col(f"_{c}").alias(c) for c in rows.columns))
    if rest.isEmpty():
        return done, None
    links = reduce(DataFrame.union, [rest.select("u", F.col(c).alias("v")) for c in to])
    part = materialize(connected_components(links, "u", "v").toDF("u", "part"), "parts")
    named = rest.join(part, "u", "left").withColumn("part", F.coalesce("part", "u"))
    many = materialize(part.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > most).select("part"), "many")
    if not many.isEmpty():
        named = materialize(named.join(many.withColumn("_many", F.lit(True)), "part", "left"), "named")
        large, named = named.where("_many").drop("_many"), named.where("_many is null").drop("_many")
    else:
        large = None
    second = named.repartition("part").sortWithinPartitions("part").mapInArrow(dealt, result)
    return done.union(materialize(second, "far")), large
