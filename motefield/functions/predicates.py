"""Selectors and regions: boolean Columns that combine with &, | and ~."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_type(value, column: str = "type") -> Column:
    return F.col(column) == F.lit(value)


def by_element(symbol: str, column: str = "element") -> Column:
    return F.col(column) == F.lit(symbol)


def by_index(ids, column: str = "id") -> Column:
    return F.col(column).isin(list(ids))


def select_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in the table ``ids``: the form for long lists."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def coordinate_range(axis: str, low: float | None = None, high: float | None = None) -> Column:
    """Both ends belong to the range; None leaves an end open."""
    if low is not None and high is not None and low > high:
        raise ValueError("low exceeds high")
    found = F.col(axis).isNotNull()
    if low is not None:
        found = found & (F.col(axis) >= low)
    return found & (F.col(axis) <= high) if high is not None else found


def _squared(center) -> Column:
    return sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip("xyz", center, strict=True)), F.lit(0.0))


def within(center, high: float, low: float = 0.0) -> Column:
    """Distance from a point between ``low`` and ``high``, ends included; 0 means that point."""
    if high == 0:
        same = F.lit(True)
        for c, v in zip("xyz", center, strict=True):
            same = same & (F.col(c) == float(v))
        return same
    d = F.sqrt(_squared(center))
    return (d >= low) & (d <= high)


def cuboid(low, high) -> Column:
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside & F.col(c).between(float(a), float(b))
    return inside


def cube(origin, edge: float) -> Column:
    return cuboid(origin, tuple(o + edge for o in origin))


def sphere(center, radius: float) -> Column:
    return _squared(center) <= float(radius) ** 2


def hollow_sphere(center, inner: float, outer: float) -> Column:
    return (_squared(center) >= float(inner) ** 2) & (_squared(center) <= float(outer) ** 2)


def parallelepiped(box) -> Column:
    return box.contains(("x", "y", "z"))


def induced_edges(edges: DataFrame, nodes: DataFrame, ends=("atomi", "atomj"), column: str = "atom", keys=()) -> DataFrame:
    """Edges all of whose ends are among ``nodes``."""
    for end in ends:
        edges = edges.join(nodes.select(*keys, F.col(column).alias(end)).distinct(), [*keys, end], "left_semi")
    return edges
