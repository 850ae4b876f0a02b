"""Energy minimisation of many frames at once by limited-memory BFGS on DataFrames.

Positions, gradients and the history of steps are columns of one row for each atom. The
two-loop recursion needs nothing but dot products of these vectors: an aggregate by frame sums
them, the recursion runs on that row of numbers, and its weights go back to the atoms by a join.
A frame's atoms are never gathered, and frames move at their own pace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.storage import forget, materialize

XYZ = ("x", "y", "z")


def _dots(names: list[str]) -> list[Column]:
    return [F.sum(sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in XYZ), F.lit(0.0))).alias(f"{a}.{b}") for i, a in enumerate(names) for b in names[i:]]


def _weights(row: dict[str, float], memory: int) -> list[float]:
    """Weights of s1.., y1.., g whose sum is the step: the two loops on dot products. The pairs
    are from the newest to the oldest; one without positive curvature is passed over."""
    names = [f"_s{k}" for k in range(memory)] + [f"_y{k}" for k in range(memory)] + ["_g"]

    def dot(weights: list[float], name: str) -> float:
        return sum(w * (row.get(f"{n}.{name}", row.get(f"{name}.{n}")) or 0.0) for w, n in zip(weights, names, strict=True) if w)

    q, used = [0.0] * len(names), []
    q[-1] = 1.0
    for k in range(memory):
        curved = row.get(f"_s{k}._y{k}") or 0.0
        if curved > 1e-10:
            alpha = dot(q, f"_s{k}") / curved
            q[memory + k] -= alpha
            used.append((k, alpha, curved))
    if used:
        k = used[0][0]
        scale = row[f"_s{k}._y{k}"] / row[f"_y{k}._y{k}"]
        q = [w * scale for w in q]
    for k, alpha, curved in reversed(used):
        q[k] += alpha - dot(q, f"_y{k}") / curved
    return [-w for w in q]


def minimize(atoms: DataFrame, slope: Callable[[DataFrame], DataFrame], fmax: float = 0.05, steps: int = 100, memory: int = 5, longest: float = 0.04, every: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(frame, atom, x, y, z, fmax, steps): positions after at most ``steps`` steps of each frame,
    or when no force component is above ``fmax``. ``slope`` maps (frame, atom, x, y, z) to
    (frame, atom, gx, gy, gz), the gradient of the energy; atoms that it leaves out feel none.
    No atom moves farther than ``longest`` in a step. ``every`` sees each step's state."""
    names = [f"_s{k}" for k in range(memory)] + [f"_y{k}" for k in range(memory)] + ["_g"]

    def with_slope(state: DataFrame) -> DataFrame:
        g = slope(state.select("frame", "atom", *XYZ)).select("frame", "atom", *[F.col(f"g{c}").alias(f"_g{c}") for c in XYZ])
        return state.join(g, ["frame", "atom"], "left").fillna(0.0, [f"_g{c}" for c in XYZ])

    state = atoms.select("frame", "atom", *XYZ, *[F.lit(0.0).alias(f"_{k}{i}{c}") for k in "sy" for i in range(memory) for c in XYZ], F.lit(0).alias("steps"))
    state = materialize(with_slope(state), "minimum")
    rule = F.pandas_udf(lambda sums: sums.map(lambda v: _weights(dict(zip(keys, v, strict=True)), memory)), "array<double>")
    keys = [f"{a}.{b}" for i, a in enumerate(names) for b in names[i:]]
    size = F.sqrt(sum((F.col(f"_d{c}") ** 2 for c in XYZ), F.lit(0.0)))
    for step in range(steps):
        sums = state.groupBy("frame").agg(F.max(F.greatest(*[F.abs(f"_g{c}") for c in XYZ])).alias("fmax"), F.array(*_dots(names)).alias("_v"))
        moving = materialize(sums.where(F.col("fmax") > fmax).select("frame", rule("_v").alias("_w")), "weights")  # a row for each frame
        if moving.isEmpty():
            forget(moving)
            break
        held = state.join(moving, "frame", "left")
        d = {f"_d{c}": F.when(F.col("_w").isNull(), 0.0).otherwise(sum((F.col("_w")[k] * F.col(f"{n}{c}") for k, n in enumerate(names)), F.lit(0.0))) for c in XYZ}
        held = held.withColumns(d).withColumn("_size", size)
        # written, as the frame's sums are: a large frame is then dealt over several tasks
        most = materialize(held.groupBy("frame").agg(F.max("_size").alias("_most")), "most")
        held = held.join(most, "frame").withColumn("_k", F.least(F.lit(1.0), longest / F.greatest("_most", F.lit(1e-300))))
        still = F.col("_w").isNull()
        moved = held.select(
            "frame", "atom", *[(F.col(c) + F.col(f"_d{c}") * F.col("_k")).alias(c) for c in XYZ],
            *[F.when(still, F.col(f"_s{i}{c}")).otherwise(F.col(f"_d{c}") * F.col("_k") if i == 0 else F.col(f"_s{i - 1}{c}")).alias(f"_s{i}{c}") for i in range(memory) for c in XYZ],
            *[F.when(still, F.col(f"_y{i}{c}")).otherwise(F.lit(0.0) if i == 0 else F.col(f"_y{i - 1}{c}")).alias(f"_y{i}{c}") for i in range(memory) for c in XYZ],
            (F.col("steps") + (~still).cast("int")).alias("steps"), *[F.col(f"_g{c}").alias(f"_o{c}") for c in XYZ], still.alias("_still"),
        )
        fresh = with_slope(materialize(moved, "moved"))
        told = fresh.withColumns({f"_y0{c}": F.when(F.col("_still"), F.col(f"_y0{c}")).otherwise(F.col(f"_g{c}") - F.col(f"_o{c}")) for c in XYZ}).drop("_still", *[f"_o{c}" for c in XYZ])
        old, state = state, materialize(told.select(state.columns), "minimum")
        forget(old)
        forget(moving)
        forget(most)
        if every is not None:
            every(step + 1, state)
    last = materialize(state.groupBy("frame").agg(F.max(F.greatest(*[F.abs(f"_g{c}") for c in XYZ])).alias("fmax")), "most")
    return state.join(last, "frame").select("frame", "atom", *XYZ, "fmax", "steps")
