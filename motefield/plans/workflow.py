"""A graph of named steps on DataFrames, each a callable with its inputs bound by name.

Steps only build plans, so running a workflow starts no job by itself unless a step does.
"""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame


class Workflow:
    """``add`` names a step and says which steps or outside inputs its parameters are."""

    def __init__(self):
        self._steps: dict[str, tuple[Callable, dict[str, str]]] = {}

    def add(self, name: str, step: Callable, inputs: dict[str, str] | None = None) -> Workflow:
        """Raises ValueError for a name in use and for a cycle; the workflow is then as before.
        A source may be added later than what reads it."""
        if name in self._steps:
            raise ValueError(f"step {name!r} is there already")
        self._steps[name] = (step, dict(inputs or {}))
        try:
            self.order()
        except CycleError as cycle:
            del self._steps[name]
            raise ValueError(f"step {name!r} closes a cycle: {cycle.args[1]}") from None
        return self

    def sources(self, name: str) -> set[str]:
        """The steps that a step reads."""
        return {s for s in self._steps[name][1].values() if s in self._steps} if name in self._steps else set()

    def order(self) -> list[str]:
        return list(TopologicalSorter({name: self.sources(name) for name in self._steps}).static_order())

    def outside(self) -> set[str]:
        """Inputs that no step makes."""
        return {s for _, inputs in self._steps.values() for s in inputs.values()} - set(self._steps)

    def run(self, **given) -> dict[str, DataFrame]:
        """The result of each step; KeyError names inputs that are missing. A step that several
        read is built once, and caching it is the step's own choice."""
        if missing := self.outside() - set(given):
            raise KeyError(f"missing inputs: {sorted(missing)}")
        made: dict[str, DataFrame] = {}
        for name in self.order():
            step, inputs = self._steps[name]
            made[name] = step(**{k: made[s] if s in self._steps else given[s] for k, s in inputs.items()})
        return made
