"""Plug-ins by name: row steps, encoders and generators that callers provide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Registry:
    """Names and what they stand for; a name can be taken once."""

    kind: str
    found: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, value: Callable) -> Callable:
        if name in self.found:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.found[name] = value
        return value

    def unregister(self, name: str) -> None:
        self.found.pop(name, None)

    def get(self, name: str) -> Callable:
        if name not in self.found:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.found)}")
        return self.found[name]

    def after(self, name: str) -> str:
        """The name registered after ``name``, around the end."""
        names = list(self.found)
        return names[(names.index(name) + 1) % len(names)]


@dataclass(order=True)
class Step:
    """A row plug-in: a map (DataFrame to DataFrame) or a filter (DataFrame to boolean column), run by ascending priority if enabled."""

    priority: int
    kind: str = field(compare=False)
    step: Callable = field(compare=False)
    enabled: bool = field(default=True, compare=False)


def run(df: DataFrame, steps: list[Step]) -> DataFrame:
    from braidwork.operators.relational import chain

    return chain(df, [(s.priority, s.kind, s.step) for s in steps if s.enabled])


encoders = Registry("encoder")
generators = Registry("generator")
distances = Registry("distance")
groupings = Registry("grouping")


def register_defaults() -> None:
    """The library's own strategies; callers add theirs under other names."""
    from braidwork.functions import vectors
    from braidwork.operators import paths

    for name in ("cosine", "dot", "euclid"):
        if name not in distances.found:
            distances.register(name, getattr(vectors, name))
    if "clusters" not in groupings.found:
        groupings.register("clusters", paths.grouped_terms)


def between(df: DataFrame, a: str, b: str, name: str, out: str = "distance") -> DataFrame:
    """``df`` with the registered distance ``name`` of two columns of vectors."""
    register_defaults()
    from pyspark.sql import functions as F

    return df.withColumn(out, distances.get(name)(F.col(a), F.col(b)))
