"""The layer graph: which layers a request needs, and custom layers as DataFrame functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class DependencyError(LookupError):
    """A layer that is asked for has no builder and wasn't supplied."""


@dataclass(frozen=True)
class Layer:
    id: str
    name: str
    depends: tuple[str, ...] = ()


LAYERS = (Layer("s", "source"), Layer("i", "image", ("s",)), Layer("r", "retina", ("i",)), Layer("s1", "S1", ("r",)), Layer("c1", "C1", ("s1",)), Layer("s2", "S2", ("c1",)), Layer("c2", "C2", ("s2",)))


def from_id(id: str) -> Layer:
    for layer in LAYERS:
        if layer.id == id:
            return layer
    raise LookupError(f"no layer {id}")


def from_name(name: str) -> Layer:
    for layer in LAYERS:
        if layer.name.lower() == name.lower():
            return layer
    raise LookupError(f"no layer {name}")


def is_below(a: Layer, b: Layer) -> bool:
    """Whether b needs a, directly or not."""
    return any(d == a.id or is_below(a, from_id(d)) for d in b.depends)


def top() -> Layer:
    return next(x for x in LAYERS if not any(x.id in y.depends for y in LAYERS))


@dataclass
class Graph:
    """Builders by layer; build() calls those that a request needs, each once, and leaves the work to Spark's laziness."""

    builders: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = field(default_factory=dict)

    def register(self, name: str, depends: tuple[str, ...], build: Callable[..., DataFrame]) -> None:
        if len(inspect.signature(build).parameters) != len(depends):
            raise TypeError(f"the builder of {name} must take {len(depends)} arguments")
        self.builders[name] = (tuple(depends), build)

    def build(self, wanted: str | list[str], state: dict[str, DataFrame], save_all: bool = True) -> dict[str, DataFrame]:
        """state with the wanted layers; any layer may be supplied. Without save_all, only they and the source."""
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        have = dict(state)

        def make(name: str) -> DataFrame:
            if name not in have:
                if name not in self.builders:
                    raise DependencyError(name)
                depends, build = self.builders[name]
                have[name] = build(*(make(d) for d in depends))
            return have[name]

        for name in names:
            make(name)
        return have if save_all else {k: v for k, v in have.items() if k in names or k == "s"}
