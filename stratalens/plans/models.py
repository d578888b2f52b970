"""Models by name: a model makes the graph of its layers from parameters, an S1 bank and prototypes.

A caller's own model is a function of that kind: it may start from another's graph and register builders of its own, for a
layer of a new name or in place of one there is. Any builder of tables of maps will do, so this is also the way to
another engine for some layer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..operators import packed
from ..params import Params
from .dag import Graph

Model = Callable[[Params, np.ndarray, list[np.ndarray] | None], Graph]
MODELS: dict[str, Model] = {"ml": packed.graph}


def register(name: str, model: Model) -> None:
    if name.lower() in MODELS:
        raise ValueError(f"there is a model {name}")
    MODELS[name.lower()] = model


def resolve(model: str | Model) -> Model:
    """A name, or a model as it is."""
    if callable(model):
        return model
    try:
        return MODELS[model.lower()]
    except KeyError:
        raise LookupError(f"no model {model}; there are {', '.join(sorted(MODELS))}") from None
