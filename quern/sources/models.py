"""Registry of encoders: what a catalog's vectors were made with.

No weights come with this library.  An entry says how wide its vectors are and how to make
the function that embeds one content; ``register`` adds one, ``load`` returns it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quern.sources.catalog import Encoder, byte_histogram


@dataclass(frozen=True)
class Model:
    name: str
    width: int
    make: Callable[[], Encoder]
    text: bool = False


_models: dict[str, Model] = {}


def register(model: Model) -> None:
    _models[model.name] = model


def load(name: str) -> Model:
    if name not in _models:
        raise KeyError(f"no encoder named {name}; there are: {', '.join(sorted(_models))}")
    return _models[name]


register(Model("byte_histogram", 16, byte_histogram))
