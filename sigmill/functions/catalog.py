"""The catalog of the language's functions. Modules in sigmill.operators register their builders here.

An argument list is a string of letters: x a panel expression, d a whole number (a window or shift), f a number, g a label
field. `=` and a value after a letter make it optional. A builder gets the compiler's context and its arguments: columns
for x and g, Python numbers for d and f.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Argument:
    kind: str
    default: float | None = None
    optional: bool = False


@dataclass(frozen=True)
class Function:
    name: str
    category: str
    signature: str
    arguments: tuple[Argument, ...]
    doc: str
    build: Callable[..., Column]

    @property
    def least(self) -> int:
        return sum(not a.optional for a in self.arguments)


FUNCTIONS: dict[str, Function] = {}


def function(signature: str, category: str):
    """Registers a builder: @function("ts_mean(x, d)", "time_series")."""
    name, rest = signature.rstrip(")").split("(")
    arguments = []
    for part in filter(None, (p.strip() for p in rest.split(","))):
        kind, _, default = part.partition("=")
        arguments.append(Argument(kind, float(default) if default not in ("", "none") else None, "=" in part))

    def register(build):
        FUNCTIONS[name] = Function(name, category, signature, tuple(arguments), (build.__doc__ or "").strip(), build)
        return build

    return register


def catalog() -> list[dict]:
    """All functions, for display: name, category, signature, description."""
    load()
    return [{"name": f.name, "category": f.category, "signature": f.signature, "description": f.doc} for f in sorted(FUNCTIONS.values(), key=lambda f: (f.category, f.name))]


def load() -> dict[str, Function]:
    """Imports every module that registers functions."""
    from sigmill.operators import conditional, crosssection, elementwise, groups, timeseries  # noqa: F401

    return FUNCTIONS
