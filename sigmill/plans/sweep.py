"""Parameter sweeps: `{a..b}` and `{a..b:step}` in a formula stand for each value from a to b."""

from __future__ import annotations

import re
from itertools import product

from .syntax import ExpressionError

MOST_CELLS = 50
_RANGE = re.compile(r"\{\s*(-?[0-9]*\.?[0-9]+)\s*\.\.\s*(-?[0-9]*\.?[0-9]+)\s*(?::\s*(-?[0-9]*\.?[0-9]+)\s*)?\}")


def values(start: str, end: str, step: str | None) -> list[float | int]:
    a, b, s = float(start), float(end), float(step or 1)
    if s <= 0:
        raise ExpressionError("the step of a sweep must be positive")
    if b < a:
        raise ExpressionError("the end of a sweep lies before its start")
    whole = all("." not in x for x in (start, end, step or "1"))
    steps = range(int((b - a) / s + 1e-9) + 1)
    return [int(a + k * s) if whole else round(a + k * s, 10) for k in steps]


def expand(formula: str, most: int = MOST_CELLS) -> list[tuple[dict[str, float | int], str]]:
    """(parameters p0, p1, ... and formula) of every cell, the last range running fastest."""
    ranges = [values(*m.groups()) for m in _RANGE.finditer(formula)]
    if not ranges:
        raise ExpressionError("the formula has no range to sweep")
    cells = 1
    for r in ranges:
        cells *= len(r)
    if cells > most:
        raise ExpressionError(f"{cells} cells, more than {most}")
    out = []
    for chosen in product(*ranges):
        rest = iter(chosen)
        out.append(({f"p{k}": v for k, v in enumerate(chosen)}, _RANGE.sub(lambda m: str(next(rest)), formula)))
    return out
