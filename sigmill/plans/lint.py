"""Checks of a folded tree before it is compiled: windows and shifts, and so looks into the future."""

from __future__ import annotations

from dataclasses import dataclass

from sigmill.functions.catalog import load

from .syntax import Call, Node, Number, walk

LONGEST_WINDOW = 504  # two years of trading days
SHIFTS = ("delay", "delta", "ts_returns")


@dataclass(frozen=True)
class Finding:
    severity: str
    function: str
    message: str


def lint(tree: Node) -> list[Finding]:
    """All findings, in the order of the tree."""
    out = []
    functions = load()
    for node in walk(tree):
        if not isinstance(node, Call) or node.name not in functions:
            continue
        spec = functions[node.name]
        if len(node.args) < spec.least:
            out.append(Finding("error", node.name, f"{spec.signature} lacks an argument"))
            continue
        if spec.category != "time_series" and node.name != "adv":
            continue
        for argument, given in zip(spec.arguments, node.args):
            if argument.kind != "d":
                continue
            if not isinstance(given, Number):
                out.append(Finding("error", node.name, f"{node.name} needs a constant number of rows"))
            elif node.name in SHIFTS:
                if given.value < 0:
                    out.append(Finding("error", node.name, f"{node.name} by {given.value} rows looks into the future"))
                elif given.value == 0:
                    out.append(Finding("warning", node.name, f"{node.name} by 0 rows does nothing"))
            elif given.value <= 0:
                out.append(Finding("error", node.name, f"{node.name} over {given.value} rows"))
            elif given.value > LONGEST_WINDOW:
                out.append(Finding("warning", node.name, f"{node.name} over {given.value} rows, more than {LONGEST_WINDOW}"))
    return out


def errors(tree: Node) -> list[str]:
    return [f.message for f in lint(tree) if f.severity == "error"]
