"""Compiles formulas to staged columns of one panel DataFrame.

The panel has one row per (date, ticker) of a dense calendar. A function over a window needs its argument as a plain
column, as Spark has no nested windows: the compiler then adds a stage, a column with the argument. Equal subtrees are
compiled once. Stages wait until the frame is needed and are then laid out together: all that can be computed over
tickers' histories, then all that can be over dates' cross-sections, and so on. So any number of formulas costs as many
shuffles as the deepest nesting of changes between the two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sigmill.functions import fields as field_registry
from sigmill.functions.catalog import Function, load
from sigmill.operators.elementwise import no_nan

from .syntax import Binary, Call, ExpressionError, Field, Negate, Node, Number, fold, parse

KEYS = ("date", "ticker", "ticker_ord")


@dataclass(frozen=True)
class Value:
    """A compiled subtree: a number or a column, and what it is: number, panel or label."""

    kind: str
    column: Column | None = None
    number: float | int | None = None


_STAGE = re.compile(r"\b_s[0-9]+\b")
_PARTITION = re.compile(r"PARTITION BY (.*?)(?: ORDER BY| ROWS| RANGE|\))")


def laid_out(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """df with the stages (name, column), each after those that it names; those over one partitioning together where they can be."""
    text = {name: str(column) for name, column in stages}
    names = list(text)
    needs = {n: set(names[:k]) if "more fields" in text[n] else set(_STAGE.findall(text[n])) & set(names) for k, n in enumerate(names)}

    def kind(name: str) -> str:
        by = [part for found in _PARTITION.findall(text[name]) for part in found.split(", ")]
        return "history" if "ticker" in by else "across" if by else "row"

    kinds, columns, done, current = {n: kind(n) for n in names}, dict(stages), set(), "row"
    while len(done) < len(names):
        ready = [n for n in names if n not in done and needs[n] <= done]
        now = [n for n in ready if kinds[n] == "row"] or [n for n in ready if kinds[n] == current]
        if not now:
            current = max(("history", "across"), key=lambda k: sum(kinds[n] == k for n in ready))
            continue
        df = df.withColumns({n: columns[n] for n in now})
        done.update(now)
    return df


class Context:
    """What builders use: windows, stages, fields. segments: columns that separate independent runs over one panel."""

    START = Window.unboundedPreceding

    def __init__(self, panel: DataFrame, segments: tuple[str, ...] = ()):
        self.segments, self.pending = segments, []
        self.df = panel
        self.functions: dict[str, Function] = load()
        self.staged = 0
        self.fields: dict[str, Column] = {}
        self.memo: dict[Node, Value] = {}

    # the frame
    @property
    def df(self) -> DataFrame:
        """The panel with all stages so far."""
        waiting, self.pending = self.pending, []
        if waiting:
            self._df = laid_out(self._df, waiting)
        return self._df

    @df.setter
    def df(self, value: DataFrame) -> None:
        self._df, self._types = value, dict(value.dtypes)

    # windows
    def history(self, *more: Column) -> WindowSpec:
        return Window.partitionBy(*self.segments, "ticker", *more).orderBy("date")

    def rows(self, d: int) -> WindowSpec:
        if d < 1:
            raise ExpressionError(f"a window of {d} rows")
        return self.history().rowsBetween(-(d - 1), 0)

    def across(self, *more: Column) -> WindowSpec:
        return Window.partitionBy(*self.segments, "date", *more)

    def order(self) -> Column:
        return F.col("ticker_ord")

    # columns
    def full(self, x: Column, d: int, value: Column) -> Column:
        """value where all d rows of the window have a value."""
        return F.when(F.count(x).over(self.rows(d)) == d, value)

    def nothing(self, x: Column) -> Column:
        return F.when(F.lit(False), x)

    def settle(self, column: Column) -> Column:
        """The column as a stage of its own."""
        name = f"_s{self.staged}"
        self.staged += 1
        self.pending.append((name, column))
        return F.col(name)

    def field(self, name: str) -> Column:
        """A field of the panel, or one derived from its fields, staged at its first use."""
        if name not in self.fields:
            if name in self._types:
                column = F.col(name)
                self.fields[name] = column if self._types[name] == "string" else column.cast("double")
            else:
                definition = field_registry.FIELDS.get(name)
                if definition is None or definition.build is None:
                    raise ExpressionError(f"field {name!r} is not loaded")
                self.fields[name] = self.settle(definition.build(self))
        return self.fields[name]

    def fold_history(self, x: Column, threshold: float) -> Column:
        """The recurrence of hump(): rows stream by in the order of ticker and date, and only the last value given out is carried, whatever a history's length."""
        at, name = f"_s{self.staged}", f"_s{self.staged + 1}"
        self.settle(x)
        self.staged += 1
        by = [*self.segments, "ticker"]
        rows = self.df.repartition(*by).sortWithinPartitions(*by, "date")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, last = None, None
            for batch in batches:
                out = []
                for *key, v in zip(*(batch.column(c).to_pylist() for c in (*by, at))):
                    if key != of:
                        of, last = key, None
                    if v is not None and (last is None or abs(v - last) > threshold):
                        last = v
                    out.append(last)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self.df = rows.mapInArrow(run, f"{schema}, `{name}` double")
        return F.col(name)

    # trees
    def value(self, node: Node) -> Value:
        if node not in self.memo:
            self.memo[node] = self.compute(node)
        return self.memo[node]

    def compute(self, node: Node) -> Value:
        if isinstance(node, Number):
            return Value("number", number=node.value)
        if isinstance(node, Field):
            column = self.field(node.name)
            label = node.name in field_registry.LABELS
            return Value("label" if label else "panel", column)
        if isinstance(node, Negate):
            return Value("panel", -self.panel(node.operand, "-"))
        if isinstance(node, Binary):
            a, b = self.panel(node.left, node.sign), self.panel(node.right, node.sign)
            out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[node.sign]()
            return Value("panel", self.stage(out))
        return self.call(node)

    def panel(self, node: Node, where: str) -> Column:
        value = self.value(node)
        if value.kind == "label":
            raise ExpressionError(f"{where} takes numbers, not a label")
        return F.lit(float(value.number)) if value.kind == "number" else value.column

    def stage(self, column: Column) -> Column:
        return self.settle(column)

    def call(self, node: Call) -> Value:
        spec = self.functions.get(node.name)
        if spec is None:
            raise ExpressionError(f"unknown function {node.name!r}")
        if not spec.least <= len(node.args) <= len(spec.arguments):
            raise ExpressionError(f"{spec.signature} does not take {len(node.args)} arguments")
        args = []
        for k, argument in enumerate(spec.arguments):
            given = node.args[k] if k < len(node.args) else None
            if given is None:
                default = argument.default
                args.append(int(default) if argument.kind == "d" and default is not None else default)
            elif argument.kind == "x":
                args.append(self.panel(given, node.name))
            elif argument.kind == "g":
                value = self.value(given)
                if value.kind != "label":
                    raise ExpressionError(f"{node.name} groups by a label field")
                args.append(value.column)
            else:
                value = self.value(given)
                if value.kind != "number":
                    raise ExpressionError(f"{node.name} takes a number as argument {k + 1}")
                if argument.kind == "d" and int(value.number) != value.number:
                    raise ExpressionError(f"{node.name} takes a whole number as argument {k + 1}")
                args.append(int(value.number) if argument.kind == "d" else value.number)
        return Value("panel", self.stage(spec.build(self, *args)))


def evaluate(panel: DataFrame, *formulas: str | Node, segments: tuple[str, ...] = (), keep: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    """(segments, date, ticker, ticker_ord, kept columns, one column for each formula: value, or value_0, value_1, ...)."""
    context = Context(panel, segments)
    out = []
    names = names or (["value"] if len(formulas) == 1 else [f"value_{k}" for k in range(len(formulas))])
    for formula, name in zip(formulas, names):
        tree = fold(parse(formula, set(field_registry.names()) | set(panel.columns))) if isinstance(formula, str) else fold(formula)
        value = context.value(tree)
        if value.kind != "panel":
            raise ExpressionError("a formula must give a value for each date and ticker")
        out.append(no_nan(value.column.cast("double")).alias(name))
    return context.df.select(*segments, *KEYS, *keep, *out)


def check(formula: str) -> Node:
    """The folded tree of a formula that parses, passes the linter and compiles, without running anything."""
    from .lint import errors

    tree = fold(parse(formula, set(field_registry.names())))
    if found := errors(tree):
        raise ExpressionError("; ".join(found))
    _type_check(tree)
    return tree


def _type_check(node: Node) -> str:
    """The kind of a tree, by the catalog alone."""
    functions = load()
    if isinstance(node, Number):
        return "number"
    if isinstance(node, Field):
        return "label" if node.name in field_registry.LABELS else "panel"
    if isinstance(node, Negate):
        if _type_check(node.operand) == "label":
            raise ExpressionError("- takes numbers, not a label")
        return "panel"
    if isinstance(node, Binary):
        if "label" in (_type_check(node.left), _type_check(node.right)):
            raise ExpressionError(f"{node.sign} takes numbers, not a label")
        return "panel"
    spec = functions.get(node.name)
    if spec is None:
        raise ExpressionError(f"unknown function {node.name!r}")
    if not spec.least <= len(node.args) <= len(spec.arguments):
        raise ExpressionError(f"{spec.signature} does not take {len(node.args)} arguments")
    for argument, given in zip(spec.arguments, node.args):
        kind = _type_check(given)
        wanted = {"x": ("number", "panel"), "g": ("label",)}.get(argument.kind, ("number",))
        if kind not in wanted:
            raise ExpressionError(f"{node.name} takes {' or '.join(wanted)}, not {kind}")
    return "panel"
