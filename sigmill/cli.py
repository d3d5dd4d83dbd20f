"""Command line: python -m sigmill.cli COMMAND --ohlcv FILE [--securities FILE] ...

run FORMULA, shuffle FORMULA, optimize FORMULA, compare FORMULA..., stress FORMULA, list, verify ID, export ID.
Exit codes: verify 0 same, 1 different result, 2 unknown id; unknown universe 2; shuffle 0 only for a real signal; stress 1 if a regime's
Sharpe ratio is below -0.5; optimize 0 if the best cell reaches --min-sharpe; compare 1 if a formula fails.
"""

from __future__ import annotations

import argparse
import json
import sys

from sigmill.api import Workspace
from sigmill.plans import batch
from sigmill.plans.portfolio import NEUTRALIZATIONS, Settings
from sigmill.plans.syntax import ExpressionError
from sigmill.sources import fundamentals, macro, panel, universe
from sigmill.sources.store import Store


COMMANDS = (("run", "formula", None), ("shuffle", "formula", None), ("optimize", "formula", None), ("compare", "formula", "+"), ("stress", "formula", None), ("list", None, None), ("verify", "id", None), ("export", "id", None))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sigmill", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    for name, argument, number in COMMANDS:
        one = commands.add_parser(name)
        if argument:
            one.add_argument(argument, nargs=number, type=int if argument == "id" else str)
        one.add_argument("--ohlcv")
        one.add_argument("--securities")
        one.add_argument("--macro", action="append", default=[], metavar="NAME=FILE", help="a CSV series (date, value); may be given again")
        one.add_argument("--statements", help="Parquet of quarterly statements (ticker, report_date, item, value)")
        one.add_argument("--factors", help="text file of daily factor returns")
        one.add_argument("--universes", help="Parquet of universes (universe, ticker, ord)")
        one.add_argument("--store")
        if name not in ("list", "export", "verify"):  # verify runs with the saved settings
            one.add_argument("--universe", help="a name in --universes, or tickers with commas between them")
            one.add_argument("--start")
            one.add_argument("--end")
            one.add_argument("--neutralization", choices=NEUTRALIZATIONS, default="market")
            one.add_argument("--booksize", type=float, default=Settings.booksize)
            one.add_argument("--oos", action="store_true")
        if name == "verify":
            one.add_argument("--tolerance", type=float, default=1e-3)
        if name == "shuffle":
            one.add_argument("--number", type=int, default=50)
            one.add_argument("--seed", type=int, default=0)
        if name == "optimize":
            one.add_argument("--min-sharpe", type=float, default=0.0)
        if name == "list":
            one.add_argument("--min-sharpe", type=float)
            one.add_argument("--max-drawdown", type=float)
            one.add_argument("--has-provenance", action="store_true")
            one.add_argument("--limit", type=int, default=50)
            one.add_argument("--by", choices=("newest", "sharpe"), default="newest")
        if name == "export":
            one.add_argument("--json", action="store_true")
        if name == "run":
            one.add_argument("--save")
    return out


def opened(args, spark, store: Store | None) -> Workspace:
    """The workspace of the files that the arguments name."""
    rows = panel.load(spark, args.ohlcv, args.securities)
    if args.macro:
        rows = macro.attach(rows, macro.assemble([macro.read_series(spark, path, name) for name, _, path in (m.partition("=") for m in args.macro)]))
    if args.statements:
        rows = fundamentals.attach(rows, fundamentals.reports(spark.read.parquet(args.statements)))
    rows = rows.persist()
    factors = macro.read_factors(spark, args.factors) if args.factors else None
    return Workspace(rows, universe.read_universes(spark, args.universes) if args.universes else None, macro.equal_weight(rows), factors, store)


def settings_of(args, space: Workspace) -> Settings:
    tickers = None
    if args.universe:
        tickers = universe.Catalogue(space.universes).get(args.universe) if args.universe in space.universes or "," not in args.universe else tuple(t.strip().upper() for t in args.universe.split(","))
    return Settings(universe=tickers, start_date=args.start, end_date=args.end, neutralization=args.neutralization, booksize=args.booksize, run_oos=args.oos)


def main(arguments: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(arguments)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("sigmill").getOrCreate()
    store = Store(spark, args.store) if args.store else None
    if args.command in ("list", "export"):
        return _saved(args, store)
    space = opened(args, spark, store)
    say = lambda x: print(json.dumps(x, default=str, indent=2))
    try:
        settings = settings_of(args, space) if args.command != "verify" else None
        if args.command == "run":
            say([r.asDict() for r in space.simulate(args.formula, settings)["summary"].collect()])
            if args.save:
                print(f"saved as {space.save(args.save, args.formula, settings)}")
            return 0
        if args.command == "shuffle":
            found = space.shuffle_test(args.formula, settings, args.number, args.seed)
            say(found)
            return 0 if found["verdict"] == "real-signal" else 1
        if args.command == "optimize":
            rows = [r.asDict() for r in space.sweep(args.formula, settings).collect()]
            say(rows)
            return 0 if rows and rows[0]["sharpe"] is not None and rows[0]["sharpe"] >= args.min_sharpe else 1
        if args.command == "compare":
            good, bad = batch.checked(args.formula)
            say([r.asDict() for r in batch.compare(space.panel, [args.formula[k] for k in good], settings).collect()] if good else [])
            if bad:
                say({"failed": {args.formula[k]: m for k, m in bad.items()}})
            return 1 if bad else 0
        if args.command == "stress":
            rows = [r.asDict() for r in space.simulate(args.formula, settings)["stress"].collect()]
            say(rows)
            return 1 if any(r["sharpe"] < -0.5 for r in rows) else 0
        found = space.verify(args.id, args.tolerance)
        say(found)
        return 0 if found["matches"] else 1
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    except ExpressionError as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        space.release()
        space.panel.unpersist()


def _saved(args, store: Store) -> int:
    if args.command == "list":
        for r in store.list(args.min_sharpe, args.max_drawdown, args.has_provenance, args.by, args.limit).collect():
            print(f"{r['id']}\t{r['name']}\t{r['sharpe']}\t{r['expression']}")
        return 0
    try:
        print(store.export(args.id, "json" if args.json else "text"))
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
