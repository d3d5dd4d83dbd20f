"""From a signal to positions, profit and costs: one plan for any number of independent segments.

A segment (a half of the history, a walk-forward window, a cell of a sweep) restarts every lag and decay, so its columns
join every window's partitioning and all segments run as one job.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compiler import Context, evaluate
from .syntax import ExpressionError

TRADING_DAYS = 252
NEUTRALIZATIONS = ("none", "market", "sector", "industry_group", "industry", "sub_industry")


@dataclass(frozen=True)
class Settings:
    """How a signal is traded. universe: tickers, or None for all. pit_mask: what a name that isn't in yet gets, `null` or `zero`."""

    universe: tuple[str, ...] | None = None
    start_date: str | None = None
    end_date: str | None = None
    neutralization: str = "market"
    truncation: float = 0.05
    booksize: float = 20_000_000.0
    transaction_cost_bps: float = 5.0
    decay: int = 0
    run_oos: bool = True
    oos_split: float = 0.3
    cost_model: str = "flat"  # or sqrt_impact
    impact_coefficient: float = 0.1
    spread_model: str = "none"  # or flat, corwin_schultz
    half_spread_bps: float = 2.5
    borrow_cost_bps_annual: float = 0.0
    walk_forward_train: int = 252
    walk_forward_test: int = 63
    walk_forward_step: int = 63
    execution_lag: int = 1
    min_adv_dollars: float = 0.0
    pit_mask: str = "null"

    def __post_init__(self):
        for name, known in (("neutralization", NEUTRALIZATIONS), ("cost_model", ("flat", "sqrt_impact")), ("spread_model", ("none", "flat", "corwin_schultz")), ("pit_mask", ("null", "zero"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}, not {getattr(self, name)!r}")

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    def saved(self) -> dict:
        """All settings as JSON holds them."""
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def restored(cls, saved: dict | None) -> Settings:
        """The settings of saved(); names that are no settings any more are left out, absent ones have their defaults."""
        known = {k: v for k, v in (saved or {}).items() if k in cls.__dataclass_fields__}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


def market_fields(settings: Settings) -> list[str]:
    """The fields that trading needs besides the signal."""
    out = ["returns"]
    if settings.min_adv_dollars > 0 or settings.cost_model == "sqrt_impact":
        out.append("dollar_volume")
    if settings.cost_model == "sqrt_impact":
        out.append("realized_vol")
    if settings.spread_model == "corwin_schultz":
        out.append("corwin_schultz")
    return out


def signal_rows(panel: DataFrame, formulas: dict[str, str], settings: Settings, segments: tuple[str, ...] = ()) -> DataFrame:
    """(segments, date, ticker, ticker_ord, labels, market fields, one column per formula) over the whole panel: nothing is filtered before the formulas."""
    fields = market_fields(settings)
    labels = [c for c in ("sector", "industry_group", "industry", "sub_industry") if c in panel.columns]
    if settings.neutralization not in ("none", "market", *labels):
        raise ExpressionError(f"the panel has no label {settings.neutralization!r}")
    names = [f"_m_{f}" for f in fields] + [f"_f_{n}" for n in formulas]
    out = evaluate(panel, *fields, *formulas.values(), segments=segments, keep=tuple(labels), names=names)
    return out.withColumnsRenamed({f"_m_{f}": f for f in fields} | {f"_f_{n}": n for n in formulas})


def selected(rows: DataFrame, settings: Settings, segments: tuple[str, ...] = ()) -> DataFrame:
    """rows (with `signal`) of the universe and the dates; dates on which more than half of the signals are missing go. Adds place: the date's number from 1, and dates: how many there are."""
    if settings.universe is not None:
        names = F.explode(F.from_json(F.lit(json.dumps(sorted(set(settings.universe)))), "array<string>"))  # one literal, however many names
        rows = rows.join(F.broadcast(rows.sparkSession.range(1).select(names.alias("ticker"))), "ticker", "left_semi")
    if settings.start_date:
        rows = rows.where(F.col("date") >= F.lit(settings.start_date).cast("date"))
    if settings.end_date:
        rows = rows.where(F.col("date") <= F.lit(settings.end_date).cast("date"))
    day = Window.partitionBy(*segments, "date")
    share = F.count("signal").over(day) / F.count(F.lit(1)).over(day)
    rows = rows.withColumn("_share", share).where("_share >= 0.5").drop("_share")
    own = Window.partitionBy(*segments, "ticker")
    return rows.withColumn("place", F.row_number().over(own.orderBy("date"))).withColumn("dates", F.count(F.lit(1)).over(own))


def halves(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with segment `is` or `oos`, by the number of dates; all `is` without a split, or if one side would be empty."""
    if not settings.run_oos:
        return rows.withColumn("segment", F.lit("is"))
    cut = F.floor(F.col("dates") * F.lit(1.0 - settings.oos_split))
    return rows.withColumn("segment", F.when((cut > 0) & (cut < F.col("dates")) & (F.col("place") > cut), "oos").otherwise("is"))


def windows(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows of each walk-forward window: window number, segment `train` or `test`."""
    train, test, step = (max(1, int(x)) for x in (settings.walk_forward_train, settings.walk_forward_test, settings.walk_forward_step))
    last = F.floor((F.col("dates") - (train + test)) / step)
    # the windows whose train and test hold this place
    low = F.greatest(F.lit(0), F.ceil((F.col("place") - (train + test)) / step))
    high = F.least(last, F.floor((F.col("place") - 1) / step))
    rows = rows.withColumn("window", F.explode(F.when((F.col("dates") >= train + test) & (low <= high), F.sequence(low.cast("int"), high.cast("int")))))
    return rows.withColumn("segment", F.when(F.col("place") - F.col("window") * step <= train, "train").otherwise("test"))


def positions(rows: DataFrame, settings: Settings, segments: tuple[str, ...] = ("segment",), inclusion: DataFrame | None = None) -> DataFrame:
    """(segments, date, ticker, ticker_ord, labels, signal, weight, position, ret, trade, costs) from rows with `signal`. inclusion: (ticker, join_date) of names that came later."""
    context = Context(rows.withColumnRenamed("signal", "_signal"), segments)
    signal = F.col("_signal")
    if inclusion is not None:
        context.df = context.df.join(F.broadcast(inclusion.select("ticker", "join_date")), "ticker", "left")  # one row per late name
        early = F.col("date") < F.col("join_date")
        signal = context.settle(F.when(early, F.lit(0.0) if settings.pit_mask == "zero" else F.lit(None).cast("double")).otherwise(signal))
    if settings.min_adv_dollars > 0:
        adv = F.avg("dollar_volume").over(context.rows(20))
        signal = context.settle(F.when(adv >= settings.min_adv_dollars, signal))
    if settings.decay > 0:
        signal = context.settle(context.functions["decay_linear"].build(context, signal, settings.decay))
    if settings.neutralization == "market":
        signal = context.settle(signal - F.avg(signal).over(context.across()))
    elif settings.neutralization != "none":
        group = F.coalesce(F.col(settings.neutralization), F.lit("Unknown"))
        signal = context.settle(signal - F.avg(signal).over(context.across(group)))
    size = F.sum(F.abs(signal)).over(context.across())
    weight = F.coalesce(F.try_divide(signal, F.when(size != 0, size)), F.lit(0.0))
    cap = float(settings.truncation)
    weight = context.settle(F.greatest(F.least(weight, F.lit(cap)), F.lit(-cap)))
    position = context.settle(weight * F.lit(settings.booksize))
    own = context.history()
    before = context.settle(F.lag(position, 1).over(own))
    held = F.lag(position, max(1, int(settings.execution_lag))).over(own)
    trade = context.settle(F.coalesce(F.abs(position - before), F.lit(0.0)))
    zero = F.lit(0.0)
    spread = {"none": zero, "flat": trade * F.lit(settings.half_spread_bps / 1e4), "corwin_schultz": trade * F.greatest(F.coalesce(F.col("corwin_schultz") if "corwin_schultz" in context.df.columns else zero, zero), zero) * 0.5}[settings.spread_model]
    impact = zero
    if settings.cost_model == "sqrt_impact":
        share = F.coalesce(F.try_divide(trade, F.when(F.col("dollar_volume") > 0, F.col("dollar_volume"))), zero)
        impact = F.lit(settings.impact_coefficient) * F.coalesce("realized_vol", zero) * trade * F.sqrt(share)
    borrow = F.greatest(F.coalesce(-before, zero), zero) * F.lit(settings.borrow_cost_bps_annual / (1e4 * TRADING_DAYS))
    labels = [c for c in ("sector", "industry_group", "industry", "sub_industry") if c in context.df.columns]
    return context.df.select(
        *segments, "date", "ticker", "ticker_ord", *labels, signal.alias("signal"), weight.alias("weight"), position.alias("position"), F.col("returns").alias("ret"), trade.alias("trade"),
        F.coalesce(held * F.col("returns"), zero).alias("gross"), (trade * F.lit(settings.transaction_cost_bps / 1e4)).alias("flat"), spread.alias("spread"), impact.alias("impact"), borrow.alias("borrow"),
    )


def daily(book: DataFrame, settings: Settings, segments: tuple[str, ...] = ("segment",)) -> DataFrame:
    """(segments, date, gross, flat, spread, impact, borrow, net, cumulative, ret, turnover, long, short, gross_exposure) of positions()."""
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    by = book.groupBy(*segments, "date").agg(
        *[total(F.col(c)).alias(c) for c in ("gross", "flat", "spread", "impact", "borrow")],
        total(F.col("trade")).alias("turnover"), total(F.greatest("position", F.lit(0.0))).alias("long"), total(F.least("position", F.lit(0.0))).alias("short"), total(F.abs("position")).alias("gross_exposure"),
    )
    by = by.withColumn("net", F.col("gross") - F.col("flat") - F.col("spread") - F.col("impact") - F.col("borrow"))
    run = Window.partitionBy(*segments).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date and segment
    return by.withColumn("cumulative", F.sum("net").over(run)).withColumn("ret", F.col("net") / F.lit(settings.booksize))


def simulate(panel: DataFrame, formula: str, settings: Settings = Settings(), inclusion: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, daily) of one formula, with segments `is` and `oos`."""
    rows = signal_rows(panel, {"signal": formula}, settings)
    book = positions(halves(selected(rows, settings), settings), settings, inclusion=inclusion)
    return book, daily(book, settings)


def walk_forward(panel: DataFrame, formula: str, settings: Settings = Settings()) -> DataFrame:
    """One row per window: dates of train and test, both Sharpe ratios, return and profit of the test. All windows are one job."""
    by = ("window", "segment")
    rows = windows(selected(signal_rows(panel, {"signal": formula}, settings), settings), settings)
    days = daily(positions(rows, settings, by), settings, by)
    stats = days.groupBy("window").agg(
        *[f(F.when(F.col("segment") == s, F.col("date"))).alias(f"{s}_{n}") for s in ("train", "test") for n, f in (("start", F.min), ("end", F.max))],
        *[sharpe(F.when(F.col("segment") == s, F.col("ret"))).alias(f"{s}_sharpe") for s in ("train", "test")],
        F.sum(F.when(F.col("segment") == "test", F.col("ret"))).alias("test_total_return"), F.sum(F.when(F.col("segment") == "test", F.col("net"))).alias("test_cumulative_pnl"),
    )
    return stats


def sharpe(ret: Column) -> Column:
    """Yearly Sharpe ratio of an aggregated return; 0 without spread."""
    variance = F.var_samp(ret)
    return F.coalesce(F.try_divide(F.avg(ret), F.sqrt(F.when(variance > 1e-24, variance))) * F.lit(TRADING_DAYS**0.5), F.lit(0.0))
