"""The queries of the driver's contract for the engine's own operators: each runs one feature over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill import oracles
from sigmill.api import EXAMPLES
from sigmill.functions import exposure, performance, signal_quality, statistics
from sigmill.functions.fields import MACRO_BASE, MACRO_SPREADS
from sigmill.plans import batch, portfolio
from sigmill.plans.compiler import evaluate
from sigmill.sources import fundamentals, macro, panel, universe
from sigmill.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]


def rounded(x: str | Column, digits: int = 5) -> Column:
    """x on a grid of `digits` decimals, as sums differ in their last bits between engines. The offset isn't a half: prices often lie halfway between decimals."""
    return F.floor((F.col(x) if isinstance(x, str) else x).cast("double") * F.lit(10.0**digits) + F.lit(0.27)) / F.lit(10.0**digits)


def with_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals.attach(panel.supplier_panel(spark, sf_dir), fundamentals.supplier_quarters(spark, sf_dir))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier panel with macro series and fundamentals."""
    return macro.attach(with_fundamentals(spark, sf_dir), macro.order_series(spark, sf_dir))


DIGITS = {"ts_product": 4, "ts_skewness": 4, "ts_kurtosis": 4, "ts_cov": 3, "ts_partial_corr": 4, "signed_power": 4, "scale": 8, "normalize": 8, "group_normalize": 7, "group_scale": 7}


def _operator(name: str, formula: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = with_fundamentals(spark, sf_dir) if name == "cap_weight" else panel.supplier_panel(spark, sf_dir)
        return evaluate(base, formula).select("date", "ticker", rounded("value", DIGITS.get(name, 5)).alias("value"))

    return run


SCALES = {"dollar_volume": 1e-3, "amihud": 1e6, "dollar_amihud": 1e6, "kyle_lambda": 1e3, "shares_outstanding": 1e-3, "market_cap": 1e-6}


def _scaled(name: str) -> Column:
    return F.col(name) * F.lit(SCALES[name]) if SCALES.get(name, 0) >= 1 else F.col(name) / F.lit(1 / SCALES[name]) if name in SCALES else F.col(name)


def _field_set(name: str) -> Query:
    _, columns, digits = oracles.FIELD_SETS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(panel.brand_panel(spark, sf_dir), *columns, names=list(columns))
        return out.select("date", "ticker", *[rounded(_scaled(n), digits).alias(n) for n in columns])

    return run


def fields_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = macro.attach(panel.supplier_panel(spark, sf_dir), macro.order_series(spark, sf_dir))
    return out.select("date", "ticker", *[rounded(n).alias(n) for n in (*MACRO_BASE, *MACRO_SPREADS)])


def fields_fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_fundamentals(spark, sf_dir)
    return out.select("date", "ticker", *[rounded(F.col(n) / 1000, 3).alias(n) for n in oracles.RAW], rounded("eps", 4).alias("eps"))


def fields_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(oracles.RATIOS)
    out = evaluate(with_fundamentals(spark, sf_dir), *names, names=names)
    return out.select("date", "ticker", *[rounded(_scaled(n), 4).alias(n) for n in names])


# --- portfolios ------------------------------------------------------------------------------------------------------------
REVERSAL = "-rank(delta(close, 5))"
KEY = ("segment",)


def daily_rows(days: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    return days.select(*by, "date", *[rounded(c, 2).alias(c) for c in oracles.DAILY], rounded("ret", 8).alias("ret"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily results of a short-term reversal on the supplier panel."""
    return daily_rows(portfolio.simulate(panel.supplier_panel(spark, sf_dir), REVERSAL)[1])


def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, _ = portfolio.simulate(panel.supplier_panel(spark, sf_dir), REVERSAL)
    return book.select("segment", "date", "ticker", rounded("signal", 6).alias("signal"), rounded("weight", 8).alias("weight"), rounded("position", 2).alias("position"), rounded("trade", 2).alias("trade"))


SOME = ("S1", "S2", "S3", "S5", "S8", "S13", "S21", "S34", "S55", "S89")
SETTINGS = {
    "portfolio_sector": portfolio.Settings(neutralization="sector"),
    "portfolio_sub_industry": portfolio.Settings(neutralization="sub_industry", run_oos=False),
    "portfolio_raw_lagged": portfolio.Settings(neutralization="none", execution_lag=3, truncation=0.01),
    "portfolio_decay": portfolio.Settings(decay=4),
    "portfolio_dates_universe": portfolio.Settings(start_date="1996-03-01", end_date="2000-06-01", universe=SOME, truncation=0.2),
    "portfolio_costs": portfolio.Settings(spread_model="flat", cost_model="sqrt_impact", borrow_cost_bps_annual=50.0),
    "portfolio_corwin_schultz": portfolio.Settings(spread_model="corwin_schultz"),
    "portfolio_liquid": portfolio.Settings(min_adv_dollars=2_000_000.0),
    "portfolio_point_in_time": portfolio.Settings(),
    "portfolio_point_in_time_zero": portfolio.Settings(pit_mask="zero"),
}


def _portfolio(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        late = None
        if "point_in_time" in name:
            late = spark.createDataFrame([("S3", "1998-01-01"), ("S7", "1998-01-01")], "ticker string, d string").select("ticker", F.to_date("d").alias("join_date"))
        return daily_rows(portfolio.simulate(panel.supplier_panel(spark, sf_dir), REVERSAL, SETTINGS[name], late)[1])

    return run


WALK = portfolio.Settings(walk_forward_train=24, walk_forward_test=12, walk_forward_step=12)


def portfolio_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = portfolio.walk_forward(panel.supplier_panel(spark, sf_dir), REVERSAL, WALK)
    exact = ["train_start", "train_end", "test_start", "test_end"]
    return out.select("window", *exact, *[rounded(c, 4).alias(c) for c in ("train_sharpe", "test_sharpe")], rounded("test_total_return").alias("test_total_return"), rounded("test_cumulative_pnl", 1).alias("test_cumulative_pnl"))


# --- analytics ---------------------------------------------------------------------------------------------------------------
def _analytics() -> dict[str, Query]:
    """Each takes the positions and daily tables of the flagship."""
    p, q, x = performance, signal_quality, exposure
    decimals = lambda df, **digits: df.select(*[rounded(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
    sizes = lambda book, base: book.select("date", "ticker").distinct().join(base.select("date", "ticker", (F.col("close") * F.col("volume")).alias("size")), ["date", "ticker"])
    numbers = dict(sharpe=5, total_return=5, annual_return=5, annual_vol=5, max_drawdown=5, sortino_ratio=5, avg_turnover=1, win_rate=5, profit_factor=5, tail_ratio=5, cost_pct_of_gross=3, long_exposure=5, short_exposure=5, gross_exposure=5, net_exposure=5, beta=5, information_ratio=5, skew=4, kurt=4, calmar_ratio=4, fitness=4, fitness_wq=4)
    costs = dict(gross_pnl=1, flat_cost=1, spread_cost=1, impact_cost=1, borrow_cost=1, total_cost=1, net_pnl=1, cost_pct_of_gross=3)
    series = lambda book: q.ic_series(book, q.HORIZONS)
    regimes = [("first_rates", "1995-06-01", "1996-06-01"), ("mid", "1997-01-01", "1998-06-01"), ("late", "2000-01-01", "2001-10-01"), ("empty", "2008-01-01", "2009-01-01"), ("short", "1999-01-01", "1999-02-01")]
    makers = {
        "summary": lambda book, days, base: decimals(p.summary(days, macro.equal_weight(base)).withColumns({c: F.log1p(F.abs(c)) for c in ("annual_return", "calmar_ratio", "fitness", "fitness_wq")}).select("segment", "n_days", *numbers), **numbers),  # logarithms: monthly returns carried on to a year are very large
        "costs": lambda book, days, base: decimals(p.summary(days).select("segment", *costs), **costs),
        "compare_halves": lambda book, days, base: decimals(p.compare_halves(p.summary(days)), sharpe_decay=4, return_decay=4),
        "size_quality": lambda book, days, base: x.size_quality(sizes(book, base)),
        "drawdowns": lambda book, days, base: decimals(p.drawdowns(days).select("segment", "date", "equity", "drawdown", "underwater"), equity=6, drawdown=6),
        "drawdown_durations": lambda book, days, base: p.drawdown_durations(days),
        "rolling_sharpe": lambda book, days, base: decimals(p.rolling_sharpe(days), rolling_sharpe=5),
        "monthly": lambda book, days, base: decimals(p.monthly_returns(days), ret=6),
        "yearly": lambda book, days, base: decimals(p.yearly_returns(days), sharpe=5, annual_return=6),
        "positive_months": lambda book, days, base: decimals(p.positive_months(days), positive_months_pct=5),
        "ic_series": lambda book, days, base: decimals(series(book), ic=5),
        "ic_summary": lambda book, days, base: decimals(q.ic_summary(series(book)), ic=5, icir=4, ic_tstat=4, ic_pct_positive=5),
        "ic_bands": lambda book, days, base: decimals(q.ic_bands(q.ic_series(book)).select("segment", "date", "mean", "low", "high"), mean=5, low=5, high=5),
        "alpha_decay": lambda book, days, base: decimals(q.alpha_decay(series(book)), half_life_days=4, r_squared=5),
        "quantiles": lambda book, days, base: decimals(q.quantile_returns(book), mean_return=5),
        "rank_stability": lambda book, days, base: decimals(q.rank_stability(book), rank_stability=5),
        "group_exposure": lambda book, days, base: decimals(x.group_exposure(book), avg_net=7, avg_gross=7),
        "headline": lambda book, days, base: decimals(x.headline(x.group_exposure(book)), max_long_exposure=7, max_short_exposure=7),
        "group_series": lambda book, days, base: decimals(x.group_exposure_series(book, most=20), net=7),
        "size_exposure": lambda book, days, base: decimals(x.size_exposure(book, sizes(book, base)), avg_corr=5),
        "size_distribution": lambda book, days, base: decimals(x.size_distribution(book, sizes(book, base)), long_share=6, short_share=6),
        "size_tilt": lambda book, days, base: decimals(x.size_tilt(x.size_distribution(book, sizes(book, base))), long_avg=5, short_avg=5, tilt=5),
        "attribution": lambda book, days, base: decimals(x.attribution(book), allocation=7, selection=7, total=7),
        "attribution_totals": lambda book, days, base: decimals(x.attribution_totals(x.attribution(book)).select("segment", "allocation", "selection", "allocation_pct"), allocation=6, selection=6, allocation_pct=3),
        "stress": lambda book, days, base: decimals(p.stress(days, p.regime_table(days.sparkSession, regimes)).withColumn("annualised_return", F.log1p("annualised_return")).select("segment", "name", "n_days", "sharpe", "total_return", "max_drawdown", "hit_rate", "annualised_return", "severity"), sharpe=5, total_return=5, max_drawdown=5, hit_rate=5, annualised_return=4),
        "deflated_sharpe": lambda book, days, base: decimals(statistics.deflated(p.summary(days)).select("segment", "sharpe", "deflated_z"), sharpe=5, deflated_z=4),
        "deflated_sharpe_20": lambda book, days, base: decimals(statistics.deflated(p.summary(days), trials=20).select("segment", "deflated_sharpe", "deflated_z"), deflated_sharpe=4, deflated_z=4),
    }

    def run_of(maker) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            base = panel.supplier_panel(spark, sf_dir)
            return maker(*portfolio.simulate(base, REVERSAL), base)

        return run

    return {f"analytics_{name}": run_of(maker) for name, maker in makers.items()}


def analytics_factor_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings on the stand-in factors."""
    base = panel.brand_panel(spark, sf_dir)
    _, days = portfolio.simulate(base, REVERSAL, portfolio.Settings(run_oos=False))
    found = statistics.factor_regression(days, macro.panel_factors(base))
    rows = [("alpha", found["alpha_annualized"], found["alpha_t_stat"])] + [(k, v["beta"], v["t_stat"]) for k, v in found["loadings"].items()] if found else []
    return spark.createDataFrame(rows, "name string, value double, t_stat double").select("name", rounded("value", 4).alias("value"), rounded("t_stat", 3).alias("t_stat"))


# --- batches -------------------------------------------------------------------------------------------------------------------
FORMULAS = list(oracles.CELLS)
POOL = ["-rank(delta(close, 3))", "-rank(delta(close, 4))", "-rank(delta(close, 5))", *FORMULAS]
CHOSEN = statistics.subsets(list(range(len(POOL))))


def _cell_rows(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, "n_days", rounded("sharpe").alias("sharpe"), rounded("total_return", 6).alias("total_return"), rounded("avg_turnover", 1).alias("avg_turnover"))


def batch_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_rows(batch.compare(panel.supplier_panel(spark, sf_dir), FORMULAS), "cell", "segment")


def batch_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_rows(batch.sweep(panel.supplier_panel(spark, sf_dir), oracles.SWEEP).withColumn("segment", F.lit("is")), "cell", "segment")


def batch_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, days = batch.blend(panel.supplier_panel(spark, sf_dir), FORMULAS, weights=[2.0, 1.0, 1.0])
    return daily_rows(days)


def _blend(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, _, days = batch.blend(panel.supplier_panel(spark, sf_dir), FORMULAS, method=method)
        return days.select("segment", "date", rounded("net", 0).alias("net"), rounded("turnover", 0).alias("turnover"), rounded("ret", 6).alias("ret"))

    return run


BLENDS = ("inverse_variance", "mv_optimal", "risk_parity")
PERMUTATIONS = 50


def batch_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of the panel (-1) and of copies with shuffled dates."""
    out = batch.permutation_runs(panel.supplier_panel(spark, sf_dir), REVERSAL, portfolio.Settings(run_oos=False), number=PERMUTATIONS)
    return out.select("iteration", rounded("sharpe", 4).alias("sharpe"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = batch.run_cells(panel.supplier_panel(spark, sf_dir), POOL, portfolio.Settings(run_oos=False))
    return days.select(F.col("cell").alias("id"), "date", "ret")


def pool_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = batch.run_cells(panel.supplier_panel(spark, sf_dir), FORMULAS, portfolio.Settings(run_oos=False))
    return statistics.correlations(days.select(F.col("cell").alias("id"), "date", "ret")).withColumn("corr", rounded("corr"))


def pool_diversification(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.diversification(_pool(spark, sf_dir), spark.createDataFrame(CHOSEN, "n int, sample int, id int"))
    return out.select("n", *[rounded(c).alias(c) for c in ("median_sharpe", "q1", "q3", "min", "max")], "n_samples")


def pool_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batch.compare(panel.supplier_panel(spark, sf_dir), POOL, portfolio.Settings(run_oos=False))
    rows = found.select(F.col("cell").alias("id"), rounded("sharpe").alias("sharpe"), rounded("avg_turnover", 1).alias("turnover"))
    return statistics.pareto(rows)


def pool_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dominators of each formula, as text."""
    found = batch.compare(panel.supplier_panel(spark, sf_dir), POOL, portfolio.Settings(run_oos=False))
    rows = found.select(F.col("cell").alias("id"), rounded("sharpe").alias("sharpe"), rounded("avg_turnover", 1).alias("turnover"))
    return statistics.dominators(rows).select("id", F.concat_ws(",", F.col("dominated_by").cast("array<string>")).alias("dominated_by"))


def store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's formulas saved one after another, then those with a Sharpe ratio of 0 or more, the best first; a deleted one is gone."""
    store = Store(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/strategies-{uuid.uuid4().hex}")
    found = batch.compare(panel.supplier_panel(spark, sf_dir), POOL, portfolio.Settings(run_oos=False))
    for r in sorted(found.select("cell", "sharpe").collect()):  # one row per formula
        store.save(name=f"p{r['cell']}", expression=POOL[r["cell"]], sharpe=r["sharpe"])
    store.delete(1)
    return store.list(min_sharpe=0.0, by="sharpe", limit=4).select("id", "name", "expression", rounded("sharpe").alias("sharpe"))


def source_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' months as a price table with other names and cases, missing closes and infinite volumes, brought to form."""
    rows = panel.supplier_months(spark, sf_dir)
    odd = F.month("date") % 5 == 0
    raw = rows.select(F.concat(F.lit(" "), F.lower("ticker")).alias("Ticker"), F.date_format("date", "yyyy-MM-dd").alias("DATE"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low")], F.when(~odd, F.col("close")).alias("Close"), F.when(odd, float("inf")).otherwise(F.col("volume")).alias("Volume"))
    return panel.normalized(raw).select("date", "ticker", *[rounded(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume", "returns", "vwap")])


def source_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' weeks with the suppliers' months added, and those of even suppliers again with twice the volume."""
    first = panel.supplier_months(spark, sf_dir)
    more = first.where("cast(substring(ticker, 2, 20) as long) % 2 = 0").withColumn("volume", F.col("volume") * 2)
    out = panel.expanded(panel.expanded(panel.brand_weeks(spark, sf_dir), first), more)
    return panel.matrix(out, "volume").withColumn("value", rounded("value", 2))


def source_merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a table for every third supplier, before those of the suppliers' nations."""
    base = panel.supplier_labels(spark, sf_dir)
    own = base.where("cast(substring(ticker, 2, 20) as long) % 3 = 0").select("ticker", F.lit("Own").alias("sector"), F.lit(None).cast("string").alias("industry"))
    return universe.merged_labels(own, base)


def source_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements in long form, by label, brought to fields; free cash flow is derived."""
    wide = fundamentals.supplier_quarters(spark, sf_dir)
    labels = {"revenue": "Total Revenue", "net_income": "Net Income", "operating_cash_flow": "Operating Cash Flow", "capex": "Capital Expenditure"}
    items = wide.unpivot(["ticker", "report_date"], [F.col(c).alias(label) for c, label in labels.items()], "item", "value")
    return fundamentals.reports(items).select("ticker", "report_date", *[rounded(F.col(c) / 1000, 3).alias(c) for c in (*labels, "free_cash_flow")])


def data_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all closes of the panel."""
    return statistics.data_signature(panel.supplier_panel(spark, sf_dir))


def panel_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.preview(panel.supplier_panel(spark, sf_dir), "S1").select("date", "ticker", *[rounded(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume", "returns", "vwap")])


def universe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tickers each group of each label level has."""
    rows = panel.supplier_panel(spark, sf_dir).select("ticker", *panel.LABEL_COLUMNS).distinct()
    return rows.unpivot("ticker", list(panel.LABEL_COLUMNS), "level", "label").groupBy("level", "label").agg(F.count(F.lit(1)).alias("n"))


def universe_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per date, where every seventh ticker joins in 1997."""
    base = panel.supplier_panel(spark, sf_dir)
    late = base.where("ticker_ord % 7 = 0").select("ticker", F.lit("1997-01-01").cast("date").alias("join_date")).distinct()
    return universe.membership(base, late)


def universe_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys, taken for tickers, that no supplier has."""
    wanted = panel.table(spark, sf_dir, "customer").select(F.concat(F.lit(" s"), F.col("c_custkey")).alias("ticker"))
    return universe.missing(wanted, panel.supplier_panel(spark, sf_dir))


def _acceptance(name: str) -> Query:
    formula, neutralization = EXAMPLES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = panel.brand_panel(spark, sf_dir) if name == "close_to_high" else full_panel(spark, sf_dir)  # 252 rows need the longer panel
        _, days = portfolio.simulate(base, formula, portfolio.Settings(neutralization=neutralization))
        return daily_rows(days)

    return run


BATCHES = (batch_compare, batch_sweep, batch_blend, batch_permutation_test, pool_correlations, pool_diversification, pool_pareto, pool_dominators, store_list, source_normalized, source_expanded, source_merged_labels, source_statements, data_signature, panel_preview, universe_labels, universe_membership, universe_missing)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"dsl_{name}": _operator(name, formula) for name, (formula, _) in oracles.OPERATORS.items()}
    found |= {name: _field_set(name) for name in oracles.FIELD_SETS}
    found |= {f.__name__: f for f in (fields_macro, fields_fundamental, fields_ratio, flagship, portfolio_positions, portfolio_walk_forward, analytics_factor_regression, *BATCHES)}
    found |= {name: _portfolio(name) for name in SETTINGS} | {f"batch_blend_{method}": _blend(method) for method in BLENDS}
    found |= _analytics()
    found |= {f"example_{name}": _acceptance(name) for name in EXAMPLES}
    return found


def oracle_sql() -> dict[str, str]:
    found = {f"dsl_{name}": sql for name, (_, sql) in oracles.OPERATORS.items()}
    found |= {name: oracles.fields_sql(name) for name in oracles.FIELD_SETS}
    found |= {"fields_macro": oracles.macro_sql(), "fields_fundamental": oracles.fundamentals_sql(), "fields_ratio": oracles.ratios_sql()}
    found |= {"flagship": oracles.select_daily(oracles.base_book()), "portfolio_positions": oracles.book_sql(oracles.base_book()), "portfolio_walk_forward": oracles.walk_sql()}
    found |= {name: oracles.select_daily(ctes) for name, ctes in oracles.PORTFOLIOS.items()}
    found |= oracles.analytics()
    found |= {"batch_compare": oracles.cells_sql(list(oracles.CELLS.values())), "batch_sweep": oracles.cells_sql(oracles.SWEEP_CELLS, False), "batch_blend": oracles.blend_sql()}
    found |= {"pool_correlations": oracles.correlations_sql(), "pool_diversification": oracles.diversification_sql(CHOSEN), "pool_pareto": oracles.pareto_sql()}
    orders = [np.random.default_rng(k).permutation(83).tolist() for k in range(PERMUTATIONS)]  # the test data have 83 months at every scale
    found |= {"batch_permutation_test": oracles.permutation_sql(orders)}
    found |= {f"batch_blend_{method}": oracles.weighted_blend_sql(method) for method in BLENDS}
    found |= {"analytics_factor_regression": oracles.regression_sql(), "pool_dominators": oracles.dominators_sql(), "store_list": oracles.store_sql(POOL), "data_signature": oracles.signature_sql()}
    found |= {"source_normalized": oracles.normalized_sql(), "source_expanded": oracles.expanded_sql(), "source_merged_labels": oracles.merged_labels_sql(), "source_statements": oracles.statements_sql()}
    found |= {"panel_preview": oracles.preview_sql(), "universe_labels": oracles.labels_sql(), "universe_membership": oracles.membership_sql(), "universe_missing": oracles.missing_sql()}
    found |= {f"example_{name}": oracles.example_sql(name) for name in EXAMPLES}
    return found
