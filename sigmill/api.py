"""The library's front door: a workspace over one panel, with what a user runs day by day."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import exposure, performance, signal_quality, statistics
from sigmill.functions.catalog import catalog
from sigmill.functions.fields import FIELDS, RAW_FUNDAMENTALS, field_catalog
from sigmill.plans import batch, portfolio
from sigmill.plans.compiler import check, evaluate
from sigmill.plans.lint import lint
from sigmill.plans.syntax import ExpressionError, field_names, fold, parse
from sigmill.sources import fundamentals
from sigmill.sources.panel import LABEL_COLUMNS, preview
from sigmill.sources.store import Store, result_json

# Example formulas and their neutralization.
EXAMPLES = {
    "momentum_20_decayed": ("decay_linear(rank(momentum_20), 20)", "none"),
    "reversal_5_volscaled": ("rank(reversal_5) / (realized_vol + 0.001)", "market"),
    "close_to_high": ("rank(close_to_high_252)", "none"),
    "sector_neutral_momentum": ("group_neutralize(rank(momentum_60), sector)", "none"),
    "pe_meanreversion": ("-zscore(pe_ratio)", "market"),
    "quality_momentum_combo": ("zscore(roe) + zscore(momentum_60)", "sector"),
    "vix_conditional_momentum": ("trade_when(less(vix, 20), rank(momentum_20))", "market"),
    "yield_curve_reversal": ("when(less(term_spread_10y_2y, 0), rank(reversal_5))", "market"),
    "volume_orthogonal_close": ("vector_neut(rank(close), rank(volume))", "market"),
    "concentrated_top10": ("keep(rank(momentum_60), 10)", "market"),
}

LEAST_COVERAGE = 0.2


class Workspace:
    """A panel with its universes (name -> tickers), benchmark (date, ret), factors and store of saved strategies."""

    def __init__(self, panel: DataFrame, universes: dict[str, tuple[str, ...]] | None = None, benchmark: DataFrame | None = None, factors: DataFrame | None = None, store: Store | None = None):
        self.panel, self.universes, self.benchmark, self.factors, self.store = panel, universes or {}, benchmark, factors, store
        self._coverage: float | None = None
        self._held: list[DataFrame] = []

    def release(self) -> None:
        """Frees what the last simulate() keeps; its tables still work, but are computed anew."""
        while self._held:
            self._held.pop().unpersist()

    # what there is
    def operators(self) -> list[dict]:
        return catalog()

    def fields(self) -> list[dict]:
        return [f | {"loaded": f["name"] in self.panel.columns or FIELDS[f["name"]].build is not None} for f in field_catalog()]

    def examples(self) -> dict[str, tuple[str, str]]:
        return EXAMPLES

    def neutralizations(self) -> list[str]:
        """none, market, and each label level with at least two values."""
        levels = [c for c in LABEL_COLUMNS if c in self.panel.columns]
        if not levels:
            return ["none", "market"]
        counts = self.panel.agg(*[F.countDistinct(c).alias(c) for c in levels]).first()
        return ["none", "market", *[c for c in levels if counts[c] >= 2]]

    def preview(self, ticker: str, rows: int = 30) -> DataFrame:
        return preview(self.panel, ticker, rows)

    # formulas
    def validate(self, formula: str) -> dict:
        """Whether a formula can run: errors, warnings and the fields it names. Nothing is executed but, once, the coverage of the fundamentals."""
        try:
            tree = fold(parse(formula, set(FIELDS)))
            findings = lint(tree)
            check(formula)
            self._gate(tree)
        except ExpressionError as e:
            return {"valid": False, "errors": [str(e)], "warnings": [], "fields": []}
        return {"valid": True, "errors": [], "warnings": [f.message for f in findings if f.severity == "warning"], "fields": sorted(field_names(tree))}

    def _gate(self, tree) -> None:
        used = {n for n in field_names(tree) if FIELDS[n].category == "fundamental"}
        if not used:
            return
        if not set(RAW_FUNDAMENTALS) & set(self.panel.columns):
            raise ExpressionError("the panel has no fundamentals")
        if self._coverage is None:
            self._coverage = fundamentals.coverage(self.panel)
        if self._coverage < LEAST_COVERAGE:
            raise ExpressionError(f"fundamentals cover {self._coverage:.0%} of the panel, less than {LEAST_COVERAGE:.0%}: {', '.join(sorted(used))}")

    def evaluate(self, formula: str) -> DataFrame:
        check(formula)
        return evaluate(self.panel, formula)

    def settings(self, universe: str | None = None, **changes) -> portfolio.Settings:
        return portfolio.Settings(universe=self.universes[universe] if universe else None, **changes)

    # backtests
    def simulate(self, formula: str, settings: portfolio.Settings = portfolio.Settings(), trials: int = 1, size: str | None = None, level: str = "sector") -> dict[str, DataFrame | dict]:
        """All tables of one backtest; each is lazy but for `factors` and `verdict`. Positions and daily results are kept until the next call, or release()."""
        self._gate(check(formula))
        book, days = portfolio.simulate(self.panel, formula, settings)
        self.release()
        book, days = book.persist(), days.persist()
        self._held = [book, days]
        series = signal_quality.ic_series(book, signal_quality.HORIZONS)
        out: dict[str, DataFrame | dict] = {
            "positions": book, "daily": days, "summary": statistics.deflated(performance.summary(days, self.benchmark), trials), "drawdowns": performance.drawdowns(days),
            "drawdown_durations": performance.drawdown_durations(days), "rolling_sharpe": performance.rolling_sharpe(days), "monthly": performance.monthly_returns(days), "yearly": performance.yearly_returns(days),
            "positive_months": performance.positive_months(days), "stress": performance.stress(days, performance.regime_table(days.sparkSession)), "ic": series, "ic_summary": signal_quality.ic_summary(series),
            "ic_bands": signal_quality.ic_bands(series), "alpha_decay": signal_quality.alpha_decay(series), "quantiles": signal_quality.quantile_returns(book), "rank_stability": signal_quality.rank_stability(book),
        }
        if level in self.panel.columns:
            out |= {"exposure": exposure.group_exposure(book, level), "exposure_series": exposure.group_exposure_series(book, level), "attribution": exposure.attribution(book, level)}
        if size:
            sizes = evaluate(self.panel, size, names=["size"])
            out |= {"size_exposure": exposure.size_exposure(book, sizes), "size_distribution": exposure.size_distribution(book, sizes), "size_quality": exposure.size_quality(sizes)}
        if self.factors is not None:
            out["factors"] = statistics.factor_regression(days.where("segment = 'is'"), self.factors) or {}
        out["verdict"] = performance.compare_halves(out["summary"]).first().asDict()
        return out

    def walk_forward(self, formula: str, settings: portfolio.Settings = portfolio.Settings()) -> DataFrame:
        check(formula)
        return portfolio.walk_forward(self.panel, formula, settings)

    def sweep(self, formula: str, settings: portfolio.Settings = portfolio.Settings()) -> DataFrame:
        return batch.sweep(self.panel, formula, settings)

    def compare(self, formulas: list[str], settings: portfolio.Settings = portfolio.Settings()) -> DataFrame:
        if not 2 <= len(formulas) <= 4:
            raise ValueError("2 to 4 formulas can be compared")
        for formula in formulas:
            check(formula)
        return batch.compare(self.panel, formulas, settings)

    def blend(self, formulas: list[str], settings: portfolio.Settings = portfolio.Settings(), **how) -> tuple[list[float], DataFrame, DataFrame]:
        for formula in formulas:
            check(formula)
        return batch.blend(self.panel, formulas, settings, **how)

    def shuffle_test(self, formula: str, settings: portfolio.Settings = portfolio.Settings(), number: int = 50, seed: int = 0) -> dict:
        check(formula)
        return batch.verdict(batch.permutation_runs(self.panel, formula, settings.with_(run_oos=False), number, seed), number)

    # saved strategies
    def save(self, name: str, formula: str, settings: portfolio.Settings = portfolio.Settings(), notes: str | None = None) -> int:
        _, days = portfolio.simulate(self.panel, formula, settings)
        days = days.persist()
        half = performance.summary(days).where("segment = 'is'").first()
        rows = [r.asDict() for r in days.select("segment", "date", "ret").collect()]  # one row per date
        days.unpersist()
        return self.store.save(
            name=name, expression=formula, notes=notes, sharpe=half["sharpe"], annual_return=half["annual_return"], max_drawdown=half["max_drawdown"], turnover=half["avg_turnover"], fitness=half["fitness"],
            result_json=result_json(rows, settings.saved()), code_signature=statistics.code_signature(), data_signature=statistics.data_signature(self.panel).first()["signature"], git_hash=statistics.git_hash(),
        )

    def saved_correlations(self) -> DataFrame:
        return statistics.correlations(self.store.returns())

    def saved_pareto(self) -> DataFrame:
        return statistics.pareto(self.store.rows()).orderBy("turnover")

    def diversification_curve(self, samples: int = 20, seed: int = 0) -> DataFrame:
        pool = self.store.returns()
        ids = sorted(r["id"] for r in pool.select("id").distinct().collect())
        chosen = statistics.subsets(ids, samples=samples, seed=seed) if len(ids) >= 2 else []
        return statistics.diversification(pool, pool.sparkSession.createDataFrame(chosen, "n int, sample int, id long")).orderBy("n")

    def verify(self, id_: int, tolerance: float = 1e-3) -> dict:
        """Runs a saved strategy again with its saved settings: whether its Sharpe ratio and signatures are as they were."""
        row = self.store.get(id_)
        if row is None:
            raise KeyError(f"no strategy {id_}")
        settings = portfolio.Settings.restored(json.loads(row["result_json"] or "{}").get("settings"))
        _, days = portfolio.simulate(self.panel, row["expression"], settings)
        found = performance.summary(days).where("segment = 'is'").first()
        now, saved = found["sharpe"] if found else None, row["sharpe"]
        data = statistics.data_signature(self.panel).first()["signature"]
        same = now is None and saved is None or now is not None and saved is not None and abs(now - saved) <= tolerance
        return {"sharpe_saved": saved, "sharpe_now": now, "matches": same, "same_code": row["code_signature"] == statistics.code_signature(), "same_data": row["data_signature"] == data}
