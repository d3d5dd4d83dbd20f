"""Portfolio plans against a plain pandas simulation, and their invariants."""

import math

import numpy as np
import pandas as pd
import pytest

from sigmill.functions import performance
from sigmill.plans import batch, portfolio
from sigmill.plans.portfolio import Settings

from .panels import SECTORS, long, matrix, same, wide

W = wide(seed=4, missing=0.03)
FREE = {"transaction_cost_bps": 0.0, "run_oos": False, "truncation": 1.0}


@pytest.fixture(scope="module")
def panel(spark):
    return long(spark, W).persist()


def simulated(alpha, s: Settings):
    """Net profit per date of one segment."""
    alpha = alpha[alpha.notna().sum(axis=1) >= 0.5 * alpha.shape[1]]
    if s.decay:
        w = np.arange(1, s.decay + 1)
        alpha = alpha.rolling(s.decay, min_periods=s.decay).apply(lambda a: a @ w / w.sum(), raw=True)
    if s.neutralization == "market":
        alpha = alpha.sub(alpha.mean(axis=1), axis=0)
    elif s.neutralization == "sector":
        groups = pd.Series([x or "Unknown" for x in SECTORS], index=alpha.columns)
        alpha = alpha.T.groupby(groups).transform(lambda x: x - x.mean()).T
    weight = alpha.div(alpha.abs().sum(axis=1).replace(0, np.nan), axis=0).fillna(0).clip(-s.truncation, s.truncation)
    position = weight * s.booksize
    returns = W["returns"].reindex(position.index)
    gross = (position.shift(s.execution_lag) * returns).sum(axis=1)
    trade = position.diff().abs()
    cost = trade.sum(axis=1) * s.transaction_cost_bps / 1e4
    if s.spread_model == "flat":
        cost += trade.sum(axis=1) * s.half_spread_bps / 1e4
    cost += (-position.shift(1)).clip(lower=0).sum(axis=1) * s.borrow_cost_bps_annual / (1e4 * 252)
    return position, gross - cost


def net(days):
    p = days.select("segment", "date", "net").toPandas().sort_values("date")
    return p.set_index("date")["net"]


@pytest.mark.parametrize(
    "settings",
    [
        Settings(**FREE), Settings(run_oos=False), Settings(run_oos=False, neutralization="none", execution_lag=3), Settings(run_oos=False, neutralization="sector", truncation=0.2), Settings(run_oos=False, decay=4),
        Settings(run_oos=False, spread_model="flat", borrow_cost_bps_annual=80.0),
    ],
)
def test_against_pandas(panel, settings):
    book, days = portfolio.simulate(panel, "close - ts_mean(close, 2)", settings)
    alpha = W["close"] - W["close"].rolling(2, min_periods=2).mean()
    position, profit = simulated(alpha, settings)
    same(matrix(book, "position"), position, 1e-7)
    got = net(days)
    assert list(got.index) == list(profit.index) and np.allclose(got, profit, rtol=1e-9, atol=1e-4)


def test_halves_and_cumulative(panel):
    _, days = portfolio.simulate(panel, "close", Settings())
    rows = days.toPandas().sort_values("date")
    n = len(rows)
    assert (rows["segment"] == "is").sum() == math.floor(n * (1 - 0.3))
    for _, part in rows.groupby("segment"):
        assert np.allclose(part["net"].cumsum(), part["cumulative"]) and part["turnover"].iloc[0] == 0
    assert rows["date"].iloc[0] < rows["date"].iloc[-1] and "2020-01-26" not in rows["date"].astype(str).tolist()  # the empty date goes


def test_constant_signal_is_flat(panel):
    _, days = portfolio.simulate(panel, "close * 0 + 1", Settings())
    assert days.selectExpr("max(abs(net)) + max(turnover)").first()[0] == 0


def test_dates_universe_and_errors(panel):
    _, days = portfolio.simulate(panel, "ts_mean(close, 3)", Settings(start_date="2020-01-10", end_date="2020-01-20", universe=("T0", "T1", "T2"), run_oos=False))
    dates = sorted(str(r["date"]) for r in days.select("date").collect())
    assert dates[0] == "2020-01-10" and dates[-1] == "2020-01-20"  # the mean looks back before the first date
    for bad in ({"neutralization": "x"}, {"cost_model": "x"}, {"spread_model": "x"}, {"pit_mask": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_liquidity_and_inclusion(spark, panel):
    book, _ = portfolio.simulate(panel, "close", Settings(min_adv_dollars=1e12, run_oos=False))
    assert book.selectExpr("max(abs(weight))").first()[0] == 0
    late = spark.createDataFrame([("T2", "2020-01-15")], "ticker string, d string").selectExpr("ticker", "to_date(d) AS join_date")
    for mask, empty in (("null", True), ("zero", False)):
        book, _ = portfolio.simulate(panel, "close", Settings(run_oos=False, pit_mask=mask), late)
        early = book.where("ticker = 'T2' and date < '2020-01-15'")
        assert (early.where("weight != 0").count() == 0) == empty
        assert book.where("ticker = 'T2' and date >= '2020-01-15' and weight != 0").count() > 0


def test_impact_grows_with_book(panel):
    costs = [portfolio.simulate(panel, "close", Settings(cost_model="sqrt_impact", booksize=b, run_oos=False))[1].selectExpr("sum(impact) / sum(turnover)").first()[0] for b in (1e6, 1e8)]
    assert 0 < costs[0] < costs[1]


def test_walk_forward_is_many_backtests(panel):
    settings = Settings(walk_forward_train=12, walk_forward_test=6, walk_forward_step=7)
    got = portfolio.walk_forward(panel, "delta(close, 1)", settings).toPandas().sort_values("window")
    alpha = W["close"].diff()
    alpha = alpha[alpha.notna().sum(axis=1) >= 0.5 * alpha.shape[1]]
    starts = list(range(0, len(alpha) - 18 + 1, 7))
    assert got["window"].tolist() == list(range(len(starts)))
    for (_, row), start in zip(got.iterrows(), starts):
        assert (row["train_start"], row["test_end"]) == (alpha.index[start], alpha.index[start + 17])
        _, profit = simulated(alpha.iloc[start + 12 : start + 18], Settings(run_oos=False))
        assert np.isclose(row["test_cumulative_pnl"], profit.sum()) and np.isclose(row["test_sharpe"], profit.mean() / profit.std() * 252**0.5)
    assert portfolio.walk_forward(panel, "delta(close, 1)", Settings()).count() == 0


def test_batches_are_single_runs(panel):
    formulas = ["close", "-rank(volume)", "delta(close, 2)"]
    found = {(r["cell"], r["segment"]): r["sharpe"] for r in batch.compare(panel, formulas).collect()}
    for k, formula in enumerate(formulas):
        for r in performance.summary(portfolio.simulate(panel, formula)[1]).collect():
            assert np.isclose(found[k, r["segment"]], r["sharpe"])
    swept = batch.sweep(panel, "delta(close, {0..3}) * {1..2}").collect()
    assert len(swept) == 8 and [r["sharpe"] for r in swept] == sorted((r["sharpe"] for r in swept), reverse=True)
    broken = batch.sweep(panel, "ts_mean(close, {0..2})").collect()
    assert sum(r["error"] is not None for r in broken) == 1 and broken[-1]["sharpe"] is None


def test_blend_weights(panel):
    weights, book, days = batch.blend(panel, ["close", "-rank(volume)"], weights=[3.0, -1.0])
    assert weights == [0.75, -0.25]
    _, alone = portfolio.simulate(panel, "if_else(isnan(close) * isnan(volume), close, pasteurize(close) * 0.75 + pasteurize(rank(volume)) * 0.25)")
    assert np.allclose(net(days), net(alone))
    weights, *_ = batch.blend(panel, ["close", "-rank(volume)"], method="inverse_variance")
    assert np.isclose(sum(weights), 1) and min(weights) > 0


def test_permutations(panel):
    runs = batch.permutation_runs(panel, "delta(close, 1)", Settings(run_oos=False), number=6, seed=3)
    found = {r["iteration"]: r["sharpe"] for r in runs.collect()}
    assert set(found) == set(range(-1, 6))
    days = portfolio.simulate(panel, "delta(close, 1)", Settings(run_oos=False))[1]
    assert np.isclose(found[-1], performance.summary(days).first()["sharpe"])
    said = batch.verdict(runs)
    assert said["n_completed"] == 6 and 0 < said["p_value"] <= 1 and said["verdict"] in ("real-signal", "leakage-suspected", "borderline", "indistinguishable-from-noise")
    assert batch.verdict(runs.where("iteration < 3"))["verdict"] == "too-few-shuffles-completed"
    assert batch.verdict(runs.where("iteration >= 0"))["verdict"] == "real-backtest-failed"
