"""Analytics on series with known answers."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from sigmill.functions import exposure, performance, signal_quality, statistics

DATES = pd.date_range("2020-01-01", periods=300, freq="D").date


def daily(spark, returns, segment="is", book=1e6):
    rows = [(segment, d, r * book, 1.0, 0.0, 0.0, 0.0, r * book - 1.0 + 1.0, float(i), r, 10.0, 60.0, -40.0, 100.0) for i, (d, r) in enumerate(zip(DATES, returns))]
    return spark.createDataFrame(rows, "segment string, date date, gross double, flat double, spread double, impact double, borrow double, net double, cumulative double, ret double, turnover double, long double, short double, gross_exposure double")


def test_summary(spark):
    r = np.random.default_rng(0).normal(0.001, 0.01, 300)
    bench = 0.5 * r + np.random.default_rng(1).normal(0, 0.01, 300)
    table = spark.createDataFrame([(d, float(b)) for d, b in zip(DATES, bench)], "date date, ret double")
    s = performance.summary(daily(spark, r.tolist()), table).first()
    p = pd.Series(r)
    equity = 1 + p.cumsum()
    assert np.isclose(s["sharpe"], p.mean() / p.std() * 252**0.5) and np.isclose(s["total_return"], p.sum()) and np.isclose(s["annual_return"], (1 + p.sum()) ** (252 / 300) - 1)
    assert np.isclose(s["max_drawdown"], (equity / equity.cummax() - 1).min()) and np.isclose(s["sortino_ratio"], p.mean() / p[p < 0].std() * 252**0.5)
    assert np.isclose(s["beta"], np.cov(r, bench)[0, 1] / bench.var(ddof=1)) and np.isclose(s["information_ratio"], (r - bench).mean() / (r - bench).std(ddof=1) * 252**0.5)
    assert np.isclose(s["skew"], p.skew()) and np.isclose(s["kurt"], p.kurt() + 3) and np.isclose(s["tail_ratio"], abs(p.quantile(0.95)) / abs(p.quantile(0.05)))
    assert np.isclose(s["win_rate"], (p > 0).mean()) and np.isclose(s["profit_factor"], p[p > 0].sum() / -p[p < 0].sum())
    assert (s["long_exposure"], s["short_exposure"], s["gross_exposure"], s["net_exposure"]) == (0.6, -0.4, 1.0, 0.2)
    assert np.isclose(s["fitness_wq"], math.sqrt(abs(s["annual_return"]) / 0.125) * s["sharpe"] * (1 if s["annual_return"] >= 0 else -1))


def test_degenerate_series(spark):
    s = performance.summary(daily(spark, [0.0] * 10)).first()
    assert s["sharpe"] == 0 and s["max_drawdown"] == 0 and s["profit_factor"] == 0 and s["calmar_ratio"] == 0
    assert performance.summary(daily(spark, [0.01] * 3 + [0.02])).first()["profit_factor"] is None
    assert performance.summary(daily(spark, [-0.6, -0.6, 0.1])).first()["annual_return"] == 0
    assert performance.summary(daily(spark, [])).count() == 0


@pytest.mark.parametrize(("returns", "expected"), [([0.1, -0.1, -0.1, 0.3, -0.1, 0.2, -0.1], (1.5, 2, 1)), ([0.1, 0.1], (0.0, 0, 0)), ([0.1, -0.1, -0.1], (2.0, 2, 2)), ([-0.1, 0.2], (0.0, 0, 0))])
def test_drawdown_durations(spark, returns, expected):
    r = performance.drawdown_durations(daily(spark, returns)).first()
    assert (r["avg_dd_days"], r["max_dd_days"], r["current_dd_days"]) == expected


def test_rolling_months_and_stress(spark):
    r = np.random.default_rng(2).normal(0, 0.01, 300)
    days = daily(spark, r.tolist())
    got = [x["rolling_sharpe"] for x in performance.rolling_sharpe(days).orderBy("date").collect()]
    p = pd.Series(r)
    assert got[61] is None and np.isclose(got[62], p[:63].mean() / p[:63].std() * 252**0.5)
    months = {(x["year"], x["month"]): x["ret"] for x in performance.monthly_returns(days).collect()}
    assert len(months) == 10 and np.isclose(sum(months.values()), r.sum())
    regimes = performance.regime_table(spark, [("a", "2020-02-01", "2020-03-01"), ("b", "2020-02-01", "2020-02-03"), ("c", "2031-01-01", "2032-01-01")])
    found = performance.stress(days, regimes).collect()
    assert [x["name"] for x in found] == ["a"] and found[0]["n_days"] == 30 and np.isclose(found[0]["total_return"], r[31:61].sum())


def test_compare_halves(spark):
    def compared(a, b):
        rows = [(s, *x, DATES[0], DATES[9]) for s, x in (("is", a), ("oos", b)) if x]
        return performance.compare_halves(spark.createDataFrame(rows, "segment string, sharpe double, annual_return double, start_date date, end_date date")).first()

    for after, severity, flag in ((1.9, "robust", False), (1.3, "moderate", False), (0.9, "high", True), (0.5, "severe", True), (-0.1, "severe", True)):
        got = compared((2.0, 0.5), (after, 0.25))
        assert (got["severity"], got["overfitting_flag"]) == (severity, flag) and np.isclose(got["return_decay"], 0.5) and np.isclose(got["sharpe_decay"], (2 - after) / 2)
    both_lose = compared((-2.0, -0.5), (-1.0, -0.1))  # a smaller loss is a loss all the same
    assert both_lose["severity"] == "severe" and both_lose["overfitting_flag"] and both_lose["sharpe_decay"] == -0.5
    assert compared((0.0, 0.0), (1.0, 0.1))["sharpe_decay"] == 0.0 and compared((1.0, 0.1), None)["severity"] is None


def test_size_quality(spark):
    sizes = lambda *v: spark.createDataFrame([(x,) for x in v], "size double")
    said = [exposure.size_quality(df).first()[0] for df in (sizes(10.0, -9999.0), sizes(10.0, -10_000.0), sizes(None))]
    assert said == [True, False, False]


def book(spark, signal, ret, weight=None):
    rows = []
    for k, d in enumerate(DATES[: len(signal)]):
        for j in range(signal.shape[1]):
            clean = lambda x: None if np.isnan(x) else float(x)
            w = float((weight if weight is not None else np.nan_to_num(signal))[k, j])
            rows.append(("is", d, f"T{j}", j, ["A", "B", None][j % 3], clean(signal[k, j]), w, clean(ret[k, j])))
    return spark.createDataFrame(rows, "segment string, date date, ticker string, ticker_ord int, sector string, signal double, weight double, ret double")


def test_ic_of_a_perfect_signal(spark):
    ret = np.random.default_rng(0).normal(0, 0.01, (40, 12))
    signal = np.vstack([ret[1:], ret[:1]])
    b = book(spark, signal, ret)
    s = signal_quality.ic_summary(signal_quality.ic_series(b, (1, 2))).collect()
    by = {r["horizon"]: r for r in s}
    assert np.isclose(by[1]["ic"], 1) and by[1]["n_days"] == 39 and by[1]["icir"] is None and abs(by[2]["ic"]) < 0.3
    q = {r["quantile"]: r["mean_return"] for r in signal_quality.quantile_returns(b).collect()}
    assert [q[k] for k in range(1, 6)] == sorted(q.values())
    assert abs(signal_quality.rank_stability(b).first()[1]) < 0.3
    same_ranks = np.tile(np.arange(12.0), (40, 1))
    assert np.isclose(signal_quality.rank_stability(book(spark, same_ranks, ret)).first()[1], 1)


def test_alpha_decay_of_planted_half_life(spark):
    rows = [("is", DATES[0], h, 0.2 * math.exp(-h / 5.0)) for h in signal_quality.HORIZONS]
    series = spark.createDataFrame(rows, "segment string, date date, horizon int, ic double")
    r = signal_quality.alpha_decay(series).first()
    assert np.isclose(r["half_life_days"], 5 * math.log(2)) and np.isclose(r["r_squared"], 1)
    grows = spark.createDataFrame([("is", DATES[0], h, 0.01 * h) for h in (1, 2, 3)], "segment string, date date, horizon int, ic double")
    assert signal_quality.alpha_decay(grows).first()["half_life_days"] is None


def test_exposures_and_attribution(spark):
    rng = np.random.default_rng(1)
    weight, ret = rng.normal(size=(20, 12)), rng.normal(0, 0.01, (20, 12))
    b = book(spark, weight, ret, weight)
    found = {r["group"]: r for r in exposure.group_exposure(b).collect()}
    own = {g: [j for j in range(12) if ["A", "B", "Unknown"][j % 3] == g] for g in ("A", "B", "Unknown")}
    for g, cols in own.items():
        assert np.isclose(found[g]["avg_net"], weight[:, cols].sum(axis=1).mean()) and np.isclose(found[g]["avg_gross"], np.abs(weight[:, cols]).sum(axis=1).mean()) and found[g]["n_tickers"] == 4
    parts = {r["group"]: r for r in exposure.attribution(b).collect()}
    for g, cols in own.items():
        allocation = (weight[:, cols].sum(axis=1) * ret[:, cols].mean(axis=1)).sum()
        assert np.isclose(parts[g]["allocation"], allocation) and np.isclose(parts[g]["total"], (weight[:, cols] * ret[:, cols]).sum())
    totals = exposure.attribution_totals(exposure.attribution(b)).first()
    assert np.isclose(totals["allocation_pct"] + totals["selection_pct"], 100) and np.isclose(totals["total_pnl"], (weight * ret).sum())
    sizes = spark.createDataFrame([(d, f"T{j}", float(10.0**j)) for d in DATES[:20] for j in range(12)], "date date, ticker string, size double")
    tilted = np.tile(np.linspace(-1, 1, 12), (20, 1))
    t = book(spark, tilted, ret, tilted)
    assert np.isclose(exposure.size_exposure(t, sizes).first()["avg_corr"], 1)
    tilt = exposure.size_tilt(exposure.size_distribution(t, sizes)).first()
    assert tilt["tilt"] > 3
    head = exposure.headline(exposure.group_exposure(t)).first()
    assert head["max_long_exposure"] >= 0 >= head["max_short_exposure"]
    assert exposure.group_exposure_series(b, most=5).select("date").distinct().count() == 5


def test_deflated_sharpe(spark):
    one = statistics.deflated_sharpe(1.5, 1, 252)
    assert np.isclose(one["p_value"], NormalDist().cdf(1.5 / math.sqrt(252) * math.sqrt(251))) and one["sharpe_threshold_annualized"] == 0
    many = statistics.deflated_sharpe(1.5, 100, 252)
    assert many["p_value"] < one["p_value"] and many["sharpe_threshold_annualized"] > 2
    assert statistics.deflated_sharpe(None, 1, 10) is None and statistics.deflated_sharpe(1.0, 1, 1) is None and statistics.deflated_sharpe(float("nan"), 1, 10) is None
    r = np.random.default_rng(3).normal(0.001, 0.01, 250)
    s = statistics.deflated(performance.summary(daily(spark, r.tolist())), 20).first()
    expected = statistics.deflated_sharpe(s["sharpe"], 20, 250, s["skew"], s["kurt"])
    assert np.isclose(s["deflated_sharpe"], expected["deflated_sharpe_annualized"]) and np.isclose(NormalDist().cdf(s["deflated_z"]), expected["p_value"])


def test_factor_regression_recovers_planted_loadings(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(0, 0.01, (250, 5))
    beta = np.array([1.2, -0.5, 0.3, 0.0, 0.7])
    y = 0.0002 + f @ beta + rng.normal(0, 0.001, 250) + 0.0001
    factors = spark.createDataFrame([(d, *map(float, row), 0.0001) for d, row in zip(DATES, f)], "date date, mkt_rf double, smb double, hml double, rmw double, cma double, rf double")
    got = statistics.factor_regression(daily(spark, y.tolist()), factors)
    x = np.column_stack([np.ones(250), f])
    b, *_ = np.linalg.lstsq(x, y - 0.0001, rcond=None)
    resid = y - 0.0001 - x @ b
    lags = int(4 * (250 / 100) ** (2 / 9))
    u = x * resid[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    errors = np.sqrt(np.diag(inv @ s @ inv))
    loadings = [got["loadings"][n]["beta"] for n in statistics.FACTOR_NAMES]
    assert np.allclose(loadings, b[1:]) and np.allclose(loadings, beta, atol=0.05)
    assert np.allclose([got["loadings"][n]["t_stat"] for n in statistics.FACTOR_NAMES], (b / errors)[1:]) and np.isclose(got["alpha_t_stat"], b[0] / errors[0])
    assert np.isclose(got["r_squared"], 1 - (resid**2).sum() / ((y - y.mean()) ** 2).sum()) and np.isclose(got["factor_share"], (x[:, 1:] @ b[1:]).var() / y.var())
    assert statistics.factor_regression(daily(spark, y[:50].tolist()), factors) is None


def test_blend_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(0.001, [0.005, 0.02, 0.01], (500, 3))
    mean, cov = x.mean(axis=0), np.cov(x.T)
    inverse = statistics.blend_weights("inverse_variance", mean, cov)
    assert np.allclose(inverse, (1 / np.diag(cov)) / (1 / np.diag(cov)).sum())
    parity = statistics.blend_weights("risk_parity", mean, cov)
    share = parity * (cov @ parity)
    assert np.allclose(share / share.sum(), 1 / 3, atol=1e-5)
    best = statistics.blend_weights("mv_optimal", mean, cov)
    assert np.isclose(best.sum(), 1)
    scaled = statistics.blend_weights("mv_optimal", mean, cov, target_vol=0.1)
    assert np.isclose(math.sqrt(scaled @ cov @ scaled * 252), 0.1)
    assert np.allclose(statistics.blend_weights("risk_parity", mean, cov * 0), 1 / 3) and np.allclose(statistics.blend_weights("equal", mean, cov), 1 / 3)
    with pytest.raises(ValueError):
        statistics.blend_weights("x", mean, cov)


def test_pool(spark):
    rng = np.random.default_rng(0)
    series = rng.normal(0.001, 0.01, (200, 4))
    rows = [(j, d, float(series[k, j])) for k, d in enumerate(DATES[:200]) for j in range(4)]
    pool = spark.createDataFrame(rows, "id int, date date, ret double")
    corr = {(r["a"], r["b"]): r["corr"] for r in statistics.correlations(pool).collect()}
    assert np.allclose([[corr[i, j] for j in range(4)] for i in range(4)], np.corrcoef(series.T))
    chosen = statistics.subsets([0, 1, 2, 3], sizes=(1, 2, 8, 9), samples=3)
    assert {n for n, _, _ in chosen} == {1, 2, 4} and len([c for c in chosen if c[0] == 4]) == 4
    assert chosen == statistics.subsets([3, 1, 0, 2], sizes=(9, 2, 1), samples=3) and statistics.subsets([], samples=3) == []
    firsts = [i for n, _, i in statistics.subsets(list(range(10)), sizes=(1,), samples=2000) if n == 1]
    assert all(140 < firsts.count(i) < 260 for i in range(10))
    curve = {r["n"]: r for r in statistics.diversification(pool, spark.createDataFrame(chosen, "n int, sample int, id int")).collect()}
    whole = series.mean(axis=1)
    assert np.isclose(curve[4]["median_sharpe"], whole.mean() / whole.std(ddof=1) * 252**0.5) and curve[2]["n_samples"] == 3


def test_pareto(spark):
    rows = [(1, 1.0, 5.0), (2, 2.0, 6.0), (3, 0.5, 5.0), (4, 2.0, 7.0), (5, -1.0, 1.0), (6, 1.0, 5.0), (7, None, 2.0), (8, 0.1, 0.5), (9, 3.0, None)]
    table = spark.createDataFrame(rows, "id int, sharpe double, turnover double")
    got = {r["id"]: (r["on_frontier"], r["dominated_by"]) for r in statistics.pareto(table).collect()}
    assert got == {1: (True, None), 6: (True, None), 2: (True, None), 3: (False, 1), 4: (False, 2), 5: (False, None), 7: (False, None), 8: (True, None), 9: (False, None)}
    every = {r["id"]: r["dominated_by"] for r in statistics.dominators(table).collect()}
    assert every == {1: [], 2: [], 3: [1, 6], 4: [2], 5: [], 6: [], 7: [], 8: [], 9: []}
    named = spark.createDataFrame([("b", 1.0, 5.0, "kept"), ("a", 0.5, 6.0, "too")], "id string, sharpe double, turnover double, note string")
    assert sorted(map(tuple, statistics.pareto(named).collect())) == [("a", 0.5, 6.0, "too", False, "b"), ("b", 1.0, 5.0, "kept", True, None)]


def test_provenance(spark):
    assert len(statistics.code_signature()) == 12 and statistics.code_signature() == statistics.code_signature()
    a = spark.createDataFrame([(DATES[0], "A", 1.0), (DATES[1], "B", 2.0)], "date date, ticker string, close double")
    sign = lambda df: statistics.data_signature(df).first()[0]
    assert sign(a) == sign(a.orderBy("ticker", ascending=False)) and sign(a) != sign(a.limit(1)) and len(sign(a.limit(0))) == 16
