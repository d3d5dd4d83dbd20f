"""Every function against pandas or numpy on a panel with nulls, ties, a constant stretch and an empty date."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigmill.plans.compiler import evaluate
from sigmill.plans.syntax import ExpressionError

from .panels import SECTORS, long, matrix, same, wide

W = wide()
C, V, R, H = W["close"], W["volume"], W["returns"], W["high"]


@pytest.fixture(scope="module")
def panel(spark):
    return long(spark, W).persist()


def roll(x, d):
    return x.rolling(d, min_periods=d)


def weights(x, w):
    return x.rolling(len(w), min_periods=len(w)).apply(lambda a: a @ np.array(w) / sum(w), raw=True)


def across(f, x, y=None):
    """f of each row, to all cells."""
    rows = [f(x.iloc[k].dropna()) if y is None else f(x.iloc[k], y.iloc[k]) for k in range(len(x))]
    return pd.DataFrame({c: rows for c in x.columns}, index=x.index).astype(float)


def row_corr(a, b):
    both = a.notna() & b.notna()
    a, b = a[both], b[both]
    return np.nan if both.sum() < 2 or a.std() < 1e-9 or b.std() < 1e-9 else np.corrcoef(a, b)[0, 1]


def roll_corr(x, y, d):
    out = pd.DataFrame(np.nan, index=x.index, columns=x.columns)
    for c in x.columns:
        for k in range(d - 1, len(x)):
            a, b = x[c].iloc[k - d + 1 : k + 1], y[c].iloc[k - d + 1 : k + 1]
            if a.notna().all() and b.notna().all():
                out.at[x.index[k], c] = row_corr(a, b)
    return out


def grouped(f, x):
    out = pd.DataFrame(np.nan, index=x.index, columns=x.columns)
    for label in {s for s in SECTORS if s}:
        own = [c for c, s in zip(x.columns, SECTORS) if s == label]
        out[own] = f(x[own])
    return out


def spread(frame, row):
    return pd.DataFrame({c: row for c in frame.columns}, index=frame.index)


def hump(x, t):
    out = x.copy()
    for c in x.columns:
        last = np.nan
        for k in range(len(x)):
            v = x[c].iloc[k]
            if not np.isnan(v) and (np.isnan(last) or abs(v - last) > t):
                last = v
            out.iat[k, list(x.columns).index(c)] = last
    return out


def since_change(x):
    out = pd.DataFrame(0.0, index=x.index, columns=x.columns)
    for c in x.columns:
        run = 0
        for k in range(1, len(x)):
            run = run + 1 if x[c].iloc[k] == x[c].iloc[k - 1] else 0
            out.iat[k, list(x.columns).index(c)] = run
    return out


def trade(cond, x, leave):
    out = x.copy()
    for j, c in enumerate(x.columns):
        held = np.nan
        for k in range(len(x)):
            if leave[c].iloc[k]:
                held = np.nan
            elif cond[c].iloc[k]:
                held = x[c].iloc[k]
            out.iat[k, j] = held
    return out


def keep(row, n):
    order = np.argsort(-row.abs().to_numpy(), kind="stable")[: min(n, row.notna().sum())]
    out = pd.Series(0.0, index=row.index)
    out.iloc[order] = row.iloc[order]
    return out


def bucket(row, n):
    place = row.rank(method="first") - 1
    return np.minimum(np.floor(place * n / row.count()), n - 1)


CASES = {
    "ts_mean(close, 5)": lambda: roll(C, 5).mean(),
    "ts_std(volume, 5)": lambda: roll(V, 5).std(),
    "ts_min(close, 5)": lambda: roll(C, 5).min(),
    "ts_max(close, 5)": lambda: roll(C, 5).max(),
    "ts_sum(close, 5)": lambda: roll(C, 5).sum(),
    "ts_median(close, 4)": lambda: roll(C, 4).median(),
    "ts_quantile(close, 5, 0.2)": lambda: roll(C, 5).quantile(0.2),
    "ts_product(close / 100, 3)": lambda: roll(C / 100, 3).apply(np.prod, raw=True),
    "ts_rank(volume, 5)": lambda: roll(V, 5).rank(pct=True),
    "ts_arg_max(volume, 5)": lambda: roll(V, 5).apply(lambda a: 4 - np.argmax(a), raw=True),
    "ts_arg_min(volume, 5)": lambda: roll(V, 5).apply(lambda a: 4 - np.argmin(a), raw=True),
    "delta(close, 3)": lambda: C - C.shift(3),
    "delay(close, 3)": lambda: C.shift(3),
    "ts_returns(close, 3)": lambda: C / C.shift(3) - 1,
    "decay_linear(close, 4)": lambda: weights(C, [1, 2, 3, 4]),
    "decay_linear(close, 10)": lambda: weights(C, list(range(1, 11))),
    "ts_decay_exp(close, 4, 0.5)": lambda: weights(C, [0.125, 0.25, 0.5, 1]),
    "ts_corr(close, volume, 6)": lambda: roll_corr(C, V, 6),
    "ts_cov(close, volume, 6)": lambda: roll(C, 6).cov(V).where(roll(C + V, 6).count() == 6),
    "ts_zscore(close, 5)": lambda: (C - roll(C, 5).mean()) / roll(C, 5).std().where(lambda s: s > 1e-6),
    "ts_min_max_diff(close, 5)": lambda: roll(C, 5).max() - roll(C, 5).min(),
    "days_from_last_change(volume)": lambda: since_change(V),
    "hump(close, 2)": lambda: hump(C, 2),
    "adv(4)": lambda: roll(C * V, 4).mean(),
    "rank(volume)": lambda: V.rank(axis=1, pct=True),
    "zscore(close)": lambda: C.sub(C.mean(axis=1), axis=0).div(C.std(axis=1), axis=0),
    "demean(close)": lambda: C.sub(C.mean(axis=1), axis=0),
    "scale(delta(close, 1))": lambda: (C - C.shift(1)).div((C - C.shift(1)).abs().sum(axis=1).replace(0, np.nan), axis=0),
    "normalize(close)": lambda: C.sub(C.mean(axis=1), axis=0).div(C.sub(C.mean(axis=1), axis=0).abs().sum(axis=1).replace(0, np.nan), axis=0),
    "winsorize(close, 1)": lambda: C.clip(C.mean(axis=1) - C.std(axis=1), C.mean(axis=1) + C.std(axis=1), axis=0),
    "quantile(close, 0.3)": lambda: across(lambda r: r.quantile(0.3) if len(r) else np.nan, C),
    "vector_neut(close, volume)": lambda: C - V.mul((C * V).sum(axis=1).div((V * V).sum(axis=1)).where((C * V).notna().any(axis=1)), axis=0),
    "correlation(close, volume)": lambda: across(row_corr, C, V),
    "bucket(volume, 3)": lambda: V.apply(lambda r: bucket(r, 3), axis=1),
    "tail(close, 90, 105, -1)": lambda: C.where((C >= 90) & (C <= 105), -1),
    "kth_element(close, 2)": lambda: across(lambda r: np.sort(r)[1] if len(r) > 1 else np.nan, C),
    "kth_element(close, -1)": lambda: across(lambda r: np.sort(r)[-1] if len(r) else np.nan, C),
    "kth_element(close, 0)": lambda: C * np.nan,
    "harmonic_mean(close)": lambda: across(lambda r: len(r) / (1 / r).sum() if len(r) else np.nan, C),
    "geometric_mean(close)": lambda: across(lambda r: np.exp(np.log(r).mean()) if len(r) else np.nan, C),
    "step(volume)": lambda: V.apply(lambda r: (r.rank() - (r.count() + 1) / 2) / ((r.count() - 1) / 2 or np.nan), axis=1),
    "keep(returns, 2)": lambda: R.apply(lambda r: keep(r, 2), axis=1),
    "group_rank(volume, sector)": lambda: grouped(lambda x: x.rank(axis=1, pct=True), V),
    "group_neutralize(close, sector)": lambda: grouped(lambda x: x.sub(x.mean(axis=1), axis=0), C),
    "neutralize(close, industry)": lambda: grouped(lambda x: x.sub(x.mean(axis=1), axis=0), C),
    "group_mean(close, sector)": lambda: grouped(lambda x: spread(x, x.mean(axis=1)), C),
    "group_sum(close, sector)": lambda: grouped(lambda x: spread(x, x.sum(axis=1)), C),
    "group_count(close, sector)": lambda: grouped(lambda x: spread(x, x.count(axis=1)), C),
    "group_max(close, sector)": lambda: grouped(lambda x: spread(x, x.max(axis=1)), C),
    "group_min(close, sector)": lambda: grouped(lambda x: spread(x, x.min(axis=1)), C),
    "group_scale(close, sector)": lambda: grouped(lambda x: x.div(x.abs().sum(axis=1).replace(0, np.nan), axis=0), C),
    "abs(delta(close, 1))": lambda: C.diff().abs(),
    "sign(delta(close, 1))": lambda: np.sign(C.diff()),
    "log(delta(close, 1))": lambda: np.log(C.diff().where(C.diff() > 0)),
    "sqrt(delta(close, 1))": lambda: np.sqrt(C.diff().where(C.diff() >= 0)),
    "power(delta(close, 1), 2)": lambda: C.diff() ** 2,
    "signed_power(delta(close, 1), 0.5)": lambda: np.sign(C.diff()) * C.diff().abs() ** 0.5,
    "sigmoid(delta(close, 1))": lambda: 1 / (1 + np.exp(-C.diff())),
    "mod(delta(close, 1), -3)": lambda: np.mod(C.diff(), -3),
    "max(close, volume)": lambda: pd.DataFrame(np.maximum(C, V), index=C.index, columns=C.columns),
    "min(close, volume)": lambda: pd.DataFrame(np.minimum(C, V), index=C.index, columns=C.columns),
    "clip(close, 90, 105)": lambda: C.clip(90, 105),
    "clip(close, 90)": lambda: C.clip(lower=90),
    "replace(close, 50, 1)": lambda: C.replace(50.0, 1.0),
    "isnan(close)": lambda: C.isna().astype(float),
    "pasteurize(close)": lambda: C.fillna(0),
    "equal(volume, 200)": lambda: (V == 200).astype(float),
    "not_equal(volume, 200)": lambda: (V != 200).astype(float),
    "less(close, volume)": lambda: (C < V).astype(float),
    "greater(close, volume)": lambda: (C > V).astype(float),
    "less_eq(close, volume)": lambda: (C <= V).astype(float),
    "greater_eq(close, volume)": lambda: (C >= V).astype(float),
    "if_else(volume - 200, close, 1)": lambda: C.where(V != 200, 1.0),
    "where(greater(close, 95), close, -close)": lambda: C.where(C > 95, -C),
    "when(greater(close, 95), close)": lambda: C.where(C > 95),
    "mask(close, greater(close, 95))": lambda: C.where(~(C > 95)),
    "trade_when(greater(close, 100), volume, less(close, 95))": lambda: trade(C > 100, V, C < 95),
    "trade_when(greater(close, 100), volume)": lambda: trade(C > 100, V, C != C.where(C.isna(), C)),
    "close / (volume - 200)": lambda: C / (V - 200).replace(0, np.nan),
    "-close + 2 * volume - 1": lambda: -C + 2 * V - 1,
}


@pytest.mark.parametrize("formula", CASES)
def test_against_pandas(panel, formula):
    if formula == "trade_when(greater(close, 100), volume)":
        expected = trade(C > 100, V, pd.DataFrame(False, index=C.index, columns=C.columns))
    else:
        expected = CASES[formula]()
    same(matrix(evaluate(panel, formula)), expected)


def test_moments_of_constant_windows(panel):
    for formula, value in (("ts_skewness(close, 5)", 0.0), ("ts_kurtosis(close, 5)", -3.0)):
        got = matrix(evaluate(panel, formula))["T1"].iloc[14:18].dropna()
        window = roll(C, 5).count()["T1"].iloc[14:18]
        assert (got == value).all() and len(got) == (window == 5).sum()
    for formula, f in (("ts_skewness(volume, 7)", "skew"), ("ts_kurtosis(volume, 7)", "kurt")):
        expected = getattr(roll(V, 7), f)()
        got = matrix(evaluate(panel, formula))
        varies = roll(V, 7).std() > 0
        same(got.where(varies), expected.where(varies))
    assert matrix(evaluate(panel, "ts_skewness(close, 2)")).isna().all().all() and matrix(evaluate(panel, "ts_std(close, 1)")).isna().all().all()


def test_ts_partial_corr_and_regression(panel):
    xy, xz, yz = roll_corr(C, V, 8), roll_corr(C, R, 8), roll_corr(V, R, 8)
    same(matrix(evaluate(panel, "ts_partial_corr(close, volume, returns, 8)")), (xy - xz * yz) / np.sqrt(((1 - xz**2) * (1 - yz**2)).clip(lower=1e-12)), 1e-6)
    var = roll(V, 6).var()
    expected = (roll(C, 6).cov(V).where(roll(C + V, 6).count() == 6) / var.where(var > 0))
    same(matrix(evaluate(panel, "ts_regression(close, volume, 6)")), expected)


def test_regression_neut(panel):
    a, b = C.sub(C.mean(axis=1), axis=0), V.sub(V.mean(axis=1), axis=0)
    share = (a * b).sum(axis=1, min_count=1).div((b * b).sum(axis=1).replace(0, np.nan))
    same(matrix(evaluate(panel, "regression_neut(close, volume)")), a - b.mul(share, axis=0))


def test_group_zscore_and_normalize(panel):
    z = grouped(lambda x: x.sub(x.mean(axis=1), axis=0).div(x.std(axis=1).where(lambda s: s > 1e-9), axis=0), C)
    same(matrix(evaluate(panel, "group_zscore(close, sector)")), z)
    n = grouped(lambda x: x.sub(x.mean(axis=1), axis=0).div(x.sub(x.mean(axis=1), axis=0).abs().sum(axis=1).replace(0, np.nan), axis=0), C)
    same(matrix(evaluate(panel, "group_normalize(close, sector)")), n)


@pytest.mark.parametrize("bad", ["5", "1 + 2", "clip(close, 5, 1)", "winsorize(close, 0)", "quantile(close, 2)", "bucket(close, 1)", "keep(close, 0)", "ts_quantile(close, 3, 2)", "ts_decay_exp(close, 3, 0)", "ts_rank(close, 0)", "roe", "sector", "ts_mean(close, 2.5)"])
def test_bad_arguments(panel, bad):
    with pytest.raises(ExpressionError):
        evaluate(panel, bad)


@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=4, max_size=4), min_size=3, max_size=8))
@settings(max_examples=8, deadline=None)
def test_properties(spark, rows):
    columns = [f"T{k}" for k in range(4)]
    x = pd.DataFrame(rows, index=pd.date_range("2020-01-01", periods=len(rows)).date, columns=columns, dtype=float)
    panel = long(spark, {"close": x})
    out = evaluate(panel, "rank(close)", "delay(delay(close, 1), 1) - delay(close, 2)", "ts_mean(close, 2)", "demean(close)", names=["r", "d", "m", "c"]).persist()
    rank = matrix(out, "r")
    same(rank, x.rank(axis=1, pct=True))
    assert ((rank > 0) & (rank <= 1) | rank.isna()).all().all() and (matrix(out, "d").fillna(0) == 0).all().all()
    same(matrix(out, "m"), roll(x, 2).mean())
    assert matrix(out, "c").sum(axis=1).abs().max() < 1e-9
    out.unpersist()


def test_equal_subtrees_and_windows_are_shared(panel):
    once = evaluate(panel, "rank(delta(close, 5)) + rank(delta(close, 5)) * 2")._jdf.queryExecution().executedPlan().toString()
    single = evaluate(panel, "rank(delta(close, 5))")._jdf.queryExecution().executedPlan().toString()
    assert once.count("Window [") == single.count("Window [")
    three = evaluate(panel, "ts_mean(close, 5) + ts_max(volume, 3) + ts_std(high, 7)")._jdf.queryExecution().executedPlan().toString()
    assert three.count("Exchange hashpartitioning") <= 1


def test_segments_restart(spark):
    from pyspark.sql import functions as F

    panel = long(spark, W).withColumn("half", F.when(F.col("date") < F.lit("2020-01-21").cast("date"), 1).otherwise(2))
    got = evaluate(panel, "delay(close, 1)", segments=("half",)).where("date = '2020-01-21'")
    assert got.where("value is not null").count() == 0


def test_one_ticker_of_many_rows_and_one_date_of_many_tickers(spark):
    """hump carries one value down a history of 100,000 rows; kth_element ranks 20,000 tickers without collecting them."""
    date = F.expr("date_add(date'1800-01-01', cast(id as int))")
    long = spark.range(100_000).select(date.alias("date"), F.lit("A").alias("ticker"), F.lit(1).alias("ticker_ord"), (F.col("id") % 7).cast("double").alias("close"))
    out = evaluate(long, "hump(close, 3)").toPandas().sort_values("date")["value"].tolist()
    last, expected = None, []
    for k in range(100_000):
        last = float(k % 7) if last is None or abs(k % 7 - last) > 3 else last
        expected.append(last)
    assert out == expected
    wide = spark.range(20_000).select(F.lit("2020-01-01").cast("date").alias("date"), F.concat(F.lit("T"), "id").alias("ticker"), F.col("id").cast("int").alias("ticker_ord"), F.col("id").cast("double").alias("close"))
    plan = evaluate(wide, "kth_element(close, -3)")
    assert plan.agg(F.min("value"), F.max("value")).first() == (19_997.0, 19_997.0) and "collect_list" not in plan._jdf.queryExecution().toString()
