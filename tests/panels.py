"""Small panels and independent pandas computations to hold the engine against."""

import numpy as np
import pandas as pd

DATES, TICKERS = 40, 6
SECTORS = ["Tech", "Tech", "Energy", "Energy", None, "Solo"]


def wide(seed=0, missing=0.08):
    """Field matrices date x ticker with planted nulls, ties, a constant stretch and an empty date."""
    rng = np.random.default_rng(seed)
    index, columns = pd.date_range("2020-01-01", periods=DATES).date, [f"T{k}" for k in range(TICKERS)]
    frame = lambda values: pd.DataFrame(values, index=index, columns=columns, dtype=float)
    close = frame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (DATES, TICKERS)), axis=0)).round(1))
    close.iloc[10:18, 1] = 50.0
    close = close.mask(rng.random((DATES, TICKERS)) < missing)
    close.iloc[25] = np.nan
    volume = frame(rng.integers(1, 6, (DATES, TICKERS)) * 100.0).mask(rng.random((DATES, TICKERS)) < missing)
    high, low = close * 1.02 + 1, close * 0.98 - 1
    return {"open": close.shift(1).fillna(100.0), "high": high, "low": low, "close": close, "volume": volume, "returns": close.ffill().pct_change(), "vwap": (high + low + close) / 3}


def long(spark, fields, sectors=SECTORS):
    """The dense panel of field matrices."""
    first = fields["close"]
    rows = []
    for k, ticker in enumerate(first.columns):
        for date in first.index:
            values = [float(f.at[date, ticker]) if pd.notna(f.at[date, ticker]) else None for f in fields.values()]
            rows.append((date, ticker, k + 1, *values, sectors[k], sectors[k], sectors[k], sectors[k]))
    columns = ", ".join(f"{n} double" for n in fields)
    return spark.createDataFrame(rows, f"date date, ticker string, ticker_ord int, {columns}, sector string, industry_group string, industry string, sub_industry string")


def matrix(df, value="value"):
    """A result as a matrix."""
    p = df.select("date", "ticker", value).toPandas()
    return p.pivot(index="date", columns="ticker", values=value).astype(float)


def same(got, expected, tolerance=1e-9):
    expected = expected.reindex(index=got.index, columns=got.columns).astype(float)
    assert (got.isna() == expected.isna()).all().all(), (got.isna() != expected.isna()).sum().sum()
    assert np.nanmax(np.abs((got - expected).to_numpy()) / np.maximum(1, np.abs(expected.to_numpy())), initial=0) < tolerance
