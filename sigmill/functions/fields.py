"""The fields of the language: base columns of the panel, and fields derived from them when a formula names them.

Derived fields are builders over the compiler's context, so a formula pays for those alone that it names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log as ln

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("sector", "industry_group", "industry", "sub_industry")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    category: str
    doc: str
    build: Callable[..., Column] | None = None  # None: a column of the panel
    kind: str = "number"


FIELDS: dict[str, FieldSpec] = {}


def _base(category: str, names: dict[str, str], kind: str = "number") -> None:
    for name, doc in names.items():
        FIELDS[name] = FieldSpec(name, category, doc, None, kind)


def _derived(category: str, name: str, doc: str, build: Callable[..., Column]) -> None:
    FIELDS[name] = FieldSpec(name, category, doc, build)


def names() -> list[str]:
    return list(FIELDS)


# --- building blocks over a context c -----------------------------------------------------------------------------------
def _lag(c, x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(c.history())


def _mean(c, x: Column, n: int) -> Column:
    return c.full(x, n, F.avg(x).over(c.rows(n)))


def _sum(c, x: Column, n: int) -> Column:
    return c.full(x, n, F.sum(x).over(c.rows(n)))


def _call(c, name: str, *args) -> Column:
    return c.functions[name].build(c, *args)


def _all(*columns: Column) -> Callable[[Column], Column]:
    test = columns[0].isNotNull()
    for x in columns[1:]:
        test = test & x.isNotNull()
    return lambda value: F.when(test, value)


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


_base("price", {"open": "first price", "high": "highest price", "low": "lowest price", "close": "last price", "volume": "units traded", "returns": "change of close against the ticker's own row before", "vwap": "mean of high, low and close"})
_base("label", {"sector": "widest group", "industry_group": "second group", "industry": "third group", "sub_industry": "narrowest group"}, "label")

_d = lambda name, doc, build: _derived("price", name, doc, build)
_d("median_price", "mean of high and low", lambda c: (c.field("high") + c.field("low")) / 2)
_d("weighted_close", "mean of high, low and twice close", lambda c: (c.field("high") + c.field("low") + 2 * c.field("close")) / 4)
_d("range_", "high less low", lambda c: c.field("high") - c.field("low"))
_d("body", "size of close less open", lambda c: F.abs(c.field("close") - c.field("open")))
_d("upper_shadow", "high above the body", lambda c: _all(c.field("open"), c.field("close"))(c.field("high") - F.greatest(c.field("open"), c.field("close"))))
_d("lower_shadow", "low below the body", lambda c: _all(c.field("open"), c.field("close"))(F.least(c.field("open"), c.field("close")) - c.field("low")))
_d("gap", "open less the close before", lambda c: c.field("open") - _lag(c, c.field("close")))
_d("high_low_ratio", "high by low", lambda c: F.try_divide(c.field("high"), c.field("low")))
_d("body_to_range", "body by range", lambda c: F.try_divide(c.field("body"), _nonzero(c.field("range_"))))

_d = lambda name, doc, build: _derived("return", name, doc, build)
_d("log_returns", "logarithm of close by the close before", lambda c: F.ln(F.try_divide(c.field("close"), _lag(c, c.field("close")))))
_d("abs_returns", "size of returns", lambda c: F.abs(c.field("returns")))
_d("intraday_return", "close against open", lambda c: F.try_divide(c.field("close") - c.field("open"), c.field("open")))
_d("overnight_return", "open against the close before", lambda c: F.try_divide(c.field("open") - _lag(c, c.field("close")), _lag(c, c.field("close"))))
for _n in (3, 5, 10, 20, 60, 120, 252):
    _d(f"momentum_{_n}", f"change of close over {_n} rows", lambda c, n=_n: F.try_divide(c.field("close"), _lag(c, c.field("close"), n)) - 1)
for _n in (5, 20):
    _d(f"reversal_{_n}", f"momentum_{_n} with its sign turned", lambda c, n=_n: -c.field(f"momentum_{n}"))
_d("close_to_high_252", "close by the highest close of 252 rows", lambda c: F.try_divide(c.field("close"), c.full(c.field("close"), 252, F.max(c.field("close")).over(c.rows(252)))))
_d("momentum_z_60", "momentum_60 by realized_vol_60", lambda c: F.try_divide(c.field("momentum_60"), _nonzero(c.field("realized_vol_60"))))

_d = lambda name, doc, build: _derived("volume", name, doc, build)
_d("signed_volume", "volume with the sign of returns", lambda c: c.field("volume") * F.signum(c.field("returns")))
_d("dollar_volume", "close times volume", lambda c: c.field("close") * c.field("volume"))
_d("adv20", "mean volume of 20 rows", lambda c: _mean(c, c.field("volume"), 20))
_d("volume_ratio", "volume by adv20", lambda c: F.try_divide(c.field("volume"), c.field("adv20")))
_d("turnover_ratio", "volume by its mean of 60 rows", lambda c: F.try_divide(c.field("volume"), _mean(c, c.field("volume"), 60)))
for _name, _test in (("up_volume_ratio", lambda r: r > 0), ("down_volume_ratio", lambda r: r < 0)):
    _d(_name, "share of 20 rows' volume on " + ("rises" if "up" in _name else "falls"), lambda c, test=_test: F.try_divide(_sum(c, c.settle(F.when(test(c.field("returns")), c.field("volume")).otherwise(F.lit(0.0))), 20), _sum(c, c.field("volume"), 20)))
_d("vpin_proxy", "size of signed volume by volume over 20 rows", lambda c: F.try_divide(_sum(c, c.settle(F.abs(c.field("signed_volume"))), 20), _sum(c, c.field("volume"), 20)))

_d = lambda name, doc, build: _derived("liquidity", name, doc, build)
_d("amihud", "size of returns by dollar volume", lambda c: F.try_divide(F.abs(c.field("returns")), c.field("dollar_volume")))
_d("dollar_amihud", "mean of amihud over 20 rows", lambda c: _mean(c, c.field("amihud"), 20))
_d("kyle_lambda", "mean of the size of returns by the root of dollar volume over 20 rows", lambda c: _mean(c, c.settle(F.try_divide(F.abs(c.field("returns")), F.sqrt(F.when(c.field("dollar_volume") > 0, c.field("dollar_volume"))))), 20))


def _roll_spread(c) -> Column:
    change = c.settle(c.field("close") - _lag(c, c.field("close")))
    cov = c.settle(_call(c, "ts_cov", change, c.settle(_lag(c, change)), 20))
    return F.when(cov < 0, 2 * F.sqrt(-cov))


_d("roll_spread", "spread from the covariance of neighbouring changes over 20 rows, where it is negative", _roll_spread)


def _corwin_schultz(c) -> Column:
    """From highs and lows of two neighbouring rows; known, and so placed, at the later of them."""
    high, low = c.field("high"), c.field("low")
    before_high, before_low = c.settle(_lag(c, high)), c.settle(_lag(c, low))
    square = lambda h, l: F.pow(F.ln(F.try_divide(h, l)), F.lit(2.0))  # noqa: E731, E741
    beta = square(before_high, before_low) + square(high, low)
    gamma = square(F.greatest(before_high, high), F.least(before_low, low))
    k = 3 - 2 * 2**0.5
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / F.lit(k) - F.sqrt(gamma / F.lit(k))
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.when(spread > 0, spread)


_d("corwin_schultz", "spread from highs and lows of two rows, where it is positive; placed on the later row", _corwin_schultz)

_d = lambda name, doc, build: _derived("volatility", name, doc, build)


def _true_range(c) -> Column:
    high, low, before = c.field("high"), c.field("low"), c.settle(_lag(c, c.field("close")))
    return _all(high, low, before)(F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


_d("true_range", "range with the close before", _true_range)
for _name, _n in (("atr", 14), ("atr_5", 5), ("atr_60", 60)):
    _d(_name, f"mean true range of {_n} rows", lambda c, n=_n: _mean(c, c.field("true_range"), n))
for _name, _n in (("realized_vol", 20), ("realized_vol_5", 5), ("realized_vol_60", 60), ("realized_vol_120", 120)):
    _d(_name, f"standard deviation of returns over {_n} rows", lambda c, n=_n: _call(c, "ts_std", c.field("returns"), n))
_d("vol_of_vol_20", "standard deviation of realized_vol over 20 rows", lambda c: _call(c, "ts_std", c.field("realized_vol"), 20))
_d("skewness", "skewness of returns over 60 rows", lambda c: _call(c, "ts_skewness", c.field("returns"), 60))
_d("kurtosis", "excess kurtosis of returns over 60 rows", lambda c: _call(c, "ts_kurtosis", c.field("returns"), 60))
_d("parkinson_vol", "volatility from the ranges of 20 rows", lambda c: F.sqrt(_mean(c, c.settle(F.pow(F.ln(F.try_divide(c.field("high"), c.field("low"))), F.lit(2.0))), 20) / F.lit(4 * ln(2))))


def _garman_klass(c) -> Column:
    hl, co = F.ln(F.try_divide(c.field("high"), c.field("low"))), F.ln(F.try_divide(c.field("close"), c.field("open")))
    term = c.settle(0.5 * hl * hl - F.lit(2 * ln(2) - 1) * co * co)
    return F.sqrt(_mean(c, c.settle(F.when(term < 0, F.lit(0.0)).otherwise(term)), 20))


_d("garman_klass_vol", "volatility from open, high, low and close of 20 rows", _garman_klass)
_d("range_z_20", "range less its mean of 20 rows in standard deviations", lambda c: _call(c, "ts_zscore", c.field("range_"), 20))


def _streak(c, test) -> Column:
    hit = F.coalesce(test(c.field("returns")), F.lit(False)).cast("int")
    total = c.settle(F.sum(hit).over(c.history()))
    reset = F.last(F.when(hit == 0, total), ignorenulls=True).over(c.history().rowsBetween(c.START, 0))
    return (total - F.coalesce(reset, F.lit(0))).cast("double")


_d("consecutive_up", "rises in a row", lambda c: _streak(c, lambda r: r > 0))
_d("consecutive_down", "falls in a row", lambda c: _streak(c, lambda r: r < 0))

MACRO_BASE = ("vix", "treasury_3m_yield", "treasury_2y_yield", "treasury_10y_yield", "high_yield_spread", "baa_yield", "aaa_yield", "dxy", "wti_oil")
MACRO_SPREADS = {
    "term_spread_10y_2y": ("treasury_10y_yield", "treasury_2y_yield"),
    "term_spread_10y_3m": ("treasury_10y_yield", "treasury_3m_yield"),
    "credit_spread_baa_aaa": ("baa_yield", "aaa_yield"),
}
_base("macro", {n: "a series of its date, the same for all tickers" for n in (*MACRO_BASE, *MACRO_SPREADS)})

RAW_FUNDAMENTALS = (
    "revenue", "gross_profit", "operating_income", "net_income", "ebitda", "eps", "total_assets", "total_debt", "total_equity", "cash",
    "current_assets", "current_liabilities", "operating_cash_flow", "capex", "free_cash_flow", "dividends_paid",
)
_base("fundamental", {n: "of the latest report known at the date" for n in RAW_FUNDAMENTALS})


def _ratio(name: str, top: str, bottom: str, size: bool = False) -> None:
    build = lambda c: F.try_divide(F.abs(c.field(top)) if size else c.field(top), _nonzero(c.field(bottom)))
    _derived("fundamental", name, f"{top} by {bottom}", build)


_ratio("shares_outstanding", "net_income", "eps")
FIELDS["shares_outstanding"] = FieldSpec("shares_outstanding", "fundamental", "size of net_income by eps", lambda c: F.abs(F.try_divide(c.field("net_income"), _nonzero(c.field("eps")))))
_derived("fundamental", "market_cap", "close times shares_outstanding", lambda c: c.field("close") * c.field("shares_outstanding"))
for _args in (
    ("roe", "net_income", "total_equity"), ("roa", "net_income", "total_assets"), ("net_margin", "net_income", "revenue"), ("debt_to_equity", "total_debt", "total_equity"),
    ("current_ratio", "current_assets", "current_liabilities"), ("gross_margin", "gross_profit", "revenue"), ("operating_margin", "operating_income", "revenue"),
    ("pe_ratio", "market_cap", "net_income"), ("earnings_yield", "net_income", "market_cap"), ("pb_ratio", "market_cap", "total_equity"), ("ps_ratio", "market_cap", "revenue"),
    ("fcf_yield", "free_cash_flow", "market_cap"), ("dividend_yield", "dividends_paid", "market_cap", True),
):
    _ratio(*_args)
_derived("fundamental", "ev_ebitda", "market_cap with debt less cash, by ebitda", lambda c: F.try_divide(c.field("market_cap") + c.field("total_debt") - c.field("cash"), _nonzero(c.field("ebitda"))))


def field_catalog() -> list[dict]:
    """All fields, for display."""
    return [{"name": f.name, "category": f.category, "kind": f.kind, "description": f.doc} for f in FIELDS.values()]
