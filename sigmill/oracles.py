"""DuckDB SQL for the queries of sigmill.queries, written from the definitions and apart from the Spark plans."""

from __future__ import annotations

import math
from statistics import NormalDist

from sigmill.functions.fields import MACRO_BASE, MACRO_SPREADS

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, price"
BARS = f"first(price ORDER BY {ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {ORDER}) AS close, sum(l_quantity) AS volume"
OWN = "own AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS returns, (high + low + close) / 3 AS vwap FROM bars)"

SUPPLIERS = [
    "trades AS (SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)",
    f"bars AS (SELECT ticker, date, {BARS} FROM trades GROUP BY ticker, date)",
    OWN,
    "grid AS (SELECT d.date, t.ticker, t.ticker_ord FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT ticker, row_number() OVER (ORDER BY CAST(substr(ticker, 2) AS BIGINT)) AS ticker_ord FROM (SELECT DISTINCT ticker FROM bars)) t)",
    "labels AS (SELECT 'S' || s_suppkey AS ticker, r_name AS sector, n_name AS industry_group, n_name AS industry, n_name || '-' || CAST(s_suppkey % 2 AS VARCHAR) AS sub_industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "p AS MATERIALIZED (SELECT g.date, g.ticker, g.ticker_ord, open, high, low, close, volume, returns, vwap, sector, industry_group, industry, sub_industry FROM grid g LEFT JOIN own o ON o.date = g.date AND o.ticker = g.ticker LEFT JOIN labels l ON l.ticker = g.ticker)",
]
BRANDS = [
    "trades AS (SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey)",
    f"bars AS (SELECT ticker, date, {BARS} FROM trades GROUP BY ticker, date)",
    OWN,
    "grid AS (SELECT d.date, t.ticker, t.ticker_ord FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT ticker, row_number() OVER (ORDER BY ticker) AS ticker_ord FROM (SELECT DISTINCT ticker FROM bars)) t)",
    "p AS MATERIALIZED (SELECT g.date, g.ticker, g.ticker_ord, open, high, low, close, volume, returns, vwap FROM grid g LEFT JOIN own o ON o.date = g.date AND o.ticker = g.ticker)",
]

T = "PARTITION BY ticker ORDER BY date"
X = "PARTITION BY date"


def rows(d: int) -> str:
    return f"({T} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, d: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {rows(d)} = {d} THEN {value} END"


def agg(f: str, x: str, d: int) -> str:
    return full(x, d, f"{f}({x}) OVER {rows(d)}")


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({T})"


def query(base: list[str], stages: list[str], select: str, recursive: bool = False) -> str:
    """Stages are additional columns, each on top of the stage before it."""
    ctes, last = list(base), "p"
    for k, stage in enumerate(stages):
        ctes.append(f"q{k} AS (SELECT *, {stage} FROM {last})")
        last = f"q{k}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select.format(last=last)}"


def rounded(x: str, digits: int = 5) -> str:
    """x on a grid of `digits` decimals. The offset isn't a half: prices lie halfway between decimals often, where the last bits of a sum would decide."""
    return f"floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.27e0) / 1e{digits}"


def cell(value: str, *stages: str, base: list[str] = SUPPLIERS, digits: int = 5) -> str:
    return query(base, list(stages), f"SELECT date, ticker, {rounded(value, digits)} AS value FROM {{last}}")


def rank_sql(x: str, *parts: str) -> str:
    by = ", ".join(["date", *parts])
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def pair(f: str, x: str, y: str, d: int) -> str:
    """f over the pairs of a window that is full in both."""
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {rows(d)} = {d} THEN {f}({x}, {y}) OVER {rows(d)} END"


def corr(x: str, y: str, d: int) -> str:
    return f"({pair('covar_samp', x, y, d)}) / nullif(stddev_samp({x}) OVER {rows(d)} * stddev_samp({y}) OVER {rows(d)}, 0)"


def decay(x: str, weights: list[float]) -> str:
    n = len(weights)
    terms = " + ".join(f"({lag(x, n - 1 - k) if k < n - 1 else x}) * {w!r}" for k, w in enumerate(weights))
    return f"({terms}) / {sum(weights)!r}"


def listed(x: str, window: str) -> str:
    return f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {window}"


def over(f: str, x: str, *parts: str) -> str:
    return f"{f}({x}) OVER (PARTITION BY {', '.join(['date', *parts])})"


C, V, R, H = "close", "volume", "returns", "high"
HUMP = query(
    SUPPLIERS + [
        f"n AS (SELECT date, ticker, close, row_number() OVER ({T}) AS k FROM p)",
        "h AS (SELECT date, ticker, k, close AS last FROM n WHERE k = 1 UNION ALL SELECT n.date, n.ticker, n.k, CASE WHEN n.close IS NULL OR (h.last IS NOT NULL AND abs(n.close - h.last) <= 500) THEN h.last ELSE n.close END FROM h JOIN n ON n.ticker = h.ticker AND n.k = h.k + 1)",
    ], [], f"SELECT date, ticker, {rounded('last')} AS value FROM h", recursive=True,
)


def holds(c: str) -> str:
    return f"({c} IS NULL OR {c} <> 0)"


def flag(test: str, missing: int = 0) -> str:
    return f"CAST(coalesce(CASE WHEN {test} THEN 1 ELSE 0 END * CASE WHEN ({test}) IS NULL THEN NULL ELSE 1 END, {missing}) AS DOUBLE)"


# name -> (formula, SQL). Formulas name the function's own arguments over the supplier panel.
OPERATORS: dict[str, tuple[str, str]] = {
    "ts_mean": ("ts_mean(close, 6)", cell(agg("avg", C, 6))),
    "ts_std": ("ts_std(close, 6)", cell(agg("stddev_samp", C, 6))),
    "ts_min": ("ts_min(close, 6)", cell(agg("min", C, 6))),
    "ts_max": ("ts_max(close, 6)", cell(agg("max", C, 6))),
    "ts_sum": ("ts_sum(close, 6)", cell(agg("sum", C, 6))),
    "ts_median": ("ts_median(close, 6)", cell(agg("median", C, 6))),
    "ts_quantile": ("ts_quantile(close, 6, 0.3)", cell(full(C, 6, f"quantile_cont(close, 0.3) OVER {rows(6)}"))),
    "ts_product": ("ts_product(returns + 1, 6)", cell(agg("product", "x", 6), "returns + 1 AS x", digits=4)),
    "ts_min_max_diff": ("ts_min_max_diff(close, 6)", cell(full(C, 6, f"max(close) OVER {rows(6)} - min(close) OVER {rows(6)}"))),
    "ts_rank": ("ts_rank(volume, 6)", cell("CASE WHEN len(a) = 6 THEN (len(list_filter(a, lambda v: v < volume)) + (len(list_filter(a, lambda v: v = volume)) + 1) / 2.0) / 6 END", f"{listed(V, rows(6))} AS a")),
    "ts_arg_max": ("ts_arg_max(volume, 6)", cell("CASE WHEN len(a) = 6 THEN 6 - list_position(a, list_max(a)) END", f"{listed(V, rows(6))} AS a")),
    "ts_arg_min": ("ts_arg_min(volume, 6)", cell("CASE WHEN len(a) = 6 THEN 6 - list_position(a, list_min(a)) END", f"{listed(V, rows(6))} AS a")),
    "delay": ("delay(close, 3)", cell(lag(C, 3))),
    "delta": ("delta(close, 3)", cell(f"close - {lag(C, 3)}")),
    "ts_returns": ("ts_returns(close, 3)", cell(f"close / nullif({lag(C, 3)}, 0) - 1")),
    "decay_linear": ("decay_linear(close, 12)", cell(decay(C, [float(k) for k in range(1, 13)]))),
    "decay_linear_short": ("decay_linear(close, 4)", cell(decay(C, [1.0, 2.0, 3.0, 4.0]))),
    "ts_decay_exp": ("ts_decay_exp(close, 5, 0.7)", cell(decay(C, [0.7**k for k in range(4, -1, -1)]))),
    "ts_zscore": ("ts_zscore(close, 6)", cell(full(C, 6, f"(close - avg(close) OVER {rows(6)}) / nullif(stddev_samp(close) OVER {rows(6)}, 0)"))),
    "ts_skewness": ("ts_skewness(returns, 9)", cell(agg("skewness", R, 9), digits=4)),
    "ts_kurtosis": ("ts_kurtosis(returns, 9)", cell(agg("kurtosis", R, 9), digits=4)),
    "ts_corr": ("ts_corr(close, volume, 6)", cell(corr(C, V, 6))),
    "ts_cov": ("ts_cov(returns, volume, 6)", cell(pair("covar_samp", R, V, 6), digits=3)),
    "ts_partial_corr": ("ts_partial_corr(close, volume, high, 6)", cell("(xy - xz * yz) / sqrt(greatest((1 - xz * xz) * (1 - yz * yz), 1e-12))", f"{corr(C, V, 6)} AS xy, {corr(C, H, 6)} AS xz, {corr(V, H, 6)} AS yz", digits=4)),
    "ts_regression": ("ts_regression(close, volume, 6)", cell(f"({pair('covar_samp', C, V, 6)}) / nullif(var_samp(volume) OVER {rows(6)}, 0)")),
    "days_from_last_change": ("days_from_last_change(greater(returns, 0))", cell(f"row_number() OVER (PARTITION BY ticker, run ORDER BY date) - 1", f"{flag('returns > 0')} AS x", f"CASE WHEN {lag('x')} IS NULL OR x <> {lag('x')} THEN 1 ELSE 0 END AS changed", f"sum(changed) OVER ({T}) AS run")),
    "hump": ("hump(close, 500)", HUMP),
    "adv": ("adv(4) / 1000", cell(f"({agg('avg', 'x', 4)}) / 1000", "close * volume AS x")),
    "rank": ("rank(volume)", cell(rank_sql(V))),
    "zscore": ("zscore(close)", cell(f"(close - {over('avg', C)}) / nullif({over('stddev_samp', C)}, 0)")),
    "demean": ("demean(close)", cell(f"close - {over('avg', C)}")),
    "scale": ("scale(close)", cell(f"close / {over('sum', C)}", digits=8)),
    "normalize": ("normalize(close)", cell(f"x / {over('sum', 'abs(x)')}", f"close - {over('avg', C)} AS x", digits=8)),
    "winsorize": ("winsorize(close, 1)", cell("CASE WHEN close IS NOT NULL THEN least(greatest(close, m - s), m + s) END", f"{over('avg', C)} AS m, {over('stddev_samp', C)} AS s")),
    "quantile": ("quantile(close, 0.25)", cell("quantile_cont(close, 0.25) OVER (PARTITION BY date)")),
    "vector_neut": ("vector_neut(close, volume)", cell(f"close - {over('sum', 'close * volume')} / nullif({over('sum', 'volume * volume')}, 0) * volume")),
    "regression_neut": ("regression_neut(close, volume)", cell(f"a - {over('sum', 'a * b')} / nullif({over('sum', 'b * b')}, 0) * b", f"close - {over('avg', C)} AS a, volume - {over('avg', V)} AS b")),
    "correlation": ("correlation(close, volume)", cell("covar_samp(close, volume) OVER (PARTITION BY date) / nullif(stddev_samp(close) OVER (PARTITION BY date) * stddev_samp(volume) OVER (PARTITION BY date), 0)")),
    "bucket": ("bucket(volume, 7)", cell(f"CASE WHEN volume IS NOT NULL THEN least(floor((row_number() OVER (PARTITION BY date, volume IS NULL ORDER BY volume, ticker_ord) - 1) * 7 / {over('count', V)}), 6) END")),
    "tail": ("tail(close, 500, 3000, -1)", cell("CASE WHEN close BETWEEN 500 AND 3000 THEN close ELSE -1 END")),
    "kth_element": ("kth_element(close, 4)", cell("list_sort(a)[4]", f"list(close) FILTER (WHERE close IS NOT NULL) OVER ({X}) AS a")),
    "kth_element_top": ("kth_element(close, -2)", cell("list_reverse_sort(a)[2]", f"list(close) FILTER (WHERE close IS NOT NULL) OVER ({X}) AS a")),
    "harmonic_mean": ("harmonic_mean(returns)", cell("count(u) OVER (PARTITION BY date) / sum(1 / u) OVER (PARTITION BY date)", "CASE WHEN returns > 0 THEN returns END AS u")),
    "geometric_mean": ("geometric_mean(returns)", cell("exp(avg(ln(u)) OVER (PARTITION BY date))", "CASE WHEN returns > 0 THEN returns END AS u")),
    "step": ("step(volume)", cell(f"CASE WHEN n > 1 THEN (r * n - (n + 1) / 2.0) / ((n - 1) / 2.0) END", f"{rank_sql(V)} AS r, {over('count', V)} AS n")),
    "keep": ("keep(returns, 5)", cell("CASE WHEN returns IS NOT NULL AND row_number() OVER (PARTITION BY date, returns IS NULL ORDER BY abs(returns) DESC, ticker_ord) <= 5 THEN returns ELSE 0 END")),
    "cap_weight": ("cap_weight(returns)", ""),
    "group_rank": ("group_rank(volume, sector)", cell(rank_sql(V, "sector"))),
    "group_zscore": ("group_zscore(close, sector)", cell(f"(close - {over('avg', C, 'sector')}) / nullif({over('stddev_samp', C, 'sector')}, 0)")),
    "group_neutralize": ("group_neutralize(close, sector)", cell(f"close - {over('avg', C, 'sector')}")),
    "neutralize": ("neutralize(close, industry)", cell(f"close - {over('avg', C, 'industry')}")),
    "group_mean": ("group_mean(close, sector)", cell(over("avg", C, "sector"))),
    "group_sum": ("group_sum(close, industry_group)", cell(f"coalesce({over('sum', C, 'industry_group')}, 0)")),
    "group_count": ("group_count(close, industry_group)", cell(over("count", C, "industry_group"))),
    "group_max": ("group_max(close, sector)", cell(over("max", C, "sector"))),
    "group_min": ("group_min(close, sub_industry)", cell(over("min", C, "sub_industry"))),
    "group_normalize": ("group_normalize(close, sector)", cell(f"x / nullif({over('sum', 'abs(x)', 'sector')}, 0)", f"close - {over('avg', C, 'sector')} AS x", digits=7)),
    "group_scale": ("group_scale(close, sector)", cell(f"close / nullif({over('sum', 'abs(close)', 'sector')}, 0)", digits=7)),
    "arithmetic": ("-(close + volume * 2 - high / low) / (close - 1)", cell("-(close + volume * 2 - high / nullif(low, 0)) / nullif(close - 1, 0)")),
    "abs": ("abs(returns)", cell("abs(returns)")),
    "sign": ("sign(returns)", cell("sign(returns)")),
    "log": ("log(returns)", cell("CASE WHEN returns > 0 THEN ln(returns) END")),
    "sqrt": ("sqrt(returns)", cell("CASE WHEN returns >= 0 THEN sqrt(returns) END")),
    "exp": ("exp(-abs(returns))", cell("exp(-abs(returns))")),
    "power": ("power(returns, 0.5)", cell("CASE WHEN returns >= 0 THEN sqrt(returns) END")),
    "signed_power": ("signed_power(returns, 2)", cell("sign(returns) * pow(abs(returns), 2)", digits=4)),
    "sigmoid": ("sigmoid(returns)", cell("1 / (1 + exp(-returns))")),
    "mod": ("mod(returns, -0.3)", cell("returns - floor(returns / -0.3e0) * -0.3e0")),
    "max": ("max(close, delay(close, 1))", cell("CASE WHEN close IS NOT NULL AND y IS NOT NULL THEN greatest(close, y) END", f"{lag(C)} AS y")),
    "min": ("min(close, delay(close, 1))", cell("CASE WHEN close IS NOT NULL AND y IS NOT NULL THEN least(close, y) END", f"{lag(C)} AS y")),
    "clip": ("clip(close, 500, 3000)", cell("CASE WHEN close < 500 THEN 500 WHEN close > 3000 THEN 3000 ELSE close END")),
    "replace": ("replace(sign(returns), -1, 5)", cell("CASE WHEN sign(returns) = -1 THEN 5 ELSE sign(returns) END")),
    "isnan": ("isnan(returns)", cell("CASE WHEN returns IS NULL THEN 1 ELSE 0 END")),
    "pasteurize": ("pasteurize(returns)", cell("coalesce(returns, 0)")),
    "equal": ("equal(sign(returns), 1)", cell(flag("sign(returns) = 1"))),
    "not_equal": ("not_equal(sign(returns), 1)", cell(flag("sign(returns) <> 1", 1))),
    "less": ("less(close, delay(close, 1))", cell(flag("close < y"), f"{lag(C)} AS y")),
    "greater": ("greater(close, delay(close, 1))", cell(flag("close > y"), f"{lag(C)} AS y")),
    "less_eq": ("less_eq(close, delay(close, 1))", cell(flag("close <= y"), f"{lag(C)} AS y")),
    "greater_eq": ("greater_eq(close, delay(close, 1))", cell(flag("close >= y"), f"{lag(C)} AS y")),
    "if_else": ("if_else(returns - abs(returns), close, -volume)", cell(f"CASE WHEN {holds('c')} THEN close ELSE -volume END", "returns - abs(returns) AS c")),
    "where": ("where(greater(returns, 0), close, high)", cell("CASE WHEN returns > 0 THEN close ELSE high END")),
    "when": ("when(greater(returns, 0), close)", cell("CASE WHEN returns > 0 THEN close END")),
    "mask": ("mask(close, greater(returns, 0))", cell("CASE WHEN returns > 0 THEN NULL ELSE close END")),
    "trade_when": ("trade_when(greater(returns, 0.5), close, less(returns, -0.5))", cell(f"(last_value(e IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING)).v", "CASE WHEN returns < -0.5 THEN {{'v': CAST(NULL AS DOUBLE)}} WHEN returns > 0.5 THEN {{'v': close}} END AS e".replace("{{", "{").replace("}}", "}"))),
}

# --- fields, over the brand panel ------------------------------------------------------------------------------------------
LN2 = 0.6931471805599453
BEFORE = f"{lag(C)} AS pc"
FIELD_SETS: dict[str, tuple[list[str], dict[str, str], int]] = {
    "fields_price": ([BEFORE], {
        "median_price": "(high + low) / 2", "weighted_close": "(high + low + 2 * close) / 4", "range_": "high - low", "body": "abs(close - open)", "upper_shadow": "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN high - greatest(open, close) END",
        "lower_shadow": "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) - low END", "gap": "open - pc", "high_low_ratio": "high / nullif(low, 0)", "body_to_range": "abs(close - open) / nullif(high - low, 0)", "vwap": "vwap",
    }, 4),
    "fields_return": ([BEFORE], {
        "returns": "returns", "log_returns": "ln(close / nullif(pc, 0))", "abs_returns": "abs(returns)", "intraday_return": "(close - open) / nullif(open, 0)", "overnight_return": "(open - pc) / nullif(pc, 0)",
        **{f"momentum_{n}": f"close / nullif({lag(C, n)}, 0) - 1" for n in (3, 5, 10, 20, 60, 120, 252)}, **{f"reversal_{n}": f"-(close / nullif({lag(C, n)}, 0) - 1)" for n in (5, 20)},
        "close_to_high_252": f"close / ({agg('max', C, 252)})", "momentum_z_60": f"(close / nullif({lag(C, 60)}, 0) - 1) / nullif({agg('stddev_samp', R, 60)}, 0)",
    }, 5),
    "fields_volume": (["volume * sign(returns) AS sv, close * volume AS dv, CASE WHEN returns > 0 THEN volume ELSE 0 END AS uv, CASE WHEN returns < 0 THEN volume ELSE 0 END AS dnv", "abs(sv) AS asv"], {
        "signed_volume": "sv", "dollar_volume": "dv / 1000", "adv20": agg("avg", V, 20), "volume_ratio": f"volume / nullif({agg('avg', V, 20)}, 0)", "turnover_ratio": f"volume / nullif({agg('avg', V, 60)}, 0)",
        "up_volume_ratio": f"({agg('sum', 'uv', 20)}) / nullif({agg('sum', V, 20)}, 0)", "down_volume_ratio": f"({agg('sum', 'dnv', 20)}) / nullif({agg('sum', V, 20)}, 0)", "vpin_proxy": f"({agg('sum', 'asv', 20)}) / nullif({agg('sum', V, 20)}, 0)",
    }, 4),
    "fields_liquidity": ([f"close * volume AS dv, close - {lag(C)} AS dp, {lag('high')} AS ph, {lag('low')} AS pl", f"abs(returns) / nullif(dv, 0) AS am, abs(returns) / sqrt(CASE WHEN dv > 0 THEN dv END) AS kl, {lag('dp')} AS dp1, pow(ln(ph / pl), 2) + pow(ln(high / low), 2) AS beta, CASE WHEN ph IS NOT NULL AND high IS NOT NULL THEN pow(ln(greatest(ph, high) / least(pl, low)), 2) END AS gamma",
                          f"{pair('covar_samp', 'dp', 'dp1', 20)} AS cv, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2e0)) - sqrt(gamma / (3 - 2 * sqrt(2e0))) AS al", "2 * (exp(al) - 1) / (1 + exp(al)) AS cs"], {
        "amihud": "am * 1000000", "dollar_amihud": f"({agg('avg', 'am', 20)}) * 1000000", "kyle_lambda": f"({agg('avg', 'kl', 20)}) * 1000", "roll_spread": "CASE WHEN cv < 0 THEN 2 * sqrt(-cv) END", "corwin_schultz": "CASE WHEN cs > 0 THEN cs END",
    }, 4),
    "fields_volatility": ([BEFORE + f", {agg('stddev_samp', R, 20)} AS rv, pow(ln(high / low), 2) AS hl, greatest(0.5e0 * pow(ln(high / low), 2) - {2 * LN2 - 1!r} * pow(ln(close / open), 2), 0) AS gk, high - low AS rg", "CASE WHEN high IS NOT NULL AND pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN close IS NOT NULL THEN gk END AS gk2, CASE WHEN returns > 0 THEN 1 ELSE 0 END AS up, CASE WHEN returns < 0 THEN 1 ELSE 0 END AS dn",
                           f"sum(up) OVER ({T}) AS ups, sum(dn) OVER ({T}) AS dns"], {
        "true_range": "tr", "atr": agg("avg", "tr", 14), "atr_5": agg("avg", "tr", 5), "atr_60": agg("avg", "tr", 60), "realized_vol": "rv", **{f"realized_vol_{n}": agg("stddev_samp", R, n) for n in (5, 60, 120)}, "vol_of_vol_20": agg("stddev_samp", "rv", 20),
        "skewness": agg("skewness", R, 60), "kurtosis": agg("kurtosis", R, 60), "parkinson_vol": f"sqrt(({agg('avg', 'hl', 20)}) / {4 * LN2!r})", "garman_klass_vol": f"sqrt({agg('avg', 'gk2', 20)})", "range_z_20": full("rg", 20, f"(rg - avg(rg) OVER {rows(20)}) / nullif(stddev_samp(rg) OVER {rows(20)}, 0)"),
        "consecutive_up": f"ups - coalesce(last_value(CASE WHEN up = 0 THEN ups END IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING), 0)", "consecutive_down": f"dns - coalesce(last_value(CASE WHEN dn = 0 THEN dns END IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING), 0)",
    }, 4),
}


def fields_sql(name: str) -> str:
    stages, columns, digits = FIELD_SETS[name]
    return query(BRANDS, stages, "SELECT date, ticker, " + ", ".join(f"{rounded(v, digits)} AS {k}" for k, v in columns.items()) + " FROM {last}")


# --- macro and fundamentals, over the supplier panel -------------------------------------------------------------------------
def _share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1e0 ELSE 0e0 END)"


MACRO = [
    "mo AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, " + ", ".join([
        "CASE WHEN (year(CAST(date_trunc('month', o_orderdate) AS DATE)) * 12 + month(CAST(date_trunc('month', o_orderdate) AS DATE))) % 7 <> 0 THEN avg(o_totalprice / 1.25e4) END AS vix",
        _share("o_orderpriority LIKE '1%'") + " AS treasury_3m_yield", _share("o_orderpriority LIKE '2%'") + " AS treasury_2y_yield", _share("o_orderpriority LIKE '3%'") + " AS treasury_10y_yield", _share("o_orderstatus = 'F'") + " AS high_yield_spread",
        _share("o_orderpriority LIKE '4%'") + " AS baa_yield", _share("o_orderpriority LIKE '5%'") + " AS aaa_yield", "CAST(count(*) AS DOUBLE) AS dxy", "max(o_totalprice) / 1e4 AS wti_oil",
    ]) + " FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE))",
    "ms AS (SELECT *, " + ", ".join(f"{a} - {b} AS {n}" for n, (a, b) in MACRO_SPREADS.items()) + " FROM mo)",
    "md AS (SELECT d.date, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS {n}" for n in (*MACRO_BASE, *MACRO_SPREADS)) + " FROM (SELECT DISTINCT date FROM p) d LEFT JOIN ms ON ms.date = d.date)",
]
SALE = "l_extendedprice * (1 - l_discount)"
FUNDAMENTALS = [
    f"fq AS (SELECT 'S' || l_suppkey AS ticker, CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS report_date, sum({SALE}) AS revenue, sum({SALE} * l_tax) AS tax, sum(l_quantity) AS units, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN {SALE} END), 0) AS back, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1, 2)",
    "fr AS (SELECT ticker, report_date + 90 AS known, revenue, revenue * 0.4e0 AS gross_profit, revenue * 0.3e0 - back * 0.1e0 AS operating_income, revenue * 0.2e0 - back * 0.1e0 AS net_income, revenue * 0.35e0 AS ebitda, (revenue * 0.2e0 - back * 0.1e0) / units AS eps, gross * 3 AS total_assets, gross * 1.2e0 AS total_debt, gross * 1.8e0 AS total_equity, gross * 0.3e0 AS cash, gross * 0.9e0 AS current_assets, gross * 0.6e0 AS current_liabilities, revenue * 0.25e0 AS operating_cash_flow, -revenue * 0.05e0 AS capex, revenue * 0.2e0 AS free_cash_flow, -tax AS dividends_paid FROM fq)",
    "f0 AS (SELECT p.*, fr.* EXCLUDE (ticker) FROM p ASOF LEFT JOIN fr ON fr.ticker = p.ticker AND fr.known <= p.date)",
    "f AS (SELECT *, abs(net_income / nullif(eps, 0)) AS shares_outstanding, close * abs(net_income / nullif(eps, 0)) AS market_cap FROM f0)",
]
RATIOS = {
    "roe": "net_income / nullif(total_equity, 0)", "roa": "net_income / nullif(total_assets, 0)", "net_margin": "net_income / nullif(revenue, 0)", "debt_to_equity": "total_debt / nullif(total_equity, 0)", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "gross_margin": "gross_profit / nullif(revenue, 0)", "operating_margin": "operating_income / nullif(revenue, 0)", "pe_ratio": "market_cap / nullif(net_income, 0)", "earnings_yield": "net_income / nullif(market_cap, 0)", "pb_ratio": "market_cap / nullif(total_equity, 0)",
    "ps_ratio": "market_cap / nullif(revenue, 0)", "fcf_yield": "free_cash_flow / nullif(market_cap, 0)", "dividend_yield": "abs(dividends_paid) / nullif(market_cap, 0)", "ev_ebitda": "(market_cap + total_debt - cash) / nullif(ebitda, 0)", "shares_outstanding": "shares_outstanding / 1000", "market_cap": "market_cap / 1000000",
}
RAW = ["revenue", "gross_profit", "operating_income", "net_income", "ebitda", "total_assets", "total_debt", "total_equity", "cash", "current_assets", "current_liabilities", "operating_cash_flow", "capex", "free_cash_flow", "dividends_paid"]

OPERATORS["cap_weight"] = ("cap_weight(returns)", query(SUPPLIERS + FUNDAMENTALS + ["fx AS (SELECT *, returns * market_cap AS x FROM f)"], [], f"SELECT date, ticker, {rounded(rank_sql('x'))} AS value FROM fx"))


def macro_sql() -> str:
    columns = ", ".join(f"{rounded(f'md.{n}', 5)} AS {n}" for n in (*MACRO_BASE, *MACRO_SPREADS))
    return query(SUPPLIERS + MACRO, [], f"SELECT p.date, p.ticker, {columns} FROM p JOIN md ON md.date = p.date")


def fundamentals_sql() -> str:
    columns = [f"{rounded(f'{n} / 1000', 3)} AS {n}" for n in RAW] + [f"{rounded('eps', 4)} AS eps"]
    return query(SUPPLIERS + FUNDAMENTALS, [], f"SELECT date, ticker, {', '.join(columns)} FROM f")


def ratios_sql() -> str:
    return query(SUPPLIERS + FUNDAMENTALS, [], "SELECT date, ticker, " + ", ".join(f"{rounded(v, 4)} AS {n}" for n, v in RATIOS.items()) + " FROM f")


# --- portfolios ------------------------------------------------------------------------------------------------------------
def book_ctes(
    signal: str, stages: list[str] = [], base: list[str] = SUPPLIERS, neutralization: str = "market", truncation: float = 0.05, book: float = 2e7, bps: float = 5.0, decay_: int = 0, lag_: int = 1, spread: str = "0", impact: str = "0", borrow_bps: float = 0.0,
    segment: str = "CASE WHEN floor(dates * 0.7e0) > 0 AND floor(dates * 0.7e0) < dates AND place > floor(dates * 0.7e0) THEN 'oos' ELSE 'is' END", by: tuple[str, ...] = ("segment",), extra: str = "", where: str = "TRUE", source: str | None = None, mask: str = "signal", first: str = "p",
) -> list[str]:
    """CTEs up to `book` and `daily` for one signal over p. by: the columns of a run; `window`s come with `source`."""
    keys = ", ".join(by)
    own, day = f"PARTITION BY {keys}, ticker ORDER BY date", f"PARTITION BY {keys}, date"
    out, last = list(base), first
    for k, stage in enumerate(stages):
        out.append(f"g{k} AS (SELECT *, {stage} FROM {last})")
        last = f"g{k}"
    cells = [c for c in by if c not in ("segment", "win")]
    cell_keys = "".join(f"{c}, " for c in cells)
    if source is None:
        out.append(f"sig AS (SELECT *, {signal} AS signal FROM {last})")
    else:
        out.append(f"sig AS ({source.format(last=last)})")
    out.append(f"sel AS (SELECT * FROM (SELECT *, count(signal) OVER (PARTITION BY {cell_keys}date) * 1e0 / count(*) OVER (PARTITION BY {cell_keys}date) AS share FROM sig WHERE {where}) WHERE share >= 0.5)")
    out.append(f"placed AS (SELECT *, row_number() OVER (PARTITION BY {cell_keys}ticker ORDER BY date) AS place, count(*) OVER (PARTITION BY {cell_keys}ticker) AS dates FROM sel)")
    out.append(f"seg AS (SELECT *, {segment} AS segment FROM placed {extra})")
    terms = " + ".join(f"(lag(masked, {decay_ - k}) OVER ({own})) * {float(k)!r}" if k < decay_ else f"masked * {float(k)!r}" for k in range(1, decay_ + 1))
    decayed = f"({terms}) / {decay_ * (decay_ + 1) / 2!r}" if decay_ else "masked"
    centre = {"none": "s1", "market": f"s1 - avg(s1) OVER ({day})"}.get(neutralization, f"s1 - avg(s1) OVER ({day}, coalesce({neutralization}, 'Unknown'))")
    out += [
        f"b0 AS (SELECT *, {mask} AS masked FROM seg)", f"b1 AS (SELECT *, {decayed} AS s1 FROM b0)", f"b2 AS (SELECT *, {centre} AS s2 FROM b1)",
        f"b3 AS (SELECT *, least(greatest(coalesce(s2 / nullif(sum(abs(s2)) OVER ({day}), 0), 0), {-truncation!r}), {truncation!r}) AS weight FROM b2)", f"b4 AS (SELECT *, weight * {book!r} AS position FROM b3)",
        f"b5 AS (SELECT *, lag(position) OVER ({own}) AS before, lag(position, {lag_}) OVER ({own}) AS held FROM b4)", "b6 AS (SELECT *, coalesce(abs(position - before), 0) AS trade FROM b5)",
        f"book AS (SELECT *, coalesce(held * returns, 0) AS gross, trade * {bps / 1e4!r} AS flat, {spread} AS spread, {impact} AS impact, greatest(coalesce(-before, 0), 0) * {borrow_bps / (1e4 * 252)!r} AS borrow FROM b6)",
        f"d0 AS (SELECT {keys}, date, sum(gross) AS gross, sum(flat) AS flat, sum(spread) AS spread, sum(impact) AS impact, sum(borrow) AS borrow, sum(trade) AS turnover, sum(greatest(position, 0)) AS long, sum(least(position, 0)) AS short, sum(abs(position)) AS gross_exposure FROM book GROUP BY {keys}, date)",
        "d1 AS (SELECT *, gross - flat - spread - impact - borrow AS net FROM d0)",
        f"daily AS (SELECT *, net / {book!r} AS ret, sum(net) OVER (PARTITION BY {keys} ORDER BY date) AS cumulative FROM d1)",
    ]
    return out


REVERSAL_STAGES = [f"{lag(C, 5)} AS c5", "close - c5 AS dl"]
REVERSAL = f"-({rank_sql('dl')})"  # -rank(delta(close, 5))
DAILY = ["gross", "flat", "spread", "impact", "borrow", "net", "cumulative", "turnover", "long", "short", "gross_exposure"]


def select_daily(ctes: list[str], by: tuple[str, ...] = ("segment",), names: dict[str, str] | None = None) -> str:
    keys = ", ".join(f"{b} AS {(names or {}).get(b, b)}" for b in by)
    return f"WITH {', '.join(ctes)} SELECT {keys}, date, {', '.join(f'{rounded(c, 2)} AS {c}' for c in DAILY)}, {rounded('ret', 8)} AS ret FROM daily"


def base_book() -> list[str]:
    return book_ctes(REVERSAL, REVERSAL_STAGES)


def book_sql(ctes: list[str]) -> str:
    return f"WITH {', '.join(ctes)} SELECT segment, date, ticker, {rounded('s2', 6)} AS signal, {rounded('weight', 8)} AS weight, {rounded('position', 2)} AS position, {rounded('trade', 2)} AS trade FROM book"


DV = "close * volume AS dv"
PORTFOLIOS: dict[str, list[str]] = {
    "portfolio_sector": book_ctes(REVERSAL, REVERSAL_STAGES, neutralization="sector"),
    "portfolio_sub_industry": book_ctes(REVERSAL, REVERSAL_STAGES, neutralization="sub_industry", segment="'is'"),
    "portfolio_raw_lagged": book_ctes(REVERSAL, REVERSAL_STAGES, neutralization="none", lag_=3, truncation=0.01),
    "portfolio_decay": book_ctes(REVERSAL, REVERSAL_STAGES, decay_=4),
    "portfolio_dates_universe": book_ctes(REVERSAL, REVERSAL_STAGES, where="date BETWEEN DATE '1996-03-01' AND DATE '2000-06-01' AND ticker IN ('S1', 'S2', 'S3', 'S5', 'S8', 'S13', 'S21', 'S34', 'S55', 'S89')", truncation=0.2),
    "portfolio_costs": book_ctes(REVERSAL, [*REVERSAL_STAGES, f"{agg('stddev_samp', R, 20)} AS rv, {DV}"], spread="trade * 0.00025e0", impact="0.1e0 * coalesce(rv, 0) * trade * sqrt(coalesce(trade / CASE WHEN dv > 0 THEN dv END, 0))", borrow_bps=50.0),
    "portfolio_corwin_schultz": book_ctes(REVERSAL, [*REVERSAL_STAGES, f"{lag('high')} AS ph, {lag('low')} AS pl", "pow(ln(ph / pl), 2) + pow(ln(high / low), 2) AS beta, CASE WHEN ph IS NOT NULL AND high IS NOT NULL THEN pow(ln(greatest(ph, high) / least(pl, low)), 2) END AS gamma", "(sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2e0)) - sqrt(gamma / (3 - 2 * sqrt(2e0))) AS al", "2 * (exp(al) - 1) / (1 + exp(al)) AS cs"], spread="trade * greatest(coalesce(CASE WHEN cs > 0 THEN cs END, 0), 0) * 0.5e0"),
    "portfolio_liquid": book_ctes(REVERSAL, [*REVERSAL_STAGES, DV], mask="CASE WHEN avg(dv) OVER (PARTITION BY segment, ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 2000000 THEN signal END"),
    "portfolio_point_in_time": book_ctes(REVERSAL, [*REVERSAL_STAGES], mask="CASE WHEN ticker IN ('S3', 'S7') AND date < DATE '1998-01-01' THEN NULL ELSE signal END"),
    "portfolio_point_in_time_zero": book_ctes(REVERSAL, [*REVERSAL_STAGES], mask="CASE WHEN ticker IN ('S3', 'S7') AND date < DATE '1998-01-01' THEN 0 ELSE signal END"),
}

# --- analytics over the base book --------------------------------------------------------------------------------------------
SHARPE = "coalesce(avg({r}) / sqrt(CASE WHEN var_samp({r}) > 1e-24 THEN var_samp({r}) END) * sqrt(252e0), 0)"


def sharpe_sql(r: str = "ret") -> str:
    return SHARPE.format(r=r)


EQUITY = [
    "e0 AS (SELECT *, 1 + sum(ret) OVER (PARTITION BY segment ORDER BY date) AS equity FROM daily)",
    "e1 AS (SELECT *, max(equity) OVER (PARTITION BY segment ORDER BY date) AS peak FROM e0)",
    "eq AS (SELECT *, equity / peak - 1 AS drawdown, equity < peak AS underwater FROM e1)",
    "bench AS (SELECT date, coalesce(avg(returns), 0) AS b FROM p GROUP BY date)",
]
YEARLY = "CASE WHEN 1 + sum(ret) > 0 THEN pow(1 + sum(ret), 252e0 / count(*)) - 1 ELSE 0 END"
YEARLY = f"({YEARLY})"
COSTS = "SELECT segment, " + ", ".join(f"{rounded(v, 3 if k == 'cost_pct_of_gross' else 1)} AS {k}" for k, v in {
    "gross_pnl": "sum(gross)", **{f"{c}_cost": f"sum({c})" for c in ("flat", "spread", "impact", "borrow")}, "total_cost": "sum(flat + spread + impact + borrow)", "net_pnl": "sum(net)", "cost_pct_of_gross": "100 * sum(flat + spread + impact + borrow) / abs(sum(gross))",
}.items()) + " FROM daily GROUP BY segment"
HALVES = (
    f"SELECT {rounded('sd', 4)} AS sharpe_decay, {rounded('rd', 4)} AS return_decay, sd > 0.5 OR os < 0 AS overfitting_flag, CASE WHEN sd IS NULL THEN NULL WHEN os < 0 THEN 'severe' WHEN sd < 0.2 THEN 'robust' WHEN sd < 0.4 THEN 'moderate' WHEN sd < 0.6 THEN 'high' ELSE 'severe' END AS severity, is_start, is_end, oos_start, oos_end FROM "
    f"(SELECT (i.sh - o.sh) / abs(i.sh) AS sd, (i.yr - o.yr) / abs(i.yr) AS rd, o.sh AS os, i.a AS is_start, i.b AS is_end, o.a AS oos_start, o.b AS oos_end FROM hv i JOIN hv o ON i.segment = 'is' AND o.segment = 'oos')"
)
SUMMARY = (
    f"SELECT segment, count(*) AS n_days, {rounded(sharpe_sql())} AS sharpe, {rounded('sum(ret)')} AS total_return, {rounded('ln(1 + abs(CASE WHEN 1 + sum(ret) > 0 THEN pow(1 + sum(ret), 252e0 / count(*)) - 1 ELSE 0 END))')} AS annual_return, "
    f"{rounded('stddev_samp(ret) * sqrt(252e0)')} AS annual_vol, {rounded('min(drawdown)')} AS max_drawdown, {rounded('coalesce(avg(ret) / sqrt(var_samp(CASE WHEN ret < 0 THEN ret END)) * sqrt(252e0), 0)')} AS sortino_ratio, "
    f"{rounded('avg(turnover)', 1)} AS avg_turnover, {rounded('avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate, {rounded('sum(CASE WHEN net > 0 THEN net END) / -sum(CASE WHEN net < 0 THEN net END)')} AS profit_factor, "
    f"{rounded('abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05))')} AS tail_ratio, {rounded('100 * sum(flat + spread + impact + borrow) / abs(sum(gross))', 3)} AS cost_pct_of_gross, "
    f"{rounded('avg(long) / max(gross_exposure)')} AS long_exposure, {rounded('avg(short) / max(gross_exposure)')} AS short_exposure, {rounded('avg(long - short) / max(gross_exposure)')} AS gross_exposure, {rounded('avg(long + short) / max(gross_exposure)')} AS net_exposure, "
    f"{rounded('ln(1 + abs(CASE WHEN min(drawdown) < 0 THEN ' + YEARLY + ' / -min(drawdown) ELSE 0 END))', 4)} AS calmar_ratio, {rounded('ln(1 + abs(' + sharpe_sql() + ' * sqrt(abs(' + YEARLY + ')) * greatest(0, 1 - avg(turnover) / max(gross_exposure))))', 4)} AS fitness, "
    f"{rounded('ln(1 + abs(sqrt(abs(' + YEARLY + ') / greatest(abs(avg(turnover) / max(gross_exposure)), 0.125e0)) * ' + sharpe_sql() + '))', 4)} AS fitness_wq, {rounded('covar_samp(ret, b) / var_samp(b)')} AS beta, "
    f"{rounded('avg(ret - b) / stddev_samp(ret - b) * sqrt(252e0)')} AS information_ratio, {rounded('skewness(ret)', 4)} AS skew, {rounded('kurtosis(ret) + 3', 4)} AS kurt FROM eq JOIN bench USING (date) GROUP BY segment"
)
DURATIONS = (
    "SELECT s.segment, coalesce(coalesce(avg(CASE WHEN NOT cur THEN days END), avg(days)), 0) * 1e0 AS avg_dd_days, coalesce(max(days), 0) AS max_dd_days, coalesce(max(CASE WHEN cur THEN days END), 0) AS current_dd_days FROM (SELECT DISTINCT segment FROM daily) s LEFT JOIN "
    "(SELECT segment, run, count(*) AS days, max(date) = max(last) AS cur FROM (SELECT *, sum(CASE WHEN underwater THEN 0 ELSE 1 END) OVER (PARTITION BY segment ORDER BY date) AS run, max(date) OVER (PARTITION BY segment) AS last FROM eq) WHERE underwater GROUP BY segment, run) r ON r.segment = s.segment GROUP BY s.segment"
)


def rank_within(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY segment, date) > 1 THEN rank() OVER (PARTITION BY segment, date, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY segment, date, {x}) - 1) / 2e0 END"


def corr_agg(x: str, y: str) -> str:
    a, b = (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END" for v in (x, y))
    return f"covar_samp({a}, {b}) / CASE WHEN stddev_samp({a}) * stddev_samp({b}) > 1e-9 THEN stddev_samp({a}) * stddev_samp({b}) END"


HORIZONS = (1, 2, 3, 5, 10, 21)
IC = [
    "i0 AS (SELECT segment, date, ticker, s2 AS signal, " + ", ".join(f"lead(returns, {h}) OVER (PARTITION BY segment, ticker ORDER BY date) AS f{h}" for h in HORIZONS) + " FROM book)",
    f"i1 AS (SELECT segment, date, ticker, {rank_within('signal')} AS r0, " + ", ".join(f"{rank_within(f'f{h}')} AS r{h}" for h in HORIZONS) + " FROM i0)",
    "ic AS (" + " UNION ALL ".join(f"SELECT segment, date, {h} AS horizon, {corr_agg('r0', f'r{h}')} AS ic FROM i1 GROUP BY segment, date" for h in HORIZONS) + ")",
    "ics AS (SELECT segment, horizon, avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS ratio, avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS pos, count(*) AS n_days FROM ic WHERE ic IS NOT NULL GROUP BY segment, horizon)",
]
DECAY = (
    "SELECT s.segment, {hl} AS half_life_days, {r2} AS r_squared FROM (SELECT DISTINCT segment FROM daily) s LEFT JOIN (SELECT segment, count(*) AS n, regr_slope(y, x) AS sl, regr_r2(y, x) AS r2 FROM "
    "(SELECT segment, horizon * 1e0 AS x, ln(v) AS y FROM (SELECT segment, horizon, ic * first_value(sign(ic)) OVER (PARTITION BY segment ORDER BY horizon) AS v FROM ics WHERE ic <> 0) WHERE v > 0) GROUP BY segment) f ON f.segment = s.segment"
).replace("{hl}", rounded(f"CASE WHEN n >= 2 AND sl < 0 THEN -{LN2} / sl END", 4)).replace("{r2}", rounded("CASE WHEN n >= 2 AND sl < 0 THEN f.r2 END", 5))
QUANTILES = (
    "SELECT segment, q AS quantile, {m} AS mean_return, count(*) AS n_days FROM (SELECT segment, date, q, avg(f1) AS r FROM (SELECT *, 1 + CAST(s >= e[1] AS INT) + CAST(s >= e[2] AS INT) + CAST(s >= e[3] AS INT) + CAST(s >= e[4] AS INT) AS q FROM "
    "(SELECT segment, date, signal AS s, f1, quantile_cont(signal, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY segment, date) AS e, count(*) OVER (PARTITION BY segment, date) AS n FROM i0 WHERE signal IS NOT NULL AND f1 IS NOT NULL) WHERE n >= 5) GROUP BY segment, date, q) GROUP BY segment, q"
).replace("{m}", rounded("avg(r)"))
STABILITY = f"SELECT segment, {rounded('avg(c)')} AS rank_stability FROM (SELECT segment, date, {corr_agg('r0', 'rb')} AS c FROM (SELECT *, lag(r0) OVER (PARTITION BY segment, ticker ORDER BY date) AS rb FROM i1) GROUP BY segment, date) GROUP BY segment"
EXPOSURE = ["x0 AS (SELECT segment, coalesce(sector, 'Unknown') AS g, date, sum(weight) AS net, sum(abs(weight)) AS gr, avg(returns) AS m, coalesce(sum(weight * returns), 0) AS act FROM book GROUP BY 1, 2, 3)", "xt AS (SELECT segment, coalesce(sector, 'Unknown') AS g, count(DISTINCT ticker) AS n_tickers FROM book GROUP BY 1, 2)",
            "xe AS (SELECT segment, g, avg(net) AS avg_net, avg(gr) AS avg_gross, coalesce(sum(net * m), 0) AS alloc, sum(act) AS total FROM x0 GROUP BY segment, g)"]
SIZES = [
    "z0 AS (SELECT segment, date, ticker, ticker_ord, weight, close * volume AS sz FROM book)",
    "z1 AS (SELECT *, count(*) OVER (PARTITION BY segment, date) AS n, row_number() OVER (PARTITION BY segment, date ORDER BY sz, ticker_ord) - 1 AS pl, sum(greatest(weight, 0)) OVER (PARTITION BY segment, date) AS lt, sum(greatest(-weight, 0)) OVER (PARTITION BY segment, date) AS st FROM z0 WHERE sz > 0)",
    "z2 AS (SELECT segment, date, CAST(floor(pl * 10 / n) AS INT) AS bucket, sum(greatest(weight, 0) / CASE WHEN lt > 0 THEN lt END) AS l, sum(greatest(-weight, 0) / CASE WHEN st > 0 THEN st END) AS s FROM z1 WHERE n >= 10 GROUP BY 1, 2, 3)",
    "z3 AS (SELECT segment, bucket, coalesce(avg(l), 0) AS ls, coalesce(avg(s), 0) AS ss FROM z2 GROUP BY segment, bucket)",
]
REGIMES = "(VALUES ('first_rates', DATE '1995-06-01', DATE '1996-06-01'), ('mid', DATE '1997-01-01', DATE '1998-06-01'), ('late', DATE '2000-01-01', DATE '2001-10-01'), ('empty', DATE '2008-01-01', DATE '2009-01-01'), ('short', DATE '1999-01-01', DATE '1999-02-01')) AS t(name, s, e)"
STRESS = (
    "SELECT segment, name, count(*) AS n_days, {sh} AS sharpe, {tot} AS total_return, {dd} AS max_drawdown, {hit} AS hit_rate, {yr} AS annualised_return, CASE WHEN {raw} >= 0.5 THEN 'good' WHEN {raw} >= -0.5 THEN 'warn' ELSE 'bad' END AS severity FROM (SELECT *, equity / max(equity) OVER (PARTITION BY segment, name ORDER BY date) - 1 AS drawdown FROM "
    f"(SELECT segment, name, date, ret, 1 + sum(ret) OVER (PARTITION BY segment, name ORDER BY date) AS equity FROM daily JOIN {REGIMES} ON date BETWEEN s AND e)) GROUP BY segment, name HAVING count(*) >= 5"
).replace("{sh}", rounded(sharpe_sql())).replace("{raw}", sharpe_sql()).replace("{yr}", rounded(f"ln(1 + {YEARLY})", 4)).replace("{tot}", rounded("sum(ret)")).replace("{dd}", rounded("min(drawdown)")).replace("{hit}", rounded("avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END)"))


# the expected largest of 20 standard normal values, by the usual approximation with Euler's constant
BEST_OF_20 = (1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / 20) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (20 * math.e))


def analytics() -> dict[str, str]:
    w = lambda extra, select: f"WITH {', '.join([*base_book(), *extra])} {select}"
    long, short = "CASE WHEN avg_net > 0 THEN avg_net END", "CASE WHEN avg_net < 0 THEN avg_net END"
    full63 = "count(ret) OVER w = 63"
    return {
        "analytics_summary": w(EQUITY, SUMMARY),
        "analytics_drawdowns": w(EQUITY, f"SELECT segment, date, {rounded('equity', 6)} AS equity, {rounded('drawdown', 6)} AS drawdown, underwater FROM eq"),
        "analytics_drawdown_durations": w(EQUITY, DURATIONS),
        "analytics_rolling_sharpe": w([], f"SELECT segment, date, {rounded(f'CASE WHEN {full63} THEN avg(ret) OVER w / sqrt(CASE WHEN var_samp(ret) OVER w > 1e-24 THEN var_samp(ret) OVER w END) * sqrt(252e0) END')} AS rolling_sharpe FROM daily WINDOW w AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"),
        "analytics_monthly": w([], f"SELECT segment, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {rounded('sum(ret)', 6)} AS ret FROM daily GROUP BY 1, 2, 3"),
        "analytics_yearly": w([], f"SELECT segment, CAST(year(date) AS INT) AS year, {rounded(sharpe_sql())} AS sharpe, {rounded('sum(ret)', 6)} AS annual_return, count(*) AS n_days FROM daily GROUP BY 1, 2"),
        "analytics_positive_months": w([], f"SELECT segment, {rounded('avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END)')} AS positive_months_pct FROM (SELECT segment, year(date), month(date), sum(ret) AS r FROM daily GROUP BY 1, 2, 3) GROUP BY segment"),
        "analytics_ic_series": w(IC, f"SELECT segment, date, horizon, {rounded('ic')} AS ic FROM ic"),
        "analytics_ic_summary": w(IC, f"SELECT segment, horizon, {rounded('ic')} AS ic, {rounded('ratio * sqrt(252e0)', 4)} AS icir, {rounded('ratio * sqrt(n_days)', 4)} AS ic_tstat, {rounded('pos')} AS ic_pct_positive, n_days FROM ics"),
        "analytics_ic_bands": w(IC, f"SELECT segment, date, {rounded('CASE WHEN count(*) OVER w = 21 THEN avg(ic) OVER w END')} AS mean, {rounded('CASE WHEN count(*) OVER w = 21 THEN avg(ic) OVER w - 2 * stddev_samp(ic) OVER w END')} AS low, {rounded('CASE WHEN count(*) OVER w = 21 THEN avg(ic) OVER w + 2 * stddev_samp(ic) OVER w END')} AS high FROM ic WHERE ic IS NOT NULL AND horizon = 1 WINDOW w AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"),
        "analytics_alpha_decay": w(IC, DECAY),
        "analytics_quantiles": w(IC, QUANTILES),
        "analytics_rank_stability": w(IC, STABILITY),
        "analytics_group_exposure": w(EXPOSURE, f"SELECT segment, g AS \"group\", {rounded('avg_net', 7)} AS avg_net, {rounded('avg_gross', 7)} AS avg_gross, n_tickers FROM xe JOIN xt USING (segment, g)"),
        "analytics_headline": w(EXPOSURE, f"SELECT segment, arg_max(g, {long}) AS max_long, {rounded(f'coalesce(max({long}), 0)', 7)} AS max_long_exposure, arg_min(g, {short}) AS max_short, {rounded(f'coalesce(min({short}), 0)', 7)} AS max_short_exposure FROM xe GROUP BY segment"),
        "analytics_group_series": w(EXPOSURE, f"SELECT segment, max(date) AS date, g AS \"group\", {rounded('avg(net)', 7)} AS net FROM (SELECT *, floor((dense_rank() OVER (PARTITION BY segment ORDER BY date) - 1) / ceil(nd / 20e0)) AS run FROM (SELECT *, (SELECT count(DISTINCT date) FROM x0 y WHERE y.segment = x0.segment) AS nd FROM x0)) GROUP BY segment, run, g"),
        "analytics_size_exposure": w([*SIZES, f"zc AS (SELECT segment, date, {corr_agg('weight', 'lsz')} AS c, count(CASE WHEN weight IS NOT NULL AND lsz IS NOT NULL THEN 1 END) AS n FROM (SELECT *, ln(CASE WHEN sz > 0 THEN sz END) AS lsz FROM z0) GROUP BY segment, date)"], f"SELECT segment, {rounded('avg(c)')} AS avg_corr, count(*) AS n_days FROM zc WHERE n >= 3 AND c IS NOT NULL GROUP BY segment"),
        "analytics_size_distribution": w(SIZES, f"SELECT segment, bucket, {rounded('ls', 6)} AS long_share, {rounded('ss', 6)} AS short_share FROM z3"),
        "analytics_size_tilt": w(SIZES, f"SELECT segment, {rounded('sum(bucket * ls)')} AS long_avg, {rounded('sum(bucket * ss)')} AS short_avg, {rounded('sum(bucket * ls) - sum(bucket * ss)')} AS tilt FROM z3 GROUP BY segment"),
        "analytics_attribution": w(EXPOSURE, f"SELECT segment, g AS \"group\", {rounded('alloc', 7)} AS allocation, {rounded('total - alloc', 7)} AS selection, {rounded('total', 7)} AS total, n_tickers FROM xe JOIN xt USING (segment, g)"),
        "analytics_attribution_totals": w(EXPOSURE, f"SELECT segment, {rounded('sum(alloc)', 6)} AS allocation, {rounded('sum(total - alloc)', 6)} AS selection, {rounded('100 * abs(sum(alloc)) / (abs(sum(alloc)) + abs(sum(total - alloc)))', 3)} AS allocation_pct FROM xe GROUP BY segment"),
        "analytics_stress": w([], STRESS),
        "analytics_costs": w([], COSTS),
        "analytics_compare_halves": w([f"hv AS (SELECT segment, {sharpe_sql()} AS sh, {YEARLY} AS yr, min(date) AS a, max(date) AS b FROM daily GROUP BY segment)"], HALVES),
        "analytics_size_quality": w([], "SELECT max(abs(close * volume)) < 10000 AS is_approximation FROM book"),
        "analytics_deflated_sharpe_20": w(EQUITY, f"SELECT segment, {rounded('(o - bar) * sqrt(252e0)', 4)} AS deflated_sharpe, {rounded('(o - bar) * sqrt(n - 1) / sqrt(CASE WHEN 1 - sk * o + (ku - 3) / 4 * o * o > 0 THEN 1 - sk * o + (ku - 3) / 4 * o * o END)', 4)} AS deflated_z FROM (SELECT *, {BEST_OF_20!r} / sqrt(n) AS bar FROM (SELECT segment, count(*) AS n, {sharpe_sql()} / sqrt(252e0) AS o, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM eq GROUP BY segment))"),
        "analytics_deflated_sharpe": w(EQUITY, f"SELECT segment, {rounded('(o - 0.5e0 / sqrt(n)) * 0e0 + sh')} AS sharpe, {rounded('o * sqrt(n - 1) / sqrt(CASE WHEN 1 - sk * o + (ku - 3) / 4 * o * o > 0 THEN 1 - sk * o + (ku - 3) / 4 * o * o END)', 4)} AS deflated_z FROM (SELECT segment, count(*) AS n, {sharpe_sql()} AS sh, {sharpe_sql()} / sqrt(252e0) AS o, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM eq GROUP BY segment)"),
    }


# --- walk-forward and batches ------------------------------------------------------------------------------------------------
WALK_WINDOWS = "JOIN (SELECT unnest(range(0, 20)) AS win) ON dates >= 36 AND win <= floor((dates - 36) / 12e0) AND place > win * 12 AND place <= win * 12 + 36"
WALK = book_ctes(REVERSAL, REVERSAL_STAGES, segment="CASE WHEN place - win * 12 <= 24 THEN 'train' ELSE 'test' END", extra=WALK_WINDOWS, by=("win", "segment"))


def walk_sql() -> str:
    side = lambda s, x: f"CASE WHEN segment = '{s}' THEN {x} END"
    parts = [f"{f}({side(s, 'date')}) AS {s}_{n}" for s in ("train", "test") for n, f in (("start", "min"), ("end", "max"))]
    parts += [f"{rounded(sharpe_sql(side(s, 'ret')), 4)} AS {s}_sharpe" for s in ("train", "test")]
    parts += [f"{rounded('sum(' + side('test', 'ret') + ')')} AS test_total_return", f"{rounded('sum(' + side('test', 'net') + ')', 1)} AS test_cumulative_pnl"]
    return f"WITH {', '.join(WALK)} SELECT CAST(win AS INT) AS \"window\", {', '.join(parts)} FROM daily GROUP BY win"


#: The cells that batch queries run: formula and, for SQL, the signal over the stages below.
CELL_STAGES = [f"{lag(C, 5)} AS c5, {lag(C, 3)} AS c3, {lag(C, 4)} AS c4", "close - c5 AS dl, close - c3 AS d3, close - c4 AS d4", f"{rank_sql('dl')} AS r5, {rank_sql('d3')} AS r3, {rank_sql('d4')} AS r4, {rank_sql(V)} AS rv"]
CELLS = {"-rank(delta(close, 5))": "-r5", "rank(volume)": "rv", "rank(volume) * returns": "rv * returns"}
SWEEP = "-rank(delta(close, {3..5}))"
SWEEP_CELLS = ["-r3", "-r4", "-r5"]


def cells_ctes(signals: list[str], oos: bool = True, base: list[str] = SUPPLIERS) -> list[str]:
    source = " UNION ALL ".join(f"SELECT *, {k} AS cell, {s} AS signal FROM {{last}}" for k, s in enumerate(signals))
    extra = {} if oos else {"segment": "'is'"}
    return book_ctes("", CELL_STAGES, by=("cell", "segment"), source=source, base=base, **extra)


def cells_sql(signals: list[str], oos: bool = True) -> str:
    return f"WITH {', '.join(cells_ctes(signals, oos))} SELECT CAST(cell AS INT) AS cell, segment, count(*) AS n_days, {rounded(sharpe_sql())} AS sharpe, {rounded('sum(ret)', 6)} AS total_return, {rounded('avg(turnover)', 1)} AS avg_turnover FROM daily GROUP BY cell, segment"


def blend_sql() -> str:
    weights = "(CASE WHEN coalesce(-r5, rv, rv * returns) IS NOT NULL THEN coalesce(-r5, 0) * 0.5e0 + coalesce(rv, 0) * 0.25e0 + coalesce(rv * returns, 0) * 0.25e0 END)"
    return select_daily(book_ctes(weights, CELL_STAGES))


def permutation_sql(orders: list[list[int]]) -> str:
    """Sharpe ratios of the supplier panel (-1) and of copies whose dates are in the given orders (places from 0)."""
    values = ", ".join(f"({k - 1}, {place + 1}, {source + 1})" for k, order in enumerate([list(range(len(orders[0]))), *orders]) for place, source in enumerate(order))
    base = [
        *SUPPLIERS, f"perm AS (SELECT * FROM (VALUES {values}) AS t(cell, place, source))", "dn AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM p))",
        "p2 AS (SELECT v.cell, d.date, q.* EXCLUDE (date) FROM perm v JOIN dn d ON d.k = v.place JOIN dn s ON s.k = v.source JOIN p q ON q.date = s.date)",
    ]
    each = lambda x: x.replace("PARTITION BY ticker", "PARTITION BY cell, ticker").replace("PARTITION BY date", "PARTITION BY cell, date")
    ctes = book_ctes(each(REVERSAL), [each(x) for x in REVERSAL_STAGES], base=base, by=("cell", "segment"), segment="'is'", first="p2")
    return f"WITH {', '.join(ctes)} SELECT CAST(cell AS INT) AS iteration, {rounded('CASE WHEN stddev_samp(ret) > 1e-12 THEN ' + sharpe_sql() + ' END', 4)} AS sharpe FROM daily GROUP BY cell"


POOL = "pool AS (SELECT cell AS id, date, ret FROM daily)"


def correlations_sql() -> str:
    return f"WITH {', '.join([*cells_ctes(list(CELLS.values()), False), POOL])} SELECT CAST(a.id AS INT) AS a, CAST(b.id AS INT) AS b, count(*) AS n, {rounded('corr(a.ret, b.ret)')} AS corr FROM pool a JOIN pool b ON a.date = b.date GROUP BY a.id, b.id"


BETTER = "o.sharpe >= a.sharpe AND o.turnover <= a.turnover AND (o.sharpe > a.sharpe OR o.turnover < a.turnover)"


def _strategies() -> str:
    """CTEs up to k (id, sharpe, turnover), all cells, and a, those that take part."""
    return f"WITH {', '.join(cells_ctes(SWEEP_CELLS + list(CELLS.values()), False))}, k AS (SELECT CAST(cell AS INT) AS id, floor({sharpe_sql()} * 1e5 + 0.27e0) / 1e5 AS sharpe, floor(avg(turnover) * 10 + 0.27e0) / 10 AS turnover FROM daily GROUP BY cell), a AS (SELECT * FROM k WHERE sharpe >= 0)"


def pareto_sql() -> str:
    best = f"(SELECT o.id FROM a o WHERE a.sharpe >= 0 AND o.turnover <= a.turnover AND EXISTS (SELECT 1 FROM a z WHERE {BETTER.replace('o.', 'z.')}) ORDER BY o.sharpe DESC, o.turnover, o.id LIMIT 1)"
    return f"{_strategies()} SELECT a.id, a.sharpe, a.turnover, a.sharpe >= 0 AND NOT EXISTS (SELECT 1 FROM a o WHERE {BETTER}) AS on_frontier, {best} AS dominated_by FROM k a".replace("FROM a o", "FROM (SELECT * FROM k WHERE sharpe >= 0) o").replace("FROM a z", "FROM (SELECT * FROM k WHERE sharpe >= 0) z")


def dominators_sql() -> str:
    return f"{_strategies()} SELECT a.id, coalesce(string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.id), '') AS dominated_by FROM k a LEFT JOIN k o ON a.sharpe >= 0 AND o.sharpe >= 0 AND {BETTER} GROUP BY a.id"


def store_sql(formulas: list[str]) -> str:
    names = ", ".join(f"({k}, '{f}')" for k, f in enumerate(formulas))
    return f"{_strategies()}, raw AS (SELECT CAST(cell AS INT) AS cell, {sharpe_sql()} AS s FROM daily GROUP BY cell) SELECT CAST(cell + 1 AS BIGINT) AS id, 'p' || cell AS name, expression, {rounded('s')} AS sharpe FROM raw JOIN (VALUES {names}) AS t(n, expression) ON n = cell WHERE s >= 0 AND cell > 0 ORDER BY s DESC, cell DESC LIMIT 4"


def signature_sql() -> str:
    one = "CAST('0x' || substr(md5(concat_ws('/', CAST(date AS VARCHAR), ticker, coalesce(CAST(CAST(floor(close * 1e6) AS BIGINT) AS VARCHAR), '-'))), 1, 15) AS BIGINT)"
    return query(SUPPLIERS, [], f"SELECT substr(md5(CAST(CAST(sum({one}) AS HUGEINT) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR)), 1, 16) AS signature FROM p")


# --- weights of blends, from the formulas' own in-sample returns -------------------------------------------------------------
def _weights_cte(method: str) -> str:
    """wt (w0, w1, w2), one row."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    wide = "wide AS (SELECT date, " + ", ".join(f"max(CASE WHEN cell = {k} THEN ret END) AS r{k}" for k in range(3)) + " FROM daily WHERE segment = 'is' GROUP BY date)"
    moments = "mo AS (SELECT " + ", ".join([*[f"avg(r{k}) AS m{k}" for k in range(3)], *[f"covar_samp(r{i}, r{j}) AS c{i}{j}" for i, j in pairs]]) + " FROM wide WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL)"
    inner = [*cells_ctes(list(CELLS.values())), wide, moments]
    total = lambda *x: " + ".join(x)
    if method == "inverse_variance":
        last = "SELECT " + ", ".join(f"(1 / c{k}{k}) / ({total(*[f'1 / c{j}{j}' for j in range(3)])}) AS w{k}" for k in range(3)) + " FROM mo"
    elif method == "mv_optimal":  # Cramer's rule on the covariances with the ridge
        inner.append("rg AS (SELECT * REPLACE (" + ", ".join(f"c{k}{k} + 1e-6 * (c00 + c11 + c22) / 3 AS c{k}{k}" for k in range(3)) + ") FROM mo)")

        def minor(column: int) -> str:
            at = lambda i, j: f"m{i}" if j == column else cov(i, j)
            return f"{at(0, 0)} * ({at(1, 1)} * {at(2, 2)} - {at(1, 2)} * {at(2, 1)}) - {at(0, 1)} * ({at(1, 0)} * {at(2, 2)} - {at(1, 2)} * {at(2, 0)}) + {at(0, 2)} * ({at(1, 0)} * {at(2, 1)} - {at(1, 1)} * {at(2, 0)})"

        inner.append("dt AS (SELECT " + ", ".join(f"{minor(k)} AS d{k}" for k in range(3)) + " FROM rg)")
        last = "SELECT " + ", ".join(f"d{k} / (d0 + d1 + d2) AS w{k}" for k in range(3)) + " FROM dt"
    else:  # the correlations' barrier problem, one coordinate after another: x = (sqrt(o * o + 4 / 3) - o) / 2, with o the others' pull
        inner.append("rr AS (SELECT c01 / sqrt(c00 * c11) AS r01, c02 / sqrt(c00 * c22) AS r02, c12 / sqrt(c11 * c22) AS r12, sqrt(c00) AS d0, sqrt(c11) AS d1, sqrt(c22) AS d2 FROM mo)")
        moved = lambda pull: f"(sqrt(pow({pull}, 2) + 4e0 / 3) - ({pull})) / 2"
        first = f"SELECT step, {moved('r01 * x1 + r02 * x2')} AS x0, x1, x2 FROM it, rr WHERE step < 200"
        second = f"SELECT step, x0, {moved('r01 * x0 + r12 * x2')} AS x1, x2 FROM ({first}), rr"
        inner.append(f"it AS (SELECT 0 AS step, 1e0 AS x0, 1e0 AS x1, 1e0 AS x2 UNION ALL SELECT step + 1, x0, x1, {moved('r02 * x0 + r12 * x1')} FROM ({second}), rr)")
        last = "SELECT " + ", ".join(f"(x{k} / d{k}) / (x0 / d0 + x1 / d1 + x2 / d2) AS w{k}" for k in range(3)) + " FROM it, rr WHERE step = 200"
    return f"wt AS MATERIALIZED (WITH RECURSIVE {', '.join(inner)} {last})"


def weighted_blend_sql(method: str) -> str:
    parts = ["-r5", "rv", "rv * returns"]
    signal = f"(CASE WHEN coalesce({', '.join(parts)}) IS NOT NULL THEN " + " + ".join(f"coalesce({p}, 0) * (SELECT w{k} FROM wt)" for k, p in enumerate(parts)) + " END)"
    ctes = book_ctes(signal, CELL_STAGES, base=[_weights_cte(method), *SUPPLIERS])
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT segment, date, {rounded('net', 0)} AS net, {rounded('turnover', 0)} AS turnover, {rounded('ret', 6)} AS ret FROM daily"


def regression_sql() -> str:
    """Least squares on five factors and a constant by Gauss-Jordan elimination, one stage a column, and Newey-West errors of each coefficient's score."""
    names, n = ["one", "mkt_rf", "smb", "hml", "rmw", "cma"], 6
    half = lambda k: f"coalesce(avg(CASE WHEN ticker_ord % {2 * k} < {k} THEN returns END), 0) - coalesce(avg(CASE WHEN ticker_ord % {2 * k} >= {k} THEN returns END), 0)"
    factors = f"fa AS (SELECT date, 1e0 AS x0, coalesce(avg(returns), 0) AS x1, {', '.join(f'{half(k)} AS x{k + 1}' for k in range(1, 5))} FROM p GROUP BY date)"
    ctes = [*book_ctes(REVERSAL, REVERSAL_STAGES, base=BRANDS, neutralization="market", segment="'is'"), factors, "rw AS (SELECT date, ret - 0.0001e0 AS y, x0, x1, x2, x3, x4, x5 FROM daily JOIN fa USING (date) WHERE ret IS NOT NULL)"]
    sums = [f"sum(x{i} * x{j}) AS a{i}_{j}" for i in range(n) for j in range(n)] + [f"{float(i == j)!r}::DOUBLE AS a{i}_{n + j}" for i in range(n) for j in range(n)] + [f"sum(x{i} * y) AS v{i}" for i in range(n)]
    ctes.append(f"g_0 AS (SELECT count(*) AS n, {', '.join(sums)} FROM rw)")
    values = ", ".join(f"v{i}" for i in range(n))
    for k in range(n):
        cells = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(n) for j in range(2 * n)]
        ctes.append(f"g_{k + 1} AS (SELECT n, {values}, {', '.join(cells)} FROM g_{k})")
    beta = ", ".join(" + ".join(f"a{i}_{n + j} * v{j}" for j in range(n)) + f" AS b{i}" for i in range(n))
    inverse = ", ".join(f"a{i}_{n + j} AS i{i}_{j}" for i in range(n) for j in range(n))
    ctes.append(f"be AS (SELECT n, greatest(1, CAST(floor(4 * pow(n / 100e0, 2e0 / 9)) AS INT)) AS lags, {beta}, {inverse} FROM g_{n})")
    fitted = " + ".join(f"b{i} * x{i}" for i in range(n))
    ctes.append("sc AS (SELECT date, lags, " + ", ".join(f"(y - ({fitted})) * (" + " + ".join(f"i{i}_{j} * x{j}" for j in range(n)) + f") AS s{i}" for i in range(n)) + " FROM rw, be)")
    most = 12
    ctes.append("lg AS (SELECT *, " + ", ".join(f"lag(s{i}, {d}) OVER (ORDER BY date) AS s{i}_{d}" for i in range(n) for d in range(1, most + 1)) + " FROM sc)")
    spread = lambda i: " + ".join([f"sum(s{i} * s{i})", *[f"2 * greatest(0, 1 - {d}e0 / (max(lags) + 1)) * coalesce(sum(s{i} * s{i}_{d}), 0)" for d in range(1, most + 1)]])
    ctes.append("er AS (SELECT " + ", ".join(f"sqrt(greatest({spread(i)}, 0)) AS e{i}" for i in range(n)) + " FROM lg)")
    shown = ["alpha", *names[1:]]
    one = lambda i: f"SELECT '{shown[i]}' AS name, {rounded(f'b{i} * {252.0 if i == 0 else 1.0}', 4)} AS value, {rounded(f'b{i} / CASE WHEN e{i} > 0 THEN e{i} END', 3)} AS t_stat FROM be, er WHERE n >= 60"
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(one(i) for i in range(n))


# --- sources -----------------------------------------------------------------------------------------------------------------
def normalized_sql() -> str:
    ctes = [
        *SUPPLIERS[:2], "raw AS (SELECT ticker, date, open, high, low, CASE WHEN month(date) % 5 <> 0 THEN close END AS close, CASE WHEN month(date) % 5 <> 0 THEN volume END AS volume FROM bars)",
        f"fi AS (SELECT *, last_value(close IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING) AS filled FROM raw)", f"n AS (SELECT *, filled / nullif(lag(filled) OVER ({T}), 0) - 1 AS returns, (high + low + close) / 3 AS vwap FROM fi)",
    ]
    return f"WITH {', '.join(ctes)} SELECT date, ticker, " + ", ".join(f"{rounded(c, 4)} AS {c}" for c in ("open", "high", "low", "close", "volume", "returns", "vwap")) + " FROM n"


def expanded_sql() -> str:
    supplier = ", ".join(SUPPLIERS[:2]).replace("trades", "t1").replace("bars", "b1")
    brand = ", ".join(BRANDS[:2]).replace("trades", "t2").replace("bars", "b2")
    return f"WITH {supplier}, {brand} SELECT date, ticker, {rounded('volume', 2)} AS value FROM b2 UNION ALL SELECT date, ticker, {rounded('volume * CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 THEN 2 ELSE 1 END', 2)} AS value FROM b1"


def merged_labels_sql() -> str:
    return f"WITH {SUPPLIERS[4]} SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 THEN 'Own' ELSE sector END AS sector, industry_group, industry, sub_industry FROM labels"


def statements_sql() -> str:
    names = ["revenue", "net_income", "operating_cash_flow", "capex"]
    columns = ", ".join(f"{rounded(f'{c} / 1000', 3)} AS {c}" for c in names)
    return f"WITH {FUNDAMENTALS[0]} SELECT ticker, report_date, {columns}, {rounded('(operating_cash_flow + capex) / 1000', 3)} AS free_cash_flow FROM (SELECT ticker, report_date, revenue, revenue * 0.2e0 - back * 0.1e0 AS net_income, revenue * 0.25e0 AS operating_cash_flow, -revenue * 0.05e0 AS capex FROM fq)"


def diversification_sql(chosen: list[tuple[int, int, int]]) -> str:
    values = ", ".join(str(tuple(c)) for c in chosen)
    return f"""WITH {', '.join([*cells_ctes(SWEEP_CELLS + list(CELLS.values()), False), POOL])}, chosen AS (SELECT * FROM (VALUES {values}) AS t(n, sample, id)),
books AS (SELECT n, sample, date, avg(ret) AS ret FROM pool JOIN chosen USING (id) GROUP BY n, sample, date HAVING count(*) = n), s AS (SELECT n, sample, {sharpe_sql()} AS s FROM books GROUP BY n, sample)
SELECT CAST(n AS INT) AS n, {rounded('median(s)')} AS median_sharpe, {rounded('quantile_cont(s, 0.25)')} AS q1, {rounded('quantile_cont(s, 0.75)')} AS q3, {rounded('min(s)')} AS "min", {rounded('max(s)')} AS "max", count(*) AS n_samples FROM s GROUP BY n"""


# --- catalog pieces and the example formulas -----------------------------------------------------------------------------------
def preview_sql() -> str:
    columns = ", ".join(f"{rounded(c, 4)} AS {c}" for c in ("open", "high", "low", "close", "volume", "returns", "vwap"))
    return query(SUPPLIERS, [], f"SELECT date, ticker, {columns} FROM p WHERE ticker = 'S1' ORDER BY date DESC LIMIT 30")


def labels_sql() -> str:
    levels = " UNION ALL ".join(f"SELECT '{c}' AS level, {c} AS label, count(DISTINCT ticker) AS n FROM p WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("sector", "industry_group", "industry", "sub_industry"))
    return query(SUPPLIERS, [], levels)


def membership_sql() -> str:
    out = "ticker_ord % 7 = 0 AND date < DATE '1997-01-01'"
    return query(SUPPLIERS, [], f"SELECT date, CAST(sum(CASE WHEN {out} THEN 0 ELSE 1 END) AS BIGINT) AS n_members, CAST(sum(CASE WHEN {out} THEN 1 ELSE 0 END) AS BIGINT) AS n_late FROM p GROUP BY date")


def missing_sql() -> str:
    return query(SUPPLIERS, [], "SELECT DISTINCT 'S' || c_custkey AS ticker FROM customer WHERE 'S' || c_custkey NOT IN (SELECT ticker FROM p)")


FULL = [*SUPPLIERS, *FUNDAMENTALS, *MACRO, "fm AS (SELECT f.*, md.* EXCLUDE (date) FROM f JOIN md ON md.date = f.date)"]
Z = "({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)"
MOM = lambda n: f"close / nullif({lag(C, n)}, 0) - 1"
EXAMPLE_SIGNALS: dict[str, tuple[str, list[str], str]] = {
    "momentum_20_decayed": ("none", [f"{MOM(20)} AS m", f"{rank_sql('m')} AS r"], decay("r", [float(k) for k in range(1, 21)])),
    "reversal_5_volscaled": ("market", [f"-({MOM(5)}) AS m, {agg('stddev_samp', R, 20)} AS rv"], f"({rank_sql('m')}) / (rv + 0.001e0)"),
    "close_to_high": ("none", [f"close / ({agg('max', C, 252)}) AS m"], rank_sql("m")),
    "sector_neutral_momentum": ("none", [f"{MOM(60)} AS m", f"{rank_sql('m')} AS r"], "r - avg(r) OVER (PARTITION BY date, sector)"),
    "pe_meanreversion": ("market", ["market_cap / nullif(net_income, 0) AS pe"], "-(" + Z.format(x="pe") + ")"),
    "quality_momentum_combo": ("sector", [f"net_income / nullif(total_equity, 0) AS roe, {MOM(60)} AS m"], Z.format(x="roe") + " + " + Z.format(x="m")),
    "vix_conditional_momentum": ("market", [f"{MOM(20)} AS m", f"{rank_sql('m')} AS r", "CASE WHEN coalesce(vix < 20, FALSE) THEN {'v': r} END AS e"], f"(last_value(e IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING)).v"),
    "yield_curve_reversal": ("market", [f"-({MOM(5)}) AS m", f"{rank_sql('m')} AS r"], "CASE WHEN term_spread_10y_2y < 0 THEN r END"),
    "volume_orthogonal_close": ("market", [f"{rank_sql(C)} AS a, {rank_sql(V)} AS b"], "a - sum(a * b) OVER (PARTITION BY date) / nullif(sum(b * b) OVER (PARTITION BY date), 0) * b"),
    "concentrated_top10": ("market", [f"{MOM(60)} AS m", f"{rank_sql('m')} AS r"], "CASE WHEN r IS NOT NULL AND row_number() OVER (PARTITION BY date, r IS NULL ORDER BY abs(r) DESC, ticker_ord) <= 10 THEN r ELSE 0 END"),
}


def example_sql(name: str) -> str:
    neutralization, stages, signal = EXAMPLE_SIGNALS[name]
    if name == "close_to_high":
        return select_daily(book_ctes(signal, stages, base=BRANDS, neutralization=neutralization))
    return select_daily(book_ctes(signal, stages, base=[*FULL, "p2 AS (SELECT * FROM fm)"], neutralization=neutralization, first="p2"))
