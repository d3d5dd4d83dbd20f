"""Many backtests as one job: sweeps, comparisons, blends and permutation tests.

All formulas are compiled over one panel; their signals become rows with a cell number, and the cell joins the segment
columns of the portfolio plan. A permutation test makes one copy of the panel per permutation the same way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions.performance import summary
from sigmill.functions.statistics import blend_weights, covariances

from .compiler import check
from .portfolio import Settings, daily, halves, positions, selected, sharpe, signal_rows
from .sweep import expand
from .syntax import ExpressionError

CELL = ("cell", "segment")


def cells(panel: DataFrame, formulas: list[str], settings: Settings) -> DataFrame:
    """The signal rows of all formulas, one under another, with their number as `cell`."""
    names = [f"c{k}" for k in range(len(formulas))]
    rows = signal_rows(panel, dict(zip(names, formulas)), settings)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), F.col(f"c{k}").alias("signal")) for k in range(len(formulas))]))
    return rows.withColumn("_e", each).select(*[c for c in rows.columns if c not in names], "_e.cell", "_e.signal")


def run_cells(panel: DataFrame, formulas: list[str], settings: Settings) -> DataFrame:
    """The daily tables of all formulas, by (cell, segment)."""
    rows = halves(selected(cells(panel, formulas, settings), settings, ("cell",)), settings)
    return daily(positions(rows, settings, CELL), settings, CELL)


def checked(formulas: list[str]) -> tuple[list[int], dict[int, str]]:
    """(numbers of the formulas that compile, messages of the others by number)."""
    good, bad = [], {}
    for k, formula in enumerate(formulas):
        try:
            check(formula)
            good.append(k)
        except ExpressionError as e:
            bad[k] = str(e)
    return good, bad


def compare(panel: DataFrame, formulas: list[str], settings: Settings = Settings()) -> DataFrame:
    """The summary of each formula, by (cell, segment)."""
    return summary(run_cells(panel, formulas, settings), by=CELL)


def sweep(panel: DataFrame, formula: str, settings: Settings = Settings(), rank_by: str = "sharpe") -> DataFrame:
    """The in-sample summary of every cell of a formula with ranges, with its parameters and formula, the best first. Cells that don't compile carry their error."""
    settings = settings.with_(run_oos=False)
    all_cells = expand(formula)
    good, bad = checked([text for _, text in all_cells])
    spark = panel.sparkSession
    number = len(all_cells[0][0])
    columns = ", ".join(f"p{k} double" for k in range(number))
    rows = [(k, text, bad.get(k), *[float(v) for v in parameters.values()]) for k, (parameters, text) in enumerate(all_cells)]
    named = spark.createDataFrame(rows, f"cell int, formula string, error string, {columns}")
    if not good:
        return named.withColumn(rank_by, F.lit(None).cast("double"))
    found = compare(panel, [all_cells[k][1] for k in good], settings).drop("segment")
    back = F.array(*[F.lit(k) for k in good])[F.col("cell")]
    return named.join(found.withColumn("cell", back), "cell", "left").orderBy(F.desc_nulls_last(rank_by), "cell")


def blended(rows: DataFrame, names: list[str], weights: list[float]) -> DataFrame:
    """rows with `signal`: the weighted sum of the named columns. A missing one counts as 0, but where all are missing the sum is too."""
    total = sum((F.coalesce(n, F.lit(0.0)) * F.lit(float(w)) for n, w in zip(names, weights)), F.lit(0.0))
    return rows.withColumn("signal", F.when(F.coalesce(*names).isNotNull(), total)).drop(*names)


def blend(panel: DataFrame, formulas: list[str], settings: Settings = Settings(), method: str = "equal", weights: list[float] | None = None, target_vol: float | None = None) -> tuple[list[float], DataFrame, DataFrame]:
    """(weights, positions, daily) of a blend of signals. Weights come from the formulas' own in-sample returns, or are the given ones brought to a sum of sizes of 1."""
    if method == "equal":
        given = np.array(weights if weights is not None else [1.0] * len(formulas), dtype=float)
        chosen = given / np.abs(given).sum()
    else:
        alone = run_cells(panel, formulas, settings.with_(run_oos=True)).where("segment = 'is'")
        mean, cov = covariances(alone.select(F.col("cell").alias("id"), "date", "ret"), list(range(len(formulas))))
        chosen = blend_weights(method, mean, cov, target_vol)
    names = [f"b{k}" for k in range(len(formulas))]
    rows = blended(signal_rows(panel, dict(zip(names, formulas)), settings), names, chosen.tolist())
    book = positions(halves(selected(rows, settings), settings), settings)
    return chosen.tolist(), book, daily(book, settings)


def permutations(panel: DataFrame, number: int, seed: int = 0) -> DataFrame:
    """(iteration, date, source): for each iteration the dates in a random order; iteration -1 leaves them as they are."""
    dates = [r["date"] for r in panel.select("date").distinct().orderBy("date").collect()]  # one row per date
    rows = [(-1, d, d) for d in dates]
    for k in range(number):
        order = np.random.default_rng(seed + k).permutation(len(dates))
        rows += [(k, d, dates[int(j)]) for d, j in zip(dates, order)]
    return panel.sparkSession.createDataFrame(rows, "iteration int, date date, source date")


def permutation_runs(panel: DataFrame, formula: str, settings: Settings = Settings(), number: int = 50, seed: int = 0) -> DataFrame:
    """(iteration, sharpe): in-sample over the whole history, of the panel (-1) and of its copies with whole dates in a random order."""
    order = permutations(panel, number, seed)
    keys = ("iteration",)
    copies = panel.withColumnRenamed("date", "source").join(order, "source").drop("source")
    rows = signal_rows(copies, {"signal": formula}, settings, keys)
    rows = selected(rows, settings, keys).withColumn("segment", F.lit("is"))
    by = (*keys, "segment")
    days = daily(positions(rows, settings, by), settings, by)
    spread = F.stddev_samp("ret")
    return days.groupBy("iteration").agg(F.when(spread > 1e-12, sharpe(F.col("ret"))).alias("sharpe"))


#: Verdicts, and the bounds of the p value, the mean of the permutations and the number that must complete.
REAL, LEAKAGE, BORDERLINE, NOISE, TOO_FEW, FAILED = "real-signal", "leakage-suspected", "borderline", "indistinguishable-from-noise", "too-few-shuffles-completed", "real-backtest-failed"
SIGNIFICANT, UNCLEAR, LEAKY, LEAST_COMPLETED = 0.05, 0.30, 0.5, 5


def verdict(runs: DataFrame, number: int | None = None) -> dict:
    """What permutation_runs says: p value, place among the permutations and a verdict. number: how many were asked for; those without a result count as failed."""
    values = {r["iteration"]: r["sharpe"] for r in runs.collect()}  # one row per permutation
    real = values.pop(-1, None)
    if real is None:
        return {"verdict": FAILED, "real_sharpe": None}
    found = np.array([v for v in values.values() if v is not None])
    out = {"real_sharpe": real, "n_completed": len(found), "n_failed": max(number or 0, len(values)) - len(found)}
    if len(found) < LEAST_COMPLETED:
        return out | {"verdict": TOO_FEW}
    p = (int((found >= real).sum()) + 1) / (len(found) + 1)
    out |= {"p_value": p, "percentile": 100 * float((found < real).mean()), "mean_shuffled": float(found.mean()), "median_shuffled": float(np.median(found))}
    if p < SIGNIFICANT:
        return out | {"verdict": LEAKAGE if out["mean_shuffled"] > LEAKY else REAL}
    return out | {"verdict": BORDERLINE if p < UNCLEAR else NOISE}
