import datetime

import pytest

from sigmill.plans.compiler import evaluate
from sigmill.sources import fundamentals, macro, panel
from sigmill.sources.store import Store, result_json

D = datetime.date


def prices(spark, rows):
    return spark.createDataFrame(rows, "Ticker string, Date string, Open double, High double, Low double, Close double, Volume double, Extra string")


def test_normalised_and_dense(spark):
    rows = [(" a ", "2020-01-01", 1.0, 2.0, 0.5, 1.0, 10.0, "x"), ("A", "2020-01-02", 1.0, 2.0, 0.5, float("nan"), 10.0, "x"), ("A", "2020-01-04", 1.0, 2.0, 0.5, 2.0, 10.0, "x"), ("b", "2020-01-02", 1.0, 2.0, 0.5, float("inf"), 1.0, "x")]
    labels = spark.createDataFrame([("A", "Tech", "x")], "ticker string, sector string, returns string")
    got = panel.dense(panel.normalized(prices(spark, rows)), labels).orderBy("ticker", "date").collect()
    assert [(r["ticker"], str(r["date"]), r["close"], r["returns"], r["sector"], r["ticker_ord"]) for r in got] == [
        ("A", "2020-01-01", 1.0, None, "Tech", 1), ("A", "2020-01-02", None, 0.0, "Tech", 1), ("A", "2020-01-04", 2.0, 1.0, "Tech", 1),
        ("B", "2020-01-01", None, None, None, 2), ("B", "2020-01-02", None, None, None, 2), ("B", "2020-01-04", None, None, None, 2),
    ]


def test_macro_series_and_fill(spark, tmp_path):
    (tmp_path / "a.csv").write_text("observation_date,VIXCLS\n2020-01-01,10\n2020-01-02,.\n2020-01-03,12\n")
    (tmp_path / "b.csv").write_text("DATE,DGS10\n2020-01-02,2.0\n")
    (tmp_path / "c.csv").write_text("DATE,DGS2\n2020-01-02,0.5\n2020-01-05,9\n")
    series = macro.assemble([macro.read_series(spark, str(tmp_path / f"{n}.csv"), name) for n, name in (("a", "vix"), ("b", "treasury_10y_yield"), ("c", "treasury_2y_yield"))])
    base = spark.createDataFrame([(D(2020, 1, k), "A", 1) for k in (1, 2, 3, 6)], "date date, ticker string, ticker_ord int")
    got = macro.attach(base, series).orderBy("date").collect()
    assert [r["vix"] for r in got] == [10, 10, 12, 12] and [r["term_spread_10y_2y"] for r in got] == [None, 1.5, 1.5, 1.5]
    assert got[-1]["treasury_2y_yield"] == 0.5  # an observation off the calendar is lost


def test_factor_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Some preamble\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20200102,  1.00, 0.50,-0.25, 0.00, 0.10, 0.01\n20200103, 2, 1, 1, 1, 1, 0.01\n\nCopyright\n")
    got = macro.read_factors(spark, str(tmp_path / "f.csv")).orderBy("date").collect()
    assert len(got) == 2 and got[0]["date"] == D(2020, 1, 2) and got[0]["mkt_rf"] == pytest.approx(0.01) and got[0]["hml"] == pytest.approx(-0.0025)


def test_reports_and_as_of_join(spark):
    items = [("A", D(2019, 9, 30), "Total Revenue", 100.0), ("A", D(2019, 9, 30), "Operating Cash Flow", 9.0), ("A", D(2019, 9, 30), "Capital Expenditure", -4.0), ("A", D(2019, 12, 31), "Operating Revenue", 200.0), ("A", D(2019, 12, 31), "Basic EPS", 2.0)]
    quarters = fundamentals.reports(spark.createDataFrame(items, "ticker string, report_date date, item string, value double"))
    base = spark.createDataFrame([(D(2019, 12, 28), "A", 1), (D(2019, 12, 29), "A", 1), (D(2020, 3, 29), "A", 1), (D(2020, 3, 30), "A", 1), (D(2020, 3, 30), "B", 2)], "date date, ticker string, ticker_ord int")
    got = fundamentals.attach(base, quarters).orderBy("ticker", "date").collect()
    assert [r["revenue"] for r in got] == [None, 100, 100, 200, None]
    assert [r["free_cash_flow"] for r in got] == [None, 5, 5, None, None] and got[3]["eps"] == 2
    assert fundamentals.coverage(fundamentals.attach(base, quarters)) == pytest.approx(0.6)


def test_expanded_and_preview(spark):
    old = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 2), 2.0)], "ticker string, date date, close double")
    new = spark.createDataFrame([("A", D(2020, 1, 2), 5.0), ("B", D(2020, 1, 1), 7.0)], "ticker string, date date, close double")
    assert sorted(map(tuple, panel.expanded(old, new).collect())) == [("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 2), 5.0), ("B", D(2020, 1, 1), 7.0)]
    assert [r["date"] for r in panel.preview(old, "A", 1).collect()] == [D(2020, 1, 2)]
    assert panel.matrix(old, "close").columns == ["date", "ticker", "value"]
    with pytest.raises(KeyError):
        panel.matrix(old, "nope")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "alphas"))
    assert store.rows().count() == 0 and store.get(1) is None and not store.delete(1)
    series = result_json([{"segment": "is", "date": D(2020, 1, 1), "ret": 0.1}, {"segment": "oos", "date": D(2020, 1, 2), "ret": 0.2}], {"decay": 1})
    a = store.save(name="low", expression="close", sharpe=0.3, max_drawdown=-0.5, result_json=series, code_signature="c", data_signature="d")
    b = store.save(name="high", expression="rank(close)", sharpe=1.2, max_drawdown=-0.1, result_json='{"timeseries": {"dates": ["2019-01-01"], "returns": [0.5]}}', tag="new column")
    store.save(name="none", expression="volume")
    assert (a, b) == (1, 2) and store.get(2)["tag"] == "new column" and store.get(1)["tag"] is None
    names = lambda **how: [r["name"] for r in store.list(**how).collect()]
    assert names() == ["none", "high", "low"] and names(by="sharpe") == ["high", "low", "none"] and names(min_sharpe=1.0) == ["high"] and names(max_drawdown=-0.2) == ["high"] and names(signed=True) == ["low"] and names(limit=1) == ["none"]
    assert sorted((r["id"], str(r["date"]), r["ret"]) for r in store.returns().collect()) == [(1, "2020-01-01", 0.1), (1, "2020-01-02", 0.2), (2, "2019-01-01", 0.5)]
    assert "rank(close)" in store.export(2) and '"decay": 1' in store.export(1, "json")
    assert store.delete(2) and names() == ["none", "low"]
    with pytest.raises(KeyError):
        store.export(2)


def test_fields_by_hand(spark):
    rows = [("A", f"2020-01-{k:02d}", float(k), k + 2.0, k - 0.5, k + 1.0, 10.0 * k, "x") for k in range(1, 31)]
    base = panel.dense(panel.normalized(prices(spark, rows)))
    names = ["gap", "true_range", "body", "upper_shadow", "log_returns", "adv20", "momentum_5", "consecutive_up", "consecutive_down", "roll_spread", "corwin_schultz", "vpin_proxy"]
    got = evaluate(base, *names, names=names).orderBy("date").collect()
    last, first = got[-1], got[0]
    assert last["gap"] == 0.0 and last["true_range"] == 2.5 and last["body"] == 1 and last["upper_shadow"] == 1 and last["adv20"] == sum(10 * k for k in range(11, 31)) / 20
    assert last["momentum_5"] == pytest.approx(31 / 26 - 1) and last["consecutive_up"] == 29 and last["consecutive_down"] == 0 and first["consecutive_up"] == 0
    assert first["corwin_schultz"] is None and first["adv20"] is None and last["vpin_proxy"] == pytest.approx(1) and last["roll_spread"] is None
