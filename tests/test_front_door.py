import pytest

from sigmill import cli
from sigmill.api import EXAMPLES, Workspace
from sigmill.plans.compiler import check
from sigmill.plans.portfolio import Settings
from sigmill.sources import macro, panel
from sigmill.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    base = panel.supplier_panel(spark, SF).persist()
    return Workspace(base, {"few": ("S1", "S2", "S3")}, macro.equal_weight(base), macro.panel_factors(base), Store(spark, str(tmp_path_factory.mktemp("store") / "alphas")))


def test_catalogs(space):
    assert len(space.operators()) == 82 and len(space.fields()) > 100 and space.neutralizations()[:3] == ["none", "market", "sector"]
    assert space.preview("S1").count() == 30
    for formula, _ in space.examples().values():
        check(formula)
    assert len(EXAMPLES) == 10


def test_validate(space):
    assert space.validate("rank(delta(close, 5))") == {"valid": True, "errors": [], "warnings": [], "fields": ["close"]}
    assert space.validate("ts_mean(close, 600)")["warnings"]
    for bad in ("rank(", "nope(close)", "delay(close, -1)", "-zscore(pe_ratio)", "rank(close, 1)"):
        assert not space.validate(bad)["valid"]


def test_simulate(space):
    out = space.simulate("-rank(delta(close, 5))", trials=10, size="dollar_volume")
    rows = {r["segment"]: r for r in out["summary"].collect()}
    assert set(rows) == {"is", "oos"} and out["verdict"]["severity"] and "alpha_annualized" in (out["factors"] or {"alpha_annualized": 0})
    for name in ("drawdowns", "rolling_sharpe", "monthly", "ic_summary", "alpha_decay", "quantiles", "exposure", "attribution", "size_exposure", "size_distribution"):
        assert out[name].count() > 0, name
    assert space.walk_forward("close", Settings(walk_forward_train=24, walk_forward_test=12, walk_forward_step=12)).count() == 4
    with pytest.raises(ValueError):
        space.compare(["close"])


def test_saved(space):
    for formula in ("-rank(delta(close, 5))", "rank(volume)", "-rank(volume)"):
        space.save(formula, formula)
    assert space.verify(1)["matches"] and space.verify(1)["same_data"] and space.verify(1)["same_code"]
    assert space.saved_correlations().count() == 9 and space.saved_pareto().count() >= 1
    assert [r["n"] for r in space.diversification_curve(samples=3).collect()] == [1, 2, 3]
    with pytest.raises(KeyError):
        space.verify(99)
    other = Settings(universe=("S1", "S2", "S3", "S5"), booksize=1e6, neutralization="none", run_oos=False)
    id_ = space.save("few", "rank(volume)", other)
    assert space.verify(id_)["matches"] and Settings.restored(other.saved() | {"gone": 1}) == other and Settings.restored(None) == Settings()
    assert space.store.get(id_)["sharpe"] != space.store.get(2)["sharpe"]
    space.simulate("close")
    held = list(space._held)
    space.simulate("volume")
    assert held and not any(df.is_cached for df in held) and all(df.is_cached for df in space._held)
    space.release()


def test_deletion_that_was_cut_off(spark, tmp_path):
    store = Store(spark, str(tmp_path / "alphas"))
    for name in ("a", "b"):
        store.save(name=name, expression="close", sharpe=1.0)
    (tmp_path / "alphas").rename(tmp_path / "alphas.old")
    assert [r["name"] for r in store.list().collect()] == ["b", "a"] and store.delete(1) and [r["id"] for r in store.list().collect()] == [2]
    assert not (tmp_path / "alphas.old").exists() and not store.delete(1)


def test_command_line(spark, tmp_path, capsys):
    rows = panel.supplier_months(spark, SF)
    rows.write.parquet(str(tmp_path / "ohlcv"))
    where = ["--ohlcv", str(tmp_path / "ohlcv"), "--store", str(tmp_path / "store")]
    run = lambda *a: cli.main(list(a), spark)
    assert run("run", "rank(volume)", "--save", "one", *where) == 0 and "saved as 1" in capsys.readouterr().out
    assert run("run", "rank(", *where) == 1
    assert run("list", "--store", str(tmp_path / "store")) == 0 and "one" in capsys.readouterr().out
    assert run("export", "1", "--store", str(tmp_path / "store")) == 0 and run("export", "7", "--store", str(tmp_path / "store")) == 2
    assert run("verify", "1", *where) == 0 and run("verify", "9", *where) == 2
    assert run("run", "rank(volume)", "--save", "two", "--universe", "S1,S2,s3", "--booksize", "1000", "--neutralization", "none", *where) == 0
    assert run("verify", "2", "--tolerance", "1e-9", *where) == 0
    spark.createDataFrame([("few", "S1", 1), ("few", "S4", 2)], "universe string, ticker string, ord int").write.parquet(str(tmp_path / "universes"))
    named = ["--universes", str(tmp_path / "universes")]
    assert run("run", "close", "--universe", "few", *named, *where) == 0 and run("run", "close", "--universe", "none", *named, *where) == 2
    (tmp_path / "vix.csv").write_text("DATE,VIX\n1992-01-01,15\n1995-01-01,25\n")
    assert run("run", "trade_when(less(vix, 20), rank(volume))", "--macro", f"vix={tmp_path / 'vix.csv'}", *where) == 0 and run("run", "rank(vix)", *where) == 1
    capsys.readouterr()
    assert run("list", "--has-provenance", "--store", str(tmp_path / "store")) == 0 and "two" in capsys.readouterr().out
    assert run("compare", "close", "volume", *where) == 0 and run("compare", "close", "volum", *where) == 1
    assert run("optimize", "delta(close, {1..2})", "--min-sharpe", "-1000", *where) == 0 and run("optimize", "delta(close, {1..2})", "--min-sharpe", "1e9", *where) == 1
    assert run("shuffle", "rank(volume)", "--number", "5", *where) in (0, 1) and run("stress", "rank(volume)", *where) == 0
