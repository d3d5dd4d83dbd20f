import pytest

from sigmill.functions.catalog import catalog, load
from sigmill.functions.fields import FIELDS
from sigmill.plans.compiler import check
from sigmill.plans.lint import lint
from sigmill.plans.sweep import expand
from sigmill.plans.syntax import Binary, Call, ExpressionError, Field, Negate, Number, field_names, fold, parse


def test_tree():
    assert parse("-rank(delta(close, 5)) * 2 + vix/3") == Binary("+", Binary("*", Negate(Call("rank", (Call("delta", (Field("close"), Number(5))),))), Number(2)), Binary("/", Field("vix"), Number(3)))
    assert parse("1 - 2 - 3") == Binary("-", Binary("-", Number(1), Number(2)), Number(3))
    assert parse("+close") == Field("close") and parse("range") == Field("range_") and parse("f()") == Call("f", ())
    assert isinstance(parse("2.0").value, float) and isinstance(parse("2").value, int)


@pytest.mark.parametrize("bad", ["", "1..2", "1.2.3", ".", "a b", "f(1,", "f(1,)", "(1", "1)", "a $ b", "1e5", "rank(é)", "a,b"])
def test_syntax_errors(bad):
    with pytest.raises(ExpressionError):
        parse(bad)


def test_unknown_field():
    with pytest.raises(ExpressionError, match="unknown field"):
        parse("colse", {"close"})


def test_fold():
    assert fold(parse("delay(close, 0 - 1)")) == Call("delay", (Field("close"), Number(-1)))
    assert fold(parse("close * (2 + 3 * 4)")) == Binary("*", Field("close"), Number(14))
    assert fold(parse("1 / 0")) == Binary("/", Number(1), Number(0))


@pytest.mark.parametrize(
    ("formula", "message"),
    [
        ("delay(close, 0 - 1)", "future"), ("delta(close, -3)", "future"), ("ts_mean(close, 0)", "over 0 rows"), ("ts_mean(close)", "lacks"), ("ts_mean(close, volume)", "constant"), ("nope(close)", "unknown function"),
        ("rank(close, 2)", "does not take"), ("group_mean(close, volume)", "label"), ("close + sector", "label"), ("rank(sector)", "label"), ("tail(close, volume, 1, 2)", "number"),
    ],
)
def test_checks(formula, message):
    with pytest.raises(ExpressionError, match=message):
        check(formula)


def test_warnings():
    assert [f.severity for f in lint(fold(parse("ts_mean(delay(close, 0), 505)")))] == ["warning", "warning"]
    assert lint(fold(parse("ts_mean(close, 504)"))) == []


def test_registries():
    assert len(catalog()) == 82 and len(load()) == 82
    assert all(f["description"] for f in catalog())
    for name in ("net_margin", "earnings_yield", "dividend_yield", "shares_outstanding", "market_cap", "dividends_paid", "sector"):
        assert name in FIELDS
    assert field_names(parse("rank(close) + roe")) == {"close", "roe"}


def test_sweep():
    cells = expand("ts_mean(close, {2..4}) * {0.5..1:0.25}")
    assert len(cells) == 9 and cells[1] == ({"p0": 2, "p1": 0.75}, "ts_mean(close, 2) * 0.75") and cells[-1][1] == "ts_mean(close, 4) * 1.0"
    for bad in ("close", "{1..2:0}", "{1..2:-1}", "{3..1}", "{1..51}"):
        with pytest.raises(ExpressionError):
            expand(bad)
