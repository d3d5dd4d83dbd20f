import datetime
import json

import pytest

from sigmill.functions.statistics import git_hash
from sigmill.sources import universe

D = datetime.date


def test_labels_by_precedence(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in ({"ticker": "A", "sector": "new"}, {"ticker": "B", "sector": "cached", "industry": "i"}, {"sector": "nobody"})))
    first = spark.createDataFrame([("A", "old"), ("C", None)], "ticker string, sector string")
    got = {r["ticker"]: (r["sector"], r["industry"]) for r in universe.merged_labels(first, universe.read_labels(spark, str(tmp_path / "a.json"))).collect()}
    assert got == {"A": ("old", None), "B": ("cached", "i"), "C": (None, None)}


def test_universes_and_members(spark, tmp_path):
    spark.createDataFrame([("u", "B", 2), ("u", "A", 1), ("u", "A", 3), ("v", "C", 1)], "universe string, ticker string, ord int").write.parquet(str(tmp_path / "u"))
    assert universe.read_universes(spark, str(tmp_path / "u")) == {"u": ("A", "B"), "v": ("C",)}
    panel = spark.createDataFrame([(D(2020, 1, k), t) for k in (1, 2) for t in "AB"], "date date, ticker string")
    late = spark.createDataFrame([("B", D(2020, 1, 2))], "ticker string, join_date date")
    assert sorted(tuple(r) for r in universe.membership(panel, late).collect()) == [(D(2020, 1, 1), 1, 1), (D(2020, 1, 2), 2, 0)]
    wanted = spark.createDataFrame([(" a",), ("x",), ("X",)], "ticker string")
    assert [r[0] for r in universe.missing(wanted, panel).collect()] == ["X"]


def test_git_hash(tmp_path):
    assert git_hash(tmp_path) is None


def test_catalogue(spark):
    known = universe.Catalogue({"first": ("A", "B", "A"), "second": ("B", "C")})
    assert known.list() == [{"name": "first", "n_tickers": 2}, {"name": "second", "n_tickers": 2}] and known.get() == ("A", "B") and known.union() == ("A", "B", "C")
    labels = spark.createDataFrame([("A", "x"), ("C", "y"), ("D", "z")], "ticker string, sector string")
    assert [r["ticker"] for r in known.labels("second", labels).collect()] == ["C"]
    for name in ("third", None):
        with pytest.raises(KeyError):
            (universe.Catalogue({}) if name is None else known).get(name)
