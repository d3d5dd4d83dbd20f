"""Queries against their SQL at the smallest scale."""

import duckdb
import pytest

from sigmill import queries as engine

SF = "/root/testdata/sf0.001"
SQL, QUERIES = engine.oracle_sql(), engine.queries()
SAMPLE = ["flagship", "portfolio_costs", "portfolio_walk_forward", "analytics_summary", "analytics_ic_summary", "batch_compare", "pool_pareto", "fields_fundamental", "fields_volatility", "dsl_hump", "dsl_trade_when", "dsl_ts_corr", "dsl_bucket", "example_sector_neutral_momentum"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    rel = db.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    clean = lambda rows: sorted(([None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r] for r in rows), key=str)
    at = [list(rel.columns).index(c) for c in columns]
    assert clean(got.select(*columns).collect()) == clean([[r[k] for k in at] for r in rel.fetchall()])


def test_every_function_and_field_has_a_query():
    from sigmill.functions.catalog import load
    from sigmill.functions.fields import FIELDS
    from sigmill.oracles import FIELD_SETS, OPERATORS, RATIOS

    assert set(load()) <= set(OPERATORS)
    derived = {n for n, f in FIELDS.items() if f.build is not None}
    assert derived <= {n for _, columns, _ in FIELD_SETS.values() for n in columns} | set(RATIOS)
    assert set(SQL) <= set(QUERIES)
