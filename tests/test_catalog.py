"""Every query with an oracle equals DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from varloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        cells = []
        for i in order:
            v = r[i]
            v = v.date() if hasattr(v, "hour") and not v.hour and not v.minute else v
            cells.append(round(v, 4) + 0.0 if isinstance(v, float) else v)
        out.append(tuple(cells))
    return [columns[i] for i in order], sorted(out, key=lambda r: ([str(v) for v in r if not isinstance(v, float)], [round(v, 2) for v in r if isinstance(v, float)]))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck.execute(catalog.oracle_sql()[name])
    expected = _rows([d[0] for d in con.description], con.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1]):
        for x, y in zip(a, b):
            assert math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4) if isinstance(x, float) and isinstance(y, float) else x == y


def test_entry_point_lists_the_catalog():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(f"{SF}/lineitem.parquet")


@pytest.mark.parametrize("name", ["garch_rolling_forecasts", "garch_refits", "garch_rolling_summary", "midas_forecasts"])
def test_rolling_queries_refit_as_often_as_the_operators(monkeypatch, name):
    """What the queries ask for; the fits themselves take minutes."""
    asked = []

    class Asked(Exception):
        pass

    def seen(_, settings, *args, **kwargs):
        asked.append((settings.window, settings.refit_every))
        raise Asked

    monkeypatch.setattr(catalog.views, "ret_daily", lambda *_: None)
    monkeypatch.setattr(catalog, "_lagged", lambda *_: None)
    monkeypatch.setattr(catalog.forecasts, "refits", seen)
    monkeypatch.setattr(catalog.forecasts, "midas_forecasts", seen)
    with pytest.raises(Asked):
        catalog.queries()[name](None, SF)
    assert asked == [(1000, 5)]
