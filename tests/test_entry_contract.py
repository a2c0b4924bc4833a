"""The driver contract: every oracle has a query, every query is documented."""
import __spark_entry__ as E


def test_oracles_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 50


def test_every_query_documented_and_named():
    for name, fn in E.queries().items():
        assert callable(fn)
        assert fn.__doc__ and fn.__doc__.strip(), name


def test_oracles_are_single_statements():
    for name, sql in E.oracle_sql().items():
        assert ";" not in sql.strip().rstrip(";"), name
        assert "SELECT" in sql.upper(), name
