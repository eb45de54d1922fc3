import __spark_entry__ as entry


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(entry.entry(spark).columns) == 7
