import __spark_entry__ as entry


def test_entry_and_names(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    df = entry.entry(spark)
    assert df.columns == ["code", "trade_date", "value"] and df.count() > 0
