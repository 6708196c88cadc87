"""A join that runs to its end has no batch without data, and the session's settings come back."""

import __spark_entry__
from conftest import rows, sql_rows

from sedgewren.streaming import keyed


def test_a_join_has_batches_with_data_only(spark, duck, sf, monkeypatch):  # F10
    numbers, made, name = [], keyed.batches, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = {n: spark.conf.get(n, None) for n in keyed.PLAIN}

    def batches(path):
        write = made(path)
        return lambda batch, n: (numbers.append((n, spark.conf.get(name))), write(batch, n))[1]

    monkeypatch.setattr(keyed, "batches", batches)
    df = __spark_entry__.queries()["st_joined_once"](spark, sf)
    names, want = sql_rows(duck, __spark_entry__.oracle_sql()["st_joined_once"])
    assert sorted(df.columns) == names and rows(df) == want
    assert numbers == [(0, "false"), (0, "false")]
    assert {n: spark.conf.get(n, None) for n in keyed.PLAIN} == before
