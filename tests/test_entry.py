import __spark_entry__


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    out = __spark_entry__.entry(spark)
    assert out.columns == ["source", "n_rows", "n_langs", "p50", "p95", "p99"] and out.count() > 0
