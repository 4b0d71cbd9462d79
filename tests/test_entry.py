def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["group_i", "group_j", "id_i", "id_j", "d"]
    assert set(e.oracle_sql()) <= set(e.queries())
