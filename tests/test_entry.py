import __spark_entry__ as entry_module


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["level", "ix", "iy", "n_particles", "is_leaf"]
    assert rows.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
