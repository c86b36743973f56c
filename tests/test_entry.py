"""The entry points: names, columns and the flagship query."""

import __spark_entry__ as entry


def test_names_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_flagship(spark):
    df = entry.entry(spark)
    assert "entropy" in df.columns and df.count() > 0
