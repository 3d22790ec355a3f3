"""What the driver contract hands out."""

import __spark_entry__ as entry


def test_oracle_values_are_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())
    assert all(callable(q) for q in entry.queries().values())
