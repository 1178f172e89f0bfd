"""Each registered query against its SQL twin."""

import pytest

from suitestat import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_twin(name, same):
    same(plans.QUERIES[name], plans.SQL[name])


def test_random_sample_is_reproducible(spark):
    a, b = ([tuple(r) for r in plans.QUERIES["st2_random_sample"](spark, "/root/testdata/sf0.001").collect()] for _ in range(2))
    assert a == b and len(a) == 4


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 16
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
