import pytest

from dialoom.plans import reference
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(reference.ORACLE))
def test_matches_sql(spark, name):
    same(spark, reference.QUERIES[name], reference.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.ORACLE)))
def test_runs(spark, name):
    assert reference.QUERIES[name](spark, DATA).count() > 0
