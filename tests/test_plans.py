"""Every query against its SQL; the others at least run."""

import pytest

from braidwork.plans import registry
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, DATA).limit(1).count() == 1
