"""Every query of the engine against its SQL twin, over whole tables of the smallest size."""

import pytest
from oracle import connect, same

from corpusloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    same(spark, duck, QUERIES[name], SQL[name], SF)


def test_what_has_no_twin_has_a_model():
    """``crawl_run`` is compared with a page-by-page model in test_crawl.py."""
    assert set(QUERIES) - set(SQL) == {"crawl_run"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
