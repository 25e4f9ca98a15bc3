"""Every registered query with a SQL check equals it; the others give rows."""

import pytest

import __spark_entry__ as driver
from check import compare, connect

CHECKS = driver.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


# queries of the optional subpackage have tests of their own
@pytest.mark.parametrize("name", sorted(n for n in CHECKS if not n.startswith("op")))
def test_query_equals_sql(spark, sf_dir, db, name):
    found = driver.queries()[name](spark, sf_dir).toPandas()
    assert compare(found, db.execute(CHECKS[name]).df()).startswith("ok")


# these take minutes: whole grids (small ones are in tests/test_tuning.py) and leaf-wise fits (tests/test_boosting.py)
SLOW = ("tun2", "tun3", "tun4", "eva1_eva2_holdout_classifier", "mod7_boosted_on_categories", "job_train_on_categories")
UNCHECKED = sorted(n for n in set(driver.queries()) - set(CHECKS) if not n.startswith(("op", "pipeline", *SLOW)))


@pytest.mark.parametrize("name", UNCHECKED)
def test_query_gives_rows(spark, sf_dir, name):
    assert not driver.queries()[name](spark, sf_dir).isEmpty()


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(driver.queries())


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() == 3
