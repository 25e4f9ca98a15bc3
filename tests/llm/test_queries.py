"""Queries with SQL equal it over whole tables; the others give one row per document or page."""

import pytest

import __spark_entry__ as driver
from check import compare, connect
from ratingml.llm import registry


@pytest.mark.parametrize("name", sorted(registry.CHECKS))
def test_equals_sql(spark, sf_dir, name):
    found = driver.queries()[name](spark, sf_dir).toPandas()
    assert compare(found, connect(sf_dir).execute(driver.oracle_sql()[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.CHECKS) - {"pipeline"}))
def test_one_row_each(spark, sf_dir, name):
    found = driver.queries()[name](spark, sf_dir)
    table, key = ("pages", "page_id") if name.startswith("op2_") else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in found.select(key).collect()) == ids


def test_one_query_per_operator():
    assert sorted(n.split("_")[0] for n in registry.QUERIES) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
