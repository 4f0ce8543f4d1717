"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from fieldloom.plans.registry import QUERIES, SQL

ROWS_ONLY = sorted(set(QUERIES) - set(SQL) - {"multiseed_runs"})  # tests/test_training_queries.py has that one


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0


def test_entry(spark, sf_dir):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["node", "n"]
    assert sum(r["n"] for r in df.collect()) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_all_names_are_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
