"""Every SQL-expressible key against its DuckDB oracle on the sf0.01 tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle_compare import compare, duck

from conftest import SF01

_SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", sorted(_SQL))
def test_matches_oracle(spark, con, key):
    problems, _, _ = compare(spark, con, key, queries()[key], _SQL[key], SF01)
    assert not problems, problems


def test_entry_runs(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert len(rows) == 2 and {r["classifier"] for r in rows} == {"lexicon", "logistic"}


#: Keys that SQL can't express; those of the optional subpackage are listed by its own tests.
NO_SQL = {"ml_fit_text", "ml_train_epochs", "ml_score", "ml_test_metrics", "ml_epoch_log"}


def test_every_key_has_oracle_or_is_listed():
    from modlens.plans.catalog import QUERIES
    from modlens.plans.model_checks import CHECK_QUERIES
    from modlens.plans.models import MODEL_QUERIES
    from modlens.plans.oracle import ORACLE

    assert {*QUERIES, *MODEL_QUERIES, *CHECK_QUERIES} - set(ORACLE) == NO_SQL
