"""Every query against its SQL."""

from __future__ import annotations

import pytest

from tests.compare import check
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir):
    assert check(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, sf_dir) is None


def test_letters_balanced(spark, sf_dir):
    rows = catalog.QUERIES["letter_sequences"](spark, sf_dir).collect()
    n = [sum(r.label == k for r in rows) for k in (0, 1)]
    assert n[0] == n[1] > 0 and all(("AAA" in r.text) == bool(r.label) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
