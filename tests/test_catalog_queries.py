"""Every catalog query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

from lumensift.plans import catalog_queries as Q
from lumensift.plans import growth_queries as G
from lumensift.plans import review_queries as R

from .conftest import same_rows

assert G and R  # their queries are among those of Q

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, name):
    same_rows(Q.QUERIES[name](spark, TINY), Q.SQL[name], TINY)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], check=True, cwd=Path(__file__).parent.parent)
