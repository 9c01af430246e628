"""Every registered query: against its SQL, and on inputs too small for the thresholds."""

import pytest

import __spark_entry__ as entry
import check
from conftest import MEDIUM, SMALL

CHECKED = sorted(entry.oracle_sql())
MODELS = sorted(set(entry.queries()) - set(CHECKED))


def test_every_oracle_has_a_query():
    assert set(CHECKED) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 276 and "Strike_plus" in df.columns


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    assert check.compare(spark, name, MEDIUM).startswith("equal")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_small_input(spark, name):
    result = check.compare(spark, name, SMALL)
    assert result.startswith("rows-only" if name in MODELS else "equal"), result
