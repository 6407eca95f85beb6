"""Every registered query of the monitor against its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from dipwatch.plans.oracle import ORACLE
from dipwatch.plans.oracle_diagnosis import DIAGNOSIS_SQL
from tests.compare import connect, spark_rows, sql_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE | DIAGNOSIS_SQL))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(queries()[name](spark, FOLDER)) == sql_rows(con, oracle_sql()[name])


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_schema(spark):
    assert "consecutive_windows" in entry(spark).columns


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="test tables not present")
def test_exactly_the_planted_faults_become_incidents(spark):
    got = {r.cell_key: r.status for r in queries()["q33_incidents"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {
        "country=BR|issuerId=itau|merchantId=BR_STORE_01|paymentMethod=CARD|providerId=stripe": "resolved",
        "country=MX|issuerId=bbva_mx|merchantId=MX_STORE_02": "resolved",
    }
