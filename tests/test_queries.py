import os

import pytest

import __spark_entry__ as entry
from workloads.check import compare

SF = "/root/testdata/sf0.001"
QUICK = ("regime_counts", "features_technical", "safeguard_gate", "regret_summary", "dataset_fingerprint", "capital_ledger")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    text, ok = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text
