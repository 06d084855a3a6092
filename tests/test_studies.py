import pytest
from oracle import differences

import __spark_entry__ as entry
from lagwise.plans import research, studies

SQL = entry.oracle_sql()
ALL = studies.QUERIES + research.QUERIES


@pytest.mark.parametrize("query", [q for q in ALL if q.__name__ in SQL], ids=lambda q: q.__name__)
def test_equals_sql(spark, query):
    sf_dir = "/root/testdata/sf0.01"
    names, more, less, _ = differences(query(spark, sf_dir), SQL[query.__name__], sf_dir)
    assert not names and not more and not less


def test_only_principal_components_go_without_sql():
    assert {q.__name__ for q in ALL} - SQL.keys() == {"resid_pca"}
