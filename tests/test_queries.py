import sys

import pytest

from ledgerloom.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        compare(df, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_without_the_training_data_queries(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("ledgerloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerloom.llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
