"""Every registered query against its SQL form."""

import pytest
from conftest import SMALL
from oracle import differences

import __spark_entry__ as entries

@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(spark, entries.queries()[name], entries.oracle_sql()[name], SMALL) is None


def test_names():
    assert set(entries.ORACLES) == set(entries.QUERIES)


def test_entry(spark):
    rows = entries.entry(spark)
    assert rows.columns == ["query_id", "rank", "id", "file_path", "language", "content_md5", "score"]
    assert rows.count() > 0

