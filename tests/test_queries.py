"""Every registered query of the core against its SQL statement, or at least its rows."""

import pytest

from octolake.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, same_as_sql):
    if name in catalog.SQL:
        same_as_sql(catalog.QUERIES[name], catalog.SQL[name])
    else:
        assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_core_does_not_need_the_subpackage():
    import pathlib

    for path in pathlib.Path(catalog.__file__).parents[1].rglob("*.py"):
        if "llm" not in path.parts:
            assert "octolake.llm" not in path.read_text()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
