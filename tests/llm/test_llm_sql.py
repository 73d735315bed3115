"""The queries of the subpackage with SQL give the rows DuckDB gives; the others run."""

import pytest

from tests.test_sql import canon, duck  # noqa: F401
from weft.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_rows(spark, sf, duck, name):  # noqa: F811
    ours, theirs = llm.QUERIES[name](spark, sf).toPandas(), duck.execute(llm.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)
