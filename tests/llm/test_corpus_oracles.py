"""The corpus queries against the SQL that expresses them."""

import pytest
from conftest import same_rows

from boardloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]))
