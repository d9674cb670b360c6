import pytest
from compare import same

from contactspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, duck, sf):
    same(queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name]))
