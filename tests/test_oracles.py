import pytest
from compare import same

import __spark_entry__ as entry

NAMES = [n for p in entry.PLANS for n in p.ORACLE]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(name, spark, duck, sf):
    same(entry.queries()[name](spark, sf), duck.sql(entry.oracle_sql()[name]))
