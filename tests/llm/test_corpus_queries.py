import pytest
from oracle import DATA, connect, same_rows

from lattisym.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        same_rows(spark, connect(), QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, str(DATA)).count() > 0
