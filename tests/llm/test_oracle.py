import pytest

from sonorant.llm.queries import ORACLE, QUERIES
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name])
    assert ours == theirs
