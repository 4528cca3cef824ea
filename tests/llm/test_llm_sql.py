import os

import pytest

from sqlcheck import DATA, check
from termloom import llm

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, llm.queries()[name], llm.oracle_sql()[name])
