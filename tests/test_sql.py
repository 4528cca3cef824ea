import os

import pytest

from sqlcheck import DATA, check
from termloom import plans

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, plans.queries()[name], plans.oracle_sql()[name])


def test_flagship(spark):
    df = plans.flagship(spark, DATA)
    assert df.count() > 0 and "score" in df.columns
