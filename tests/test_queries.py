"""Every query against its SQL; those without are run."""

import pytest

from spanmill.queries import QUERIES, SQL
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.count() > 0
