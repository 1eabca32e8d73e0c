import pytest

from chronolith.plans import catalog
from tests.oracle import DATA, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(spark, name):
    got = spark_rows(catalog.queries()[name](spark, DATA))
    assert got == duck_rows(catalog.oracle_sql()[name])
    spark.catalog.clearCache()
