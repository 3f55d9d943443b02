import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlark.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="*", shuffle_partitions=8)


def sales_frame(spark, rows, extra_schema=""):
    schema = "date date, product_name string, quantity double, unit_price double, revenue double" + extra_schema
    return spark.createDataFrame(rows, schema)
