import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.schema import RAW_SCHEMA  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app="tillroll-tests", driver_memory="4g")
    yield s
    s.stop()


def _ts(x):
    if x is None or isinstance(x, dt.datetime):
        return x
    fmt = "%Y-%m-%d %H:%M" if len(x) > 10 else "%Y-%m-%d"
    return dt.datetime.strptime(x, fmt)


def raw_rows(spark, rows):
    """Raw lines from (invoice, stock, description, qty, 'YYYY-MM-DD[ HH:MM]', price, customer, country)."""
    data = [
        (inv, stock, desc, qty, _ts(ts), None if price is None else Decimal(str(price)), cust, country)
        for inv, stock, desc, qty, ts, price, cust, country in rows
    ]
    return spark.createDataFrame(data, RAW_SCHEMA)


@pytest.fixture
def raw_of(spark):
    return lambda rows: raw_rows(spark, rows)
