"""Raw lines stored in buckets: the same results, without exchanges by customer."""

import pytest

from tests.conftest import SF_SMALL
from tillroll.operators import reversal
from tillroll.registry import JOBS
from tillroll.relations import Relations
from tillroll.sources.tables import CO_PARTITION, hot_lines, write_raw_tables

KEYS = ["customer_profile", "customer_cadence", "customer_cadence_net", "home_country", "first_second_purchase", "segment_summary", "dq_row_count"]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    plain = Relations.from_star(spark, SF_SMALL)
    write_raw_tables(plain.raw, "stored_raw", 6, str(tmp_path_factory.mktemp("tables")))
    yield plain, lambda: Relations.from_tables(spark, "stored_raw", home_country="NATION_0")
    for t in ("stored_raw", "stored_raw_anonymous", "stored_raw_reversals"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


@pytest.mark.parametrize("key", KEYS)
def test_stored_lines_give_the_same_results(both, key):
    plain, stored = both
    rows = lambda r: sorted((tuple(x) for x in JOBS[key](r).collect()), key=str)
    assert rows(stored()) == rows(plain)


@pytest.mark.parametrize("net", [False, True])
@pytest.mark.parametrize("way", ["broadcast", "join"])
def test_no_exchange_by_customer(spark, both, net, way, monkeypatch):
    """The end of the data is one row a task; the join with the reversal index is bucket by bucket."""
    if way == "join":
        monkeypatch.setattr(reversal, "BROADCAST_KEYS", -1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", CO_PARTITION: "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        r = both[1]()
        assert r.reversals.way == way
        for df in ((r.cadence_net, r.first_second) if net else (r.profile, r.cadence, r.segments)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(customer_id" not in plan
            assert ("SortMergeJoin" in plan) == (net and way == "join")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_home_country_needs_no_exchange(both):
    r = both[1]()
    plan = JOBS["home_country"](r)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_unbucketed_and_hot_customers(spark, raw_of, tmp_path):
    raw = raw_of([(str(i), "P", "X", 1, "2011-01-05", 1.00, "hot" if i % 3 else None, "UK") for i in range(30)])
    assert hot_lines(raw) == 20
    write_raw_tables(raw, "stored_flat", 0, str(tmp_path))
    r = Relations.from_tables(spark, "stored_flat")
    assert (r.raw.count(), r.sales.count(), r.net.count()) == (30, 20, 20)
    assert hot_lines(raw.limit(0)) == 0
    for t in ("stored_flat", "stored_flat_anonymous", "stored_flat_reversals"):
        spark.sql(f"DROP TABLE {t}")
