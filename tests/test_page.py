"""A page of many filter contexts equals its single calls, and reads the lines once."""

import pytest

from tests.conftest import SF_SMALL
from tillroll.plans.measures import Slicer, kpi_measures
from tillroll.plans.page import MOST_CONTEXTS, kpi_page
from tillroll.registry import EXAMPLE_PAGE
from tillroll.relations import Relations


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("page") / "raw")
    Relations.from_star(spark, SF_SMALL).raw.repartition(6).write.parquet(path)
    return Relations(spark.read.parquet(path), home_country="NATION_0")


@pytest.mark.parametrize("sliced", [False, True])
def test_every_row_equals_its_single_call(stored, sliced):
    rows = {r.context: r for r in kpi_page(stored.sales, stored.cancels, EXAMPLE_PAGE, sliced).collect()}
    assert list(rows) == list(EXAMPLE_PAGE)
    for name in ("all", "q2", "half", "fees", "never"):
        single = kpi_measures(stored.sales, stored.cancels, EXAMPLE_PAGE[name], sliced).first()
        assert tuple(rows[name])[1:] == tuple(single), name


def test_ten_contexts_read_the_lines_once(stored):
    df = kpi_page(stored.sales, stored.cancels, EXAMPLE_PAGE, True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert len(scans) == 2  # sales lines, cancellations
    assert "Expand" not in plan


def test_full_mask_and_too_many_contexts(raw_of):
    from tillroll.plans.clean import cancellations, valid_sales

    raw = raw_of([("1", "P", "X", 2, "2011-01-05", 1.50, "a", "UK"), ("1", "Q", "Y", 1, "2011-01-05", 1.00, "a", "FR")])
    many = {f"c{i}": Slicer(countries=("UK",) if i % 2 else ("FR",)) for i in range(MOST_CONTEXTS)}
    got = kpi_page(valid_sales(raw), cancellations(raw), many).collect()
    assert [(r.m_net_sales, r.m_total_orders) for r in got] == [(3.0, 1) if i % 2 else (1.0, 1) for i in range(MOST_CONTEXTS)]
    with pytest.raises(ValueError):
        kpi_page(valid_sales(raw), cancellations(raw), {**many, "x": Slicer()})
    with pytest.raises(ValueError):
        kpi_page(valid_sales(raw), cancellations(raw), {})
