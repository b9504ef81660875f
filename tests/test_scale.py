"""Line-level work is spread by the number of lines, and sales and cancellations come from one read."""

import pytest

from tests.conftest import SF_SMALL
from tillroll.plans.clean import as_trade_lines, cancellations, trade_lines, valid_sales
from tillroll.plans.measures import cancellation_measures_by, cancellation_measures_of
from tillroll.registry import EXAMPLE_PAGE, JOBS
from tillroll.relations import Relations
from tillroll.sources import star

ROWS = [
    ("1", "P", " Cup ", 4, "2011-01-10 09:00", 1.00, "7", "UK"),
    ("1", "P", " Cup ", 4, "2011-01-10 09:00", 1.00, "7", "UK"),
    ("2", "P", "Cup", 4, "2011-01-12 09:00", 1.00, "7", "UK"),
    ("C3", "P", "Cup", -4, "2011-01-11 09:00", 1.00, "7", "UK"),  # reverses invoice 1, not the later 2
    ("C4", "P", "Cup", -4, "2011-01-09 09:00", 1.00, "7", "UK"),  # before any sale
    ("C5", "P", "Cup", -2, "2011-01-13 09:00", 1.00, "7", "UK"),  # no sale of that size
    ("C6", "P", "Cup", 4, "2011-01-13 09:00", 1.00, "7", "UK"),  # not negative: matches nothing
    ("C7", "P", "Cup", -4, "2011-01-13 09:00", 1.00, None, "UK"),  # no customer
    ("C8", None, "Cup", -3, "2011-01-13 09:00", 2.00, "7", "UK"),  # null keys never meet
    ("8", None, "Cup", 3, "2011-01-10 09:00", 2.00, "7", "UK"),
    ("C9", "Q", None, -1, "2011-01-13 09:00", 3.00, "8", "FR"),
    ("9", "Q", None, 1, "2011-01-10 09:00", 3.00, "8", "FR"),  # no name: no sale
    (None, "Q", "Jar", 1, "2011-01-10 09:00", 3.00, "8", "FR"),  # neither
    ("10", "Q", "Jar", 1, None, 3.00, "8", "FR"),
]


def _sorted(df):
    return sorted(map(repr, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trade_lines_are_sales_and_cancellations(raw_of):
    raw = raw_of(ROWS)
    once, apart = trade_lines(raw), as_trade_lines(valid_sales(raw), cancellations(raw))
    assert once.columns == apart.columns
    assert _sorted(once) == _sorted(apart)
    assert once.count() == 12


@pytest.mark.parametrize("partitions", [None, 7])
def test_invoices_by_product_without_a_second_copy_of_the_lines(raw_of, partitions):
    raw = raw_of(ROWS)
    df = cancellation_measures_of(trade_lines(raw), "product_name", "product_name", partitions)
    assert "Expand" not in _plan(df)
    assert _sorted(df) == _sorted(cancellation_measures_by(valid_sales(raw), cancellations(raw), *["product_name"] * 3))
    rows = {r.product_name: (r.m_cancelled_value, r.m_cancelled_invoices, r.m_total_orders) for r in df.collect()}
    assert rows == {"Cup": (24.0, 6, 3), "Jar": (0.0, 0, 1), None: (3.0, 1, 0)}


@pytest.mark.parametrize("way", [{}, {"BROADCAST_KEYS": 0}, {"BROADCAST_KEYS": 0, "MOST_BUCKETS": 0}])
def test_bracket_whatever_way_the_index_goes(raw_of, monkeypatch, way):
    from tillroll.operators import reversal

    for name, value in way.items():
        monkeypatch.setattr(reversal, name, value)
    got = JOBS["reversal_bracket"](Relations(raw_of(ROWS))).first()
    # Sales 8 + 4 + 6 + 3; identified cancellations 4 + 4 + 2 + 4 + 6 + 3, of which C3 reverses a sale.
    assert tuple(got) == (23.0, 8.0, 19.0, -2.0, 13.0)


def test_bracket_writes_its_lines_once_and_reads_only_them(spark):
    plan = _plan(JOBS["reversal_bracket"](Relations.from_star(spark, SF_SMALL)))
    assert "trade-lines" in plan and "lineitem" not in plan


@pytest.mark.parametrize("key", ["kpi_page", "kpi_page_sliced_cancellations", "m_cancellations_by_product", "top_n_cancelled_products", "dq_row_count"])
def test_every_line_is_joined_once(spark, key):
    plan = _plan(JOBS[key](Relations.from_star(spark, SF_SMALL)))
    assert sum("FileScan parquet [l_" in x for x in plan.splitlines()) == 1


def test_a_page_works_its_masks_out_once(spark):
    plan = _plan(JOBS["kpi_page"](Relations.from_star(spark, SF_SMALL)))
    # A setting of the page stands in no filter of the lines.
    assert not [x for x in plan.splitlines() if " Filter " in x and "2011-01-01" in x]
    assert len(EXAMPLE_PAGE) > 1


def test_many_lines_are_spread_by_their_number(spark, monkeypatch):
    small = Relations.from_star(spark, SF_SMALL)
    expected = _sorted(small.raw)
    assert small.partitions is None
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(star, "LINES_A_TASK", 500)
    monkeypatch.setattr(star, "HASHED_ROWS", 10)
    large = Relations.from_star(spark, SF_SMALL)
    assert large.partitions == -(-lines // 500)
    plan = _plan(large.raw)
    assert plan.count(f", {large.partitions}), REPARTITION_BY_NUM") >= 2 and "SortMergeJoin" not in plan
    assert _sorted(large.raw) == expected
    assert _sorted(JOBS["m_cancellations_by_product"](large)) == _sorted(JOBS["m_cancellations_by_product"](small))
