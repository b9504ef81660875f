"""Report semantics on hand-made data: NULL versus 0, gaps, empty input."""

from pyspark.sql import functions as F

from tillroll.operators.grain import invoice_grain
from tillroll.plans import cohorts, concentration, measures, sales
from tillroll.plans.clean import cancellations, valid_sales


def _line(inv, cust, day, value=10.0, qty=1, country="UK"):
    return (inv, "P", "Thing", qty, day, value, cust, country)


def test_mom_growth_skips_missing_month_and_nulls_zero_base(raw_of):
    raw = raw_of(
        [
            _line("1", "a", "2011-01-05", 100.0),
            _line("2", "a", "2011-03-05", 150.0),  # no February
            _line("3", "a", "2011-04-05", 75.0),
        ]
    )
    rows = sales.mom_growth(valid_sales(raw)).collect()
    assert [r.month_on_month_growth_pct for r in rows] == [None, 50.0, -50.0]
    assert [r.month_on_month_change for r in rows] == [None, 50.0, -75.0]


def test_retention_triangle_null_when_unobserved_zero_when_empty(raw_of):
    raw = raw_of(
        [
            _line("1", "a", "2011-01-05"),
            _line("2", "b", "2011-01-06"),
            _line("3", "a", "2011-02-07"),
            _line("4", "c", "2011-03-01"),
            _line("5", "c", "2011-04-30"),  # data ends on a month end: April is complete
        ]
    )
    s = invoice_grain(valid_sales(raw))
    rows = {str(r.cohort_month): r for r in cohorts.retention_triangle(s).collect()}
    jan = rows["2011-01-01"]
    assert jan.cohort_size == 2 and jan.m1 == 50.0 and jan.m2 == 0.0 and jan.m3 == 0.0 and jan.m4 is None
    mar = rows["2011-03-01"]
    assert mar.m1 == 100.0 and mar.m2 is None
    last = cohorts.last_complete_month(s).first().last_complete_month
    assert str(last) == "2011-04-01"


def test_concentration_cut_above_customer_count_is_null(raw_of):
    raw = raw_of([_line(str(i), f"c{i}", "2011-01-05", 10.0 * (i + 1)) for i in range(4)])
    rows = {r.top_n_customers: r for r in concentration.concentration_curve(invoice_grain(valid_sales(raw)), cuts=[1, 4, 5]).collect()}
    assert rows[1].cumulative_revenue == 40.0 and rows[1].pct_of_revenue == 40.0
    assert rows[4].cumulative_revenue == 100.0 and rows[4].pct_of_revenue == 100.0
    assert rows[5].cumulative_revenue is None and rows[5].pct_of_customers == 125.0


def test_empty_input_gives_one_row_and_zero_divides(raw_of):
    raw = raw_of([_line("C1", "a", "2011-01-05", 1.0, qty=-1)]).where(F.lit(False))
    kpi = measures.kpi_measures(valid_sales(raw), cancellations(raw)).collect()
    assert len(kpi) == 1
    k = kpi[0]
    assert k.m_net_sales == 0.0 and k.m_total_orders == 0 and k.m_average_order_value == 0.0
    assert k.m_cancellation_rate == 0.0
    overall = sales.overall_kpis(valid_sales(raw)).collect()
    assert len(overall) == 1 and overall[0].average_order_value is None


def test_slicer_filters_before_aggregating(raw_of):
    raw = raw_of(
        [
            _line("1", "a", "2011-01-05", 10.0, country="UK"),
            _line("2", "b", "2011-02-05", 20.0, country="FR"),
            _line("3", "c", "2011-03-05", 30.0, country="UK"),
        ]
    )
    sl = measures.Slicer(start="2011-02-01", countries=("UK",))
    r = measures.kpi_measures(valid_sales(raw), cancellations(raw), sl).first()
    assert r.m_net_sales == 30.0 and r.m_total_orders == 1


def test_slicer_reaches_cancellations_only_if_asked(raw_of):
    raw = raw_of([
        _line("1", "a", "2011-01-05", 10.0, country="UK"), _line("2", "b", "2011-03-05", 30.0, country="FR"),
        ("C3", "p", "P", -1, "2011-05-05", 7.0, "a", "UK"),
    ])
    sl = measures.Slicer(end="2011-02-01")
    whole = measures.kpi_measures(valid_sales(raw), cancellations(raw), sl).first()
    assert whole.m_total_orders == 1 and whole.m_cancelled_invoices == 1 and whole.m_cancellation_rate == 0.5
    cut = measures.kpi_measures(valid_sales(raw), cancellations(raw), sl, slice_cancellations=True).first()
    assert cut.m_cancelled_invoices == 0 and cut.m_cancellation_rate == 0.0


def test_ratios_are_not_rounded_and_any_measure_ranks(raw_of):
    raw = raw_of([_line(str(i), "a", "2011-01-05", p, country=c) for i, (p, c) in enumerate([(1.0, "A"), (1.0, "A"), (2.0, "A"), (5.0, "B")])])
    by = measures.measures_by(valid_sales(raw), ["country"])
    assert {r.country: r.m_average_order_value for r in by.collect()} == {"A": 400 / 300, "B": 5.0}
    assert [r.country for r in measures.top_n(by, "country", "m_average_order_value", 1).collect()] == ["B"]
    assert [r.country for r in measures.top_n_by_measure(valid_sales(raw), "country", "m_total_items", 1).collect()] == ["A"]
