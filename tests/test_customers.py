"""90-day segments and the cadence rule on hand-made customers."""

from tillroll.plans.cadence import OVERDUE, SINGLE, TWO, WITHIN, customer_cadence
from tillroll.plans.customers import customer_profile


def _line(inv, cust, day, value=10.0, qty=1):
    return (inv, "P", "Thing", qty, day, value, cust, "UK")


def test_boundaries_of_the_90_day_rule(raw_of):
    raw = raw_of(
        [
            _line("1", "hv", "2011-01-01", 500.0),
            _line("2", "hv", "2011-09-02", 500.0),  # spend exactly 1000, quiet exactly 90
            _line("3", "end", "2011-12-01"),
            _line("4", "one", "2011-12-01"),
            _line("5", "rep", "2011-01-01"),
            _line("6", "rep", "2011-02-01"),
        ]
    )
    seg = {r.customer_id: (r.customer_segment, r.days_since_last_order) for r in customer_profile(sales(raw)).collect()}
    assert seg["hv"] == ("High-value active", 90)
    assert seg["one"][0] == "One-time customer"
    assert seg["rep"][0] == "At-risk repeat customer"


def sales(raw):
    """The published basis at the invoice grain, as customer-level jobs take it."""
    from tillroll.operators.grain import invoice_grain
    from tillroll.plans.clean import valid_sales

    return invoice_grain(valid_sales(raw))


def test_occasions_collapse_same_day_invoices(raw_of):
    raw = raw_of(
        [
            _line("1", "a", "2011-01-01 09:00"),
            _line("2", "a", "2011-01-01 15:00"),
            _line("3", "a", "2011-01-11"),
            _line("4", "a", "2011-01-22"),
            _line("9", "z", "2011-03-01"),
        ]
    )
    r = {x.customer_id: x for x in customer_cadence(sales(raw)).collect()}["a"]
    assert r.total_invoices == 4 and r.purchase_occasions == 3
    assert r.shortest_gap_days == 10 and float(r.median_gap_days) == 10.5  # gaps 10 and 11
    assert r.cadence_segment == OVERDUE  # quiet 38 > 2 x 10.5 and >= 30
    assert r.cadence_ratio == 3.62


def test_cadence_outcomes_and_floor(raw_of):
    raw = raw_of(
        [
            _line("1", "one", "2011-01-01"),
            _line("2", "two", "2011-01-01"),
            _line("3", "two", "2011-01-05"),
            # quiet exactly 2 x median (10) -> within cadence
            _line("4", "even", "2011-01-01"), _line("5", "even", "2011-01-11"), _line("6", "even", "2011-01-21"),
            # quiet 29 with median 5 -> past 2x but under the 30-day floor -> within
            _line("7", "fast", "2011-01-02"), _line("8", "fast", "2011-01-07"), _line("9", "fast", "2011-01-12"),
            _line("99", "end", "2011-02-10"),
        ]
    )
    seg = {r.customer_id: r.cadence_segment for r in customer_cadence(sales(raw)).collect()}
    assert seg["one"] == SINGLE and seg["two"] == TWO
    assert seg["even"] == WITHIN  # quiet 20 = 2 x 10
    assert seg["fast"] == WITHIN  # quiet 29 < 30


def test_quiet_thirty_past_twice_median_is_at_risk(raw_of):
    raw = raw_of(
        [
            _line("1", "c", "2011-01-01"), _line("2", "c", "2011-01-06"), _line("3", "c", "2011-01-11"),
            _line("9", "end", "2011-02-10"),
        ]
    )
    seg = {r.customer_id: (r.cadence_segment, r.days_since_last_order) for r in customer_cadence(sales(raw)).collect()}
    assert seg["c"] == (OVERDUE, 30)
