"""Day sets against plain Python, and what a report reads to get one."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, raw_rows
from tillroll.operators import dayset
from tillroll.operators.grain import invoice_grain
from tillroll.plans import cadence, cohorts
from tillroll.plans.clean import valid_sales
from tillroll.relations import Relations


@pytest.fixture(scope="module")
def lines():
    """A third of all lines are one customer's; some invoices go over several days."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        cust = "hot" if i % 3 == 0 else f"c{rng.randint(0, 80)}"
        day = dt.datetime(2011, 1, 1, 9) + dt.timedelta(days=rng.randint(0, 90 if cust == "hot" else 300))
        inv = f"m{i % 40}{cust}" if i % 50 == 0 else f"{cust}-{day:%j}-{rng.randint(0, 2)}"
        rows.append((inv, "P", "Thing", rng.randint(1, 4), day, rng.choice([0.5, 1.25, 2]), cust, "UK"))
    return rows


@pytest.fixture(scope="module")
def grain(spark, lines):
    return invoice_grain(valid_sales(raw_rows(spark, lines).repartition(6)))


def test_sets_hold_every_day_once(lines, grain):
    want = {}
    for inv, _, _, q, ts, price, cust, _ in lines:
        d = want.setdefault(cust, {}).setdefault(ts.date(), [0, 0.0, set()])
        d[0] += q
        d[1] += q * price
        d[2].add(inv)
    for counted in (False, True):
        sets = dayset.day_sets(grain, counted)
        assert dayset.counts_invoices(sets) == counted
        for r in sets.collect():
            days = want[r.customer_id]
            assert [d.day for d in r.days] == sorted(days)
            assert [(d["items"], float(d["value"]), d.invoices) for d in r.days] == [
                (days[d][0], days[d][1], len(days[d][2])) for d in sorted(days)]
            if counted:
                assert sum(d.new_invoices for d in r.days) == len(set.union(*[d[2] for d in days.values()]))


def test_cadence_against_plain_python(lines, grain):
    days = {}
    for _, _, _, _, ts, _, cust, _ in lines:
        days.setdefault(cust, set()).add(ts.date())
    end = max(d for s in days.values() for d in s)
    got = {r.customer_id: r for r in cadence.customer_cadence(grain).collect()}
    assert set(got) == set(days)
    for cust, s in days.items():
        ordered = sorted(s)
        gaps = [(b - a).days for a, b in zip(ordered, ordered[1:])]
        r = got[cust]
        assert (r.first_order_date, r.last_order_date, r.dataset_end_date) == (ordered[0], ordered[-1], end)
        assert r.gap_count == (len(gaps) or None)
        if gaps:
            assert float(r.median_gap_days) == statistics.median(gaps)
            assert (r.shortest_gap_days, r.longest_gap_days) == (min(gaps), max(gaps))


def test_months_follow_the_days(lines, grain):
    months = {}
    for _, _, _, _, ts, _, cust, _ in lines:
        months.setdefault(cust, set()).add(ts.date().replace(day=1))
    got = dayset.day_sets(grain).select("customer_id", dayset.months().alias("m")).collect()
    assert {r.customer_id: r.m for r in got} == {c: sorted(m) for c, m in months.items()}


def test_empty_grain(grain):
    none = grain.limit(0)
    assert cadence.customer_cadence(none).count() == cohorts.cohort_sizes(none).count() == 0
    assert dayset.last_day(dayset.day_sets(none)).first()[0] is None


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "raw")
    Relations.from_star(spark, SF_SMALL).raw.repartition(6).write.parquet(path)
    return path


def _reads(df):
    """Scans of the raw table that the finished plan really ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    scans = [x for x in final.splitlines() if "FileScan parquet" in x and "invoice_no" in x]
    return len(scans)


@pytest.mark.parametrize("key", [
    "customer_cadence", "customer_cadence_net", "first_second_purchase", "retention_triangle", "cohort_sizes",
    "one_and_done_value", "customer_value_distribution", "value_ladder", "cadence_structure", "gap_first_vs_later",
    "first_hurdle", "stayers_vs_lapsed", "within_band_compare", "first_order_spread", "one_time_vs_repeat",
])
def test_a_report_scans_the_lines_once(spark, stored, key):
    """The reversal index, written before, is the only other thing that reads raw lines."""
    from tillroll.registry import JOBS

    r = Relations(spark.read.parquet(stored), home_country="NATION_0")
    assert _reads(JOBS[key](r)) == 1


@pytest.mark.parametrize("key, scans", [("top10_customers", 2), ("top10_exposure", 1), ("top10_geography", 2), ("rule_overlap_by_basis", 2), ("pareto_test", 1), ("concentration_curve", 1), ("mean_robustness", 1)])
def test_lists_of_the_top_scan_once_more_for_their_lines_only(spark, stored, key, scans):
    """Spend and totals come from one scan; the countries of ten customers, and a second basis, need another."""
    from tillroll.registry import JOBS

    assert _reads(JOBS[key](Relations(spark.read.parquet(stored), home_country="NATION_0"))) == scans
