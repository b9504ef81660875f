"""Figures observed while loading equal those of the reports that scan the table."""

from tests.conftest import SF_SMALL
from tillroll.plans import quality
from tillroll.plans.clean import valid_sales
from tillroll.relations import Relations
from tillroll.sources.profiled import write_raw_profiled

REPORTS = ["row_count", "date_range", "missing_values", "cancellation_counts", "non_positive", "country_invoices", "sales_sanity"]


def compare(raw, path):
    profile = write_raw_profiled(raw, path)
    for name in REPORTS:
        basis = valid_sales(raw) if name == "sales_sanity" else raw
        want, got = getattr(quality, name)(basis), getattr(profile, name)()
        assert got.schema.simpleString() == want.schema.simpleString(), name
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], name


def test_sample(spark, tmp_path):
    compare(Relations.from_star(spark, SF_SMALL).raw, str(tmp_path / "raw"))


def test_odd_lines(raw_of, tmp_path):
    compare(raw_of([
        ("1", "P", "X", 2, "2011-01-05", 1.50, "a", "UK"), ("1", "P", "X", 2, "2011-01-05", 1.50, "a", "FR"),
        ("C2", "P", "X", -2, "2011-01-06", 1.50, "a", "UK"), ("C2", None, None, -1, "2011-01-06", 0, None, None),
        (None, "P", "X", 1, "2011-01-07", 1.00, "b", "UK"), (None, "P", "X", 1, None, 1.00, None, None),
        ("3", "P", None, 1, "2011-01-07", 1.00, "c", "UK"), ("4", "P", "X", 0, "2011-01-07", -1.00, "d", "UK"),
    ]), str(tmp_path / "raw"))
