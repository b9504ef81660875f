"""Query registry: report key -> job over the relations of one raw table.

Every job reads the whole raw table (here rebuilt from the star tables) and
returns a lazy DataFrame.  Parameters that the original scripts hard-coded
(home country, fee names, cut lists, windows, dates) are passed explicitly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.plans import quality, sales
from tillroll.relations import Relations
from tillroll.storage import fresh_path

Job = Callable[[Relations], DataFrame]

JOBS: dict[str, Job] = {}


def job(key: str):
    def deco(fn: Job) -> Job:
        JOBS[key] = fn
        return fn

    return deco


# --- data quality (raw) ----------------------------------------------------------
JOBS["dq_row_count"] = lambda r: quality.row_count(r.raw)
JOBS["dq_date_range"] = lambda r: quality.date_range(r.raw)
JOBS["dq_missing_values"] = lambda r: quality.missing_values(r.raw)
JOBS["dq_cancellation_counts"] = lambda r: quality.cancellation_counts(r.raw)
JOBS["dq_non_positive"] = lambda r: quality.non_positive(r.raw)
JOBS["dq_country_invoices"] = lambda r: quality.country_invoices(r.raw)
JOBS["valid_sales_sanity"] = lambda r: quality.sales_sanity(r.sales)
JOBS["cancellation_rate_consistent"] = lambda r: quality.cancellation_rate_consistent(r.raw)

# --- sales, products, countries, cancellations (published basis) -------------------
JOBS["sales_overall_kpis"] = lambda r: sales.overall_kpis(r.sales)
JOBS["sales_monthly_trend"] = lambda r: sales.monthly_trend(r.sales)
JOBS["sales_mom_growth"] = lambda r: sales.mom_growth(r.sales)
JOBS["top_products_by_sales"] = lambda r: sales.top_products(r.sales, by="net_sales")
JOBS["top_products_by_qty"] = lambda r: sales.top_products(r.sales, by="units_sold")
JOBS["product_sales_table"] = lambda r: sales.product_sales_table(r.sales)
JOBS["sales_by_country"] = lambda r: sales.sales_by_country(r.sales)
JOBS["top_international"] = lambda r: sales.top_international(r.sales, r.home_country)
JOBS["sales_per_customer_by_country"] = lambda r: sales.sales_per_customer_by_country(r.sales)
JOBS["cancellation_kpis"] = lambda r: sales.cancellation_kpis(r.sales, r.cancels)
JOBS["cancelled_by_month"] = lambda r: sales.cancelled_by_month(r.cancels)
JOBS["most_cancelled_products"] = lambda r: sales.most_cancelled_products(r.cancels)
JOBS["fee_vs_return_split"] = lambda r: sales.fee_vs_return_split(r.cancels)

# --- customers, 90-day rule (published basis) -------------------------------------
from tillroll.plans import cadence, concentration, customers  # noqa: E402

JOBS["segment_summary"] = lambda r: customers.segment_summary(r.segments)
JOBS["retention_priority"] = lambda r: customers.retention_priority(r.segments)
JOBS["top_customers"] = lambda r: customers.top_customers(r.segments)
JOBS["spend_quintile_summary"] = lambda r: customers.spend_quintile_summary(r.profile)
JOBS["m_segment_counts"] = lambda r: customers.segment_measures(r.segments)

# --- reversals and concentration (corrected basis) -----------------------------------
JOBS["reversed_sales_impact"] = lambda r: concentration.reversed_sales_impact(r.sales, r.reversals)
JOBS["published_vs_corrected"] = lambda r: concentration.published_vs_corrected(r.sales, r.net)
JOBS["pareto_test"] = lambda r: concentration.pareto_test(r.grain_net)
JOBS["concentration_curve"] = lambda r: concentration.concentration_curve(r.grain_net)
JOBS["home_country"] = lambda r: concentration.home_country(r.net)
JOBS["top10_customers"] = lambda r: concentration.top10_customers(r.grain_net, r.net)
JOBS["top10_exposure"] = lambda r: concentration.top10_exposure(r.grain_net)
JOBS["top10_geography"] = lambda r: concentration.top10_geography(r.grain_net, r.net)
JOBS["unmatched_cancellations"] = lambda r: concentration.unmatched_cancellation_summary(r.sales, r.cancels)
JOBS["reversal_bracket"] = lambda r: concentration.reversal_bracket(r.lines)
JOBS["reversal_delay"] = lambda r: concentration.reversal_delay_summary(r.sales, r.cancels)

# --- cadence rule (published basis) -------------------------------------------------
JOBS["cadence_multiple_evidence"] = lambda r: cadence.cadence_multiple_evidence(r.days)
JOBS["cadence_segment_summary"] = lambda r: cadence.cadence_segment_summary(r.cadence_days)
JOBS["cadence_at_risk_list"] = lambda r: cadence.cadence_at_risk_list(r.cadence_days)
JOBS["rule_before_after"] = lambda r: cadence.rule_before_after(r.segments, r.cadence_days)
JOBS["rule_movement_like_for_like"] = lambda r: cadence.rule_movement_like_for_like(r.segments, r.cadence_days)
JOBS["rule_movement_headline"] = lambda r: cadence.rule_movement_headline(r.segments, r.cadence_days)
JOBS["old_rule_false_alarms"] = lambda r: cadence.old_rule_false_alarms(r.segments, r.cadence_days)
JOBS["old_rule_misses"] = lambda r: cadence.old_rule_misses(r.segments, r.cadence_days)
JOBS["thin_history_buckets"] = lambda r: cadence.thin_history_buckets(r.cadence_days)
JOBS["cadence_censoring"] = lambda r: cadence.cadence_censoring(r.cadence_days)
JOBS["floor_suppressed"] = lambda r: cadence.floor_suppressed(r.cadence_days)
JOBS["same_day_collapse"] = lambda r: cadence.same_day_collapse(r.grain)
JOBS["gap_distribution"] = lambda r: cadence.gap_distribution(r.days)
JOBS["rule_overlap_by_basis"] = lambda r: cadence.rule_overlap_by_basis(r.cadence_days, r.cadence_days_net)

# --- first to second purchase, cohorts, value, stayers (corrected basis) ---------------
from tillroll.plans import cohorts, second_purchase, stayers, value  # noqa: E402

JOBS["one_and_done_rate"] = lambda r: second_purchase.one_and_done_rate(r.first_second_days)
JOBS["single_invoice_rate"] = lambda r: second_purchase.single_invoice_rate(r.grain_net)
JOBS["one_and_done_by_window"] = lambda r: second_purchase.one_and_done_by_window(r.first_second)
JOBS["second_purchase_timing"] = lambda r: second_purchase.second_purchase_timing(r.first_second_days)
JOBS["gap_first_vs_later"] = lambda r: second_purchase.gap_first_vs_later(r.days_net)
JOBS["return_cutoff_curve"] = lambda r: second_purchase.return_cutoff_curve(r.first_second)
JOBS["one_and_done_value"] = lambda r: second_purchase.one_and_done_value(r.first_second_days)
JOBS["cohort_sizes"] = lambda r: cohorts.cohort_sizes(r.days_net)
JOBS["opening_pileup"] = lambda r: cohorts.opening_pileup(r.days_net)
JOBS["retention_triangle"] = lambda r: cohorts.retention_triangle(r.days_net)
JOBS["cohort_equal_age_repeat"] = lambda r: cohorts.cohort_equal_age_repeat(r.first_second)
JOBS["monthly_volume_net"] = lambda r: cohorts.monthly_volume(r.grain_net)
JOBS["customer_value_distribution"] = lambda r: value.value_distribution(r.grain_net)
JOBS["mean_robustness"] = lambda r: value.mean_robustness(r.grain_net)
JOBS["one_time_vs_repeat"] = lambda r: value.one_time_vs_repeat(r.days_net)
JOBS["value_ladder"] = lambda r: value.value_ladder(r.days_net)
JOBS["first_hurdle"] = lambda r: stayers.first_hurdle(r.first_second)
JOBS["first_hurdle_fair"] = lambda r: stayers.first_hurdle_fair(r.first_second)
JOBS["stayers_vs_lapsed"] = lambda r: stayers.stayers_vs_lapsed(r.stories_net)
JOBS["control_check"] = lambda r: stayers.control_check(r.cadence_days_net)
JOBS["first_order_spread"] = lambda r: stayers.first_order_spread(r.stories_net)
JOBS["cadence_structure"] = lambda r: stayers.cadence_structure(r.cadence_days_net)
JOBS["within_band_compare"] = lambda r: stayers.within_band_compare(r.stories_net)

# --- measures and the date dimension --------------------------------------------------
from tillroll.plans import extras, measures  # noqa: E402
from tillroll.plans.page import measures_from, page_of  # noqa: E402
from tillroll.sources.files import raw_preview  # noqa: E402

# A page filter context: a half-year of trading in two markets.
EXAMPLE_SLICER = measures.Slicer(start="2011-03-01", end="2011-08-31", countries=("NATION_0", "NATION_1"))

JOBS["m_kpi_measures"] = lambda r: measures.kpi_measures(r.sales, r.cancels)
JOBS["filtered_kpis"] = lambda r: measures.kpi_measures(r.sales, r.cancels, EXAMPLE_SLICER)
JOBS["filtered_kpis_sliced_cancellations"] = lambda r: measures.kpi_measures(r.sales, r.cancels, EXAMPLE_SLICER, True)
# A page of ten settings: all, four quarters, two markets, two of their halves, and a product line.
EXAMPLE_PAGE = {
    "all": measures.Slicer(),
    "q1": measures.Slicer(start="2011-01-01", end="2011-03-31"),
    "q2": measures.Slicer(start="2011-04-01", end="2011-06-30"),
    "q3": measures.Slicer(start="2011-07-01", end="2011-09-30"),
    "q4": measures.Slicer(start="2011-10-01", end="2011-12-31"),
    "home": measures.Slicer(countries=("NATION_0",)),
    "abroad": measures.Slicer(countries=("NATION_1", "NATION_2", "NATION_3")),
    "half": EXAMPLE_SLICER,
    "fees": measures.Slicer(products=("MARKETPLACE FEE", "Manual")),
    "never": measures.Slicer(start="2020-01-01"),
}
JOBS["kpi_page"] = lambda r: page_of(r.lines, EXAMPLE_PAGE)
JOBS["kpi_page_sliced_cancellations"] = lambda r: page_of(r.lines, EXAMPLE_PAGE, True)
JOBS["cube_by_country"] = lambda r: measures_from(r.cube, ["country"])
JOBS["cube_by_month"] = lambda r: measures_from(r.cube, ["order_month"])
JOBS["cube_half_abroad"] = lambda r: measures_from(r.cube, [], ("2011-03-01", "2011-08-31"), ("NATION_1", "NATION_2", "NATION_3"))
JOBS["m_cancellations_by_month"] = lambda r: measures.cancellation_measures_of(r.lines, "month", "month", r.partitions)
JOBS["m_cancellations_by_product"] = lambda r: measures.cancellation_measures_of(r.lines, "product_name", "product_name", r.partitions)
JOBS["top_n_cancelled_products"] = lambda r: measures.top_n(
    measures.cancellation_measures_of(r.lines, "product_name", "product_name", r.partitions), "product_name", "m_cancelled_value", 5
)
JOBS["m_segments_by_last_month"] = lambda r: customers.segment_measures(
    r.segments, [F.trunc("last_order_date", "month").alias("last_order_month")], F.col("total_spend") >= 500
)
JOBS["m_measures_by_country"] = lambda r: measures.measures_by(r.sales, ["country"])
JOBS["date_dimension"] = lambda r: measures.date_dimension(r.sales)
JOBS["sales_by_year_month"] = lambda r: measures.sales_by_year_month(r.sales)
JOBS["top_n_by_measure"] = lambda r: measures.top_n_by_measure(r.sales, "country", "m_total_orders", 5)

# --- analyses stated in prose --------------------------------------------------------
JOBS["sales_all_lines"] = lambda r: extras.sales_all_lines(r.raw)
JOBS["month_outlier_share"] = lambda r: extras.month_outlier_share(r.cancels, "cancellation_value", "cancellation_month")
JOBS["daily_run_rate"] = lambda r: extras.daily_run_rate(r.net)
JOBS["peak_trough_ratio"] = lambda r: extras.peak_trough_ratio(r.sales)
JOBS["raw_preview"] = lambda r: as_output(raw_preview(r.raw))

# --- the base relations themselves (row-level outputs) -----------------------------------
from pyspark.sql import types as _T  # noqa: E402


def as_output(df: DataFrame) -> DataFrame:
    """Exact decimals leave as doubles (the agreed output type for amounts)."""
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, _T.DecimalType) else F.col(f.name)
          for f in df.schema.fields]
    )


JOBS["valid_sales"] = lambda r: as_output(r.sales)
JOBS["cancellations"] = lambda r: as_output(r.cancels)
JOBS["valid_sales_net"] = lambda r: as_output(r.net)
JOBS["customer_profile"] = lambda r: as_output(r.profile)
JOBS["customer_cadence"] = lambda r: as_output(r.cadence)
JOBS["customer_cadence_net"] = lambda r: as_output(r.cadence_net)
JOBS["first_second_purchase"] = lambda r: as_output(r.first_second)


def _csv_roundtrip(r: Relations) -> DataFrame:
    """Write the raw lines as CSV (result sink) into the shared checkpoint folder,
    read them back with the typed CSV source and profile what came back."""
    from tillroll.plans.quality import raw_profile
    from tillroll.sources.files import read_raw_csv, write_result_csv

    path = _scratch(r, "raw-csv")
    write_result_csv(r.raw, path)
    return raw_profile(read_raw_csv(r.spark, path))


JOBS["raw_csv_roundtrip"] = _csv_roundtrip

# --- one key per measure (Catalyst prunes the aggregates a key does not select) --------
for _m in ("m_net_sales", "m_total_orders", "m_unique_customers", "m_average_order_value", "m_total_items",
           "m_cancelled_value", "m_cancelled_invoices", "m_cancellation_rate"):
    JOBS[_m] = (lambda name: lambda r: measures.kpi_measures(r.sales, r.cancels).select(name))(_m)
for _m, _col in (("m_high_value_active", "high_value_active_customers"),
                 ("m_high_value_at_risk", "high_value_at_risk_customers"),
                 ("m_at_risk_repeat", "at_risk_repeat_customers"),
                 ("m_one_time", "one_time_customers")):
    JOBS[_m] = (lambda col: lambda r: customers.segment_measures(r.segments).select(col))(_col)


# --- sources and sinks ---------------------------------------------------------------


def _scratch(r: Relations, name: str) -> str:
    return fresh_path(r.spark, name)


def _read_raw_csv(r: Relations) -> DataFrame:
    """Raw lines written with the CSV sink and read back with the typed CSV source."""
    from tillroll.sources.files import read_raw_csv, write_result_csv

    path = _scratch(r, "raw-csv")
    write_result_csv(r.raw, path)
    return as_output(read_raw_csv(r.spark, path))


def _name_columns(r: Relations) -> DataFrame:
    """A positional extract (generic column names) renamed to the raw names."""
    from tillroll.sources.files import name_columns

    extract = r.raw.toDF(*[f"column_{i}" for i in range(len(r.raw.columns))])
    return as_output(name_columns(extract))


def _write_result_csv(r: Relations) -> DataFrame:
    """The monthly trend exported as one CSV file with a header, read back."""
    from tillroll.sources.files import write_result_csv

    result = sales.monthly_trend(r.sales)
    path = _scratch(r, "result-csv")
    write_result_csv(result, path)
    return r.spark.read.schema(result.schema).option("header", True).csv(path)


JOBS["raw_from_star"] = lambda r: as_output(r.raw)
JOBS["read_raw_csv"] = _read_raw_csv
JOBS["name_columns"] = _name_columns
JOBS["write_result_csv"] = _write_result_csv
