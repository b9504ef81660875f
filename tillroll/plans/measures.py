"""KPI measures as filter-aware DataFrame functions (the BI layer, re-aimed).

A report page is one ``agg`` over the filtered relations: ``Slicer`` applies
the page's filter context (date range, countries, products) *before* the
aggregate, so Parquet pushdown still works; ``measures_by`` is the grouped
form (the measure evaluated per dimension value).  DIVIDE-style measures
return 0, not NULL, on an empty selection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, money


@dataclass(frozen=True)
class Slicer:
    start: str | None = None  # inclusive date
    end: str | None = None  # inclusive date
    countries: Sequence[str] | None = None
    products: Sequence[str] | None = None

    def apply(self, df: DataFrame, date_col: str) -> DataFrame:
        return df.where(self.holds(date_col))

    def holds(self, date_col: str) -> Column:
        """Whether a row is in this filter context."""
        cond = F.lit(True)
        if self.start:
            cond = cond & (F.col(date_col) >= F.lit(self.start).cast("date"))
        if self.end:
            cond = cond & (F.col(date_col) <= F.lit(self.end).cast("date"))
        if self.countries:
            cond = cond & F.col("country").isin(list(self.countries))
        if self.products:
            cond = cond & F.col("product_name").isin(list(self.products))
        return cond


def _divide0(num: Column, den: Column) -> Column:
    """The plain ratio of two whole numbers as a double, 0 where there is nothing to divide by."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(0.0)


def sales_measures() -> list[Column]:
    orders = F.countDistinct("invoice_no")
    total = F.coalesce(F.sum("sales_value"), F.lit(0))
    return [
        money(total).alias("m_net_sales"),
        orders.alias("m_total_orders"),
        F.countDistinct("customer_id").alias("m_unique_customers"),
        _divide0(as_units(total, 2), orders * 100).alias("m_average_order_value"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("m_total_items"),
    ]


def cancellation_measures() -> list[Column]:
    return [
        money(F.coalesce(F.sum("cancellation_value"), F.lit(0))).alias("m_cancelled_value"),
        F.countDistinct("invoice_no").alias("m_cancelled_invoices"),
    ]


def _sliced_cancels(cancels: DataFrame, slicer: Slicer) -> DataFrame:
    return slicer.apply(cancels.withColumn("__d", F.to_date("invoice_date")), "__d").drop("__d")


def _rate() -> Column:
    return _divide0(F.col("m_cancelled_invoices"), F.col("m_cancelled_invoices") + F.col("m_total_orders"))


def kpi_measures(
    sales: DataFrame, cancels: DataFrame, slicer: Slicer | None = None, slice_cancellations: bool = False
) -> DataFrame:
    """All card measures of the three report pages, in one row.

    The report pages have no relationship from the date and country slicers to
    the cancellations, so those stay whole unless ``slice_cancellations``.
    """
    slicer = slicer or Slicer()
    s = slicer.apply(sales, "order_date").agg(*sales_measures())
    c = (_sliced_cancels(cancels, slicer) if slice_cancellations else cancels).agg(*cancellation_measures())
    return s.crossJoin(F.broadcast(c)).withColumn("m_cancellation_rate", _rate())


def cancellation_measures_by(
    sales: DataFrame, cancels: DataFrame, sales_dim: str, cancel_dim: str, name: str, slicer: Slicer | None = None
) -> DataFrame:
    """Cancelled value, invoices and rate per value of a dimension (a month, a product) that both relations have."""
    if slicer:
        sales, cancels = slicer.apply(sales, "order_date"), _sliced_cancels(cancels, slicer)
    sold = sales.select(F.lit(False).alias("cancelled"), F.col(sales_dim).alias(name), "invoice_no", F.col("sales_value").alias("value"))
    back = cancels.select(F.lit(True).alias("cancelled"), F.col(cancel_dim).alias(name), "invoice_no", F.col("cancellation_value").alias("value"))
    return cancellation_measures_of(sold.unionByName(back), name, name)


def cancellation_measures_of(lines: DataFrame, dim: str, name: str, partitions: int | None = None) -> DataFrame:
    """``cancellation_measures_by`` from ``trade_lines``.

    Lines are first brought together per (value, kind, invoice), so invoices are counted as rows and no line is
    doubled for a second distinct count.  ``partitions`` of them keep a task's share small when lines are many;
    a pair of value and invoice holds few lines, so little would be gained by summing before that exchange.
    """
    value = F.when(F.col("cancelled"), F.col("value")).cast("decimal(38,2)")
    few = lines.select(F.col(dim).alias(name), "cancelled", "invoice_no", value.alias("value"))
    if partitions:
        few = few.repartition(partitions, name, "cancelled", "invoice_no")
    once = few.groupBy(name, "cancelled", "invoice_no").agg(F.sum("value").cast("decimal(38,2)").alias("cancellation_value"))
    invoices = lambda kind: F.count_if((F.col("cancelled") == F.lit(kind)) & F.col("invoice_no").isNotNull())
    out = once.groupBy(name).agg(
        money(F.coalesce(F.sum("cancellation_value"), F.lit(0))).alias("m_cancelled_value"),
        invoices(True).alias("m_cancelled_invoices"),
        invoices(False).alias("m_total_orders"),
    )
    return out.withColumn("m_cancellation_rate", _rate())


def measures_by(sales: DataFrame, dims: Sequence[str], slicer: Slicer | None = None) -> DataFrame:
    slicer = slicer or Slicer()
    return slicer.apply(sales, "order_date").groupBy(*dims).agg(*sales_measures())


def date_dimension(sales: DataFrame) -> DataFrame:
    """Every day from the first to the last order date, with calendar labels.

    One row per calendar day, so its size is bounded by the date span.
    """
    bounds = sales.agg(F.min("order_date").alias("__lo"), F.max("order_date").alias("__hi"))
    days = bounds.select(F.explode(F.sequence("__lo", "__hi")).alias("date"))
    return days.select(
        "date",
        F.year("date").cast("bigint").alias("year"),
        F.month("date").cast("bigint").alias("month_number"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.date_format("date", "yyyy-MM").alias("year_month"),
        F.concat(F.lit("Q"), F.quarter("date").cast("string")).alias("quarter"),
    )


def sales_by_year_month(sales: DataFrame) -> DataFrame:
    """Measures by a date-table attribute through the one-to-many join."""
    dim = date_dimension(sales)
    joined = sales.join(dim, sales.order_date == dim.date)
    return joined.groupBy("year_month").agg(*sales_measures()).orderBy("year_month")


def top_n(grouped: DataFrame, dim: str, measure: str, n: int) -> DataFrame:
    """Top-N rows of any grouped measures, on any basis (ties broken by the dimension value)."""
    return grouped.orderBy(F.desc(measure), F.asc_nulls_first(dim)).limit(n)


def top_n_by_measure(sales: DataFrame, dim: str, measure: str, n: int, slicer: Slicer | None = None) -> DataFrame:
    """Top-N values of ``dim`` by any of the sales measures."""
    return top_n(measures_by(sales, [dim], slicer), dim, measure, n)
