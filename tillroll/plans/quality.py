"""Data-quality profile of the raw lines (each one scan, partial aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import money
from tillroll.plans.clean import is_cancellation


def row_count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("total_rows"))


def date_range(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.min("invoice_date").alias("earliest_transaction"),
        F.max("invoice_date").alias("latest_transaction"),
    )


def missing_values(raw: DataFrame) -> DataFrame:
    cols = ["invoice_no", "stock_code", "description", "customer_id", "country"]
    return raw.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols])


def cancellation_counts(raw: DataFrame) -> DataFrame:
    return raw.where(is_cancellation()).agg(
        F.countDistinct("invoice_no").alias("cancelled_invoices"),
        F.count(F.lit(1)).alias("cancellation_lines"),
    )


def non_positive(raw: DataFrame) -> DataFrame:
    """Lines with quantity <= 0 and with price <= 0 (overlap counted in both)."""
    return raw.agg(
        F.count_if(F.col("quantity") <= 0).alias("non_positive_quantity"),
        F.count_if(F.col("unit_price") <= 0).alias("non_positive_price"),
    )


def country_invoices(raw: DataFrame) -> DataFrame:
    return (
        raw.groupBy("country")
        .agg(F.countDistinct("invoice_no").alias("invoices"))
        .orderBy(F.desc("invoices"), F.asc_nulls_first("country"))
    )


def sales_sanity(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count(F.lit(1)).alias("valid_sales_lines"),
        F.countDistinct("invoice_no").alias("valid_orders"),
        F.countDistinct("customer_id").alias("identified_customers"),
        money(F.sum("sales_value")).alias("net_sales"),
    )


def cancellation_rate_consistent(raw: DataFrame) -> DataFrame:
    """Cancelled invoices over all invoices, both counted on the raw table."""
    from tillroll.functions.exact import pct

    return raw.agg(
        F.countDistinct(F.when(is_cancellation(), F.col("invoice_no"))).alias("cancelled_invoices"),
        F.countDistinct("invoice_no").alias("all_invoices"),
    ).withColumn("cancellation_rate_pct", pct(F.col("cancelled_invoices"), F.col("all_invoices"), 2))


def raw_profile(raw: DataFrame) -> DataFrame:
    """A fingerprint of a raw table: counts, nulls, sums and the time span."""
    return raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("invoice_no").alias("invoices"),
        F.count_if(F.col("description").isNull()).alias("missing_description"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer_id"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        money(F.sum("unit_price")).alias("total_unit_price"),
        F.countDistinct("description").alias("descriptions"),
        F.min("invoice_date").alias("earliest_transaction"),
        F.max("invoice_date").alias("latest_transaction"),
    )
