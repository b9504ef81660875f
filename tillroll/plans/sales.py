"""Sales, product, country and cancellation reports (published basis).

Line-grain inputs are reduced by grouped aggregates (partial + final);
windows only ever run over month-grain results.  Top-k reports sort on a
unique tie-break so the cut is deterministic, and plan as
``TakeOrderedAndProject`` (each task keeps k rows, no full sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, money, pct, round_div


def overall_kpis(sales: DataFrame) -> DataFrame:
    agg = sales.agg(
        F.sum("sales_value").alias("__sum"),
        F.countDistinct("invoice_no").alias("total_orders"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("quantity").alias("__items"),
    )
    return agg.select(
        money("__sum").alias("net_sales"),
        "total_orders",
        "unique_customers",
        round_div(as_units("__sum", 2), F.col("total_orders") * 100, 2).alias("average_order_value"),
        round_div(F.col("__items"), F.col("total_orders"), 2).alias("average_items_per_order"),
    )


def monthly_trend(sales: DataFrame) -> DataFrame:
    agg = sales.groupBy("order_month").agg(
        F.sum("sales_value").alias("__sum"),
        F.countDistinct("invoice_no").alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
    )
    return agg.select(
        "order_month",
        money("__sum").alias("net_sales"),
        "orders",
        "customers",
        round_div(as_units("__sum", 2), F.col("orders") * 100, 2).alias("average_order_value"),
    ).orderBy("order_month")


def mom_growth(sales: DataFrame) -> DataFrame:
    """Month total against the previous month present in the data.

    The window runs on the month-grain aggregate (one row per month).
    """
    monthly = sales.groupBy("order_month").agg(as_units(F.sum("sales_value"), 2).alias("__c"))
    prev = F.lag("__c").over(Window.orderBy("order_month"))
    return (
        monthly.withColumn("__p", prev)
        .select(
            "order_month",
            (F.col("__c") / 100).cast("double").alias("net_sales"),
            ((F.col("__c") - F.col("__p")) / 100).cast("double").alias("month_on_month_change"),
            pct(F.col("__c") - F.col("__p"), F.col("__p"), 2).alias("month_on_month_growth_pct"),
        )
        .orderBy("order_month")
    )


def product_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_name").agg(
        F.sum("quantity").cast("bigint").alias("units_sold"),
        F.sum("sales_value").alias("__sum"),
        F.countDistinct("invoice_no").alias("orders"),
    )


def top_products(sales: DataFrame, by: str = "net_sales", k: int = 10) -> DataFrame:
    """Top-k product names by net sales or by units sold."""
    key = "__sum" if by == "net_sales" else "units_sold"
    top = product_totals(sales).orderBy(F.desc(key), F.asc_nulls_first("product_name")).limit(k)
    return top.select("product_name", "units_sold", money("__sum").alias("net_sales"), "orders")


def product_sales_table(sales: DataFrame) -> DataFrame:
    t = product_totals(sales)
    return t.select(
        "product_name",
        "units_sold",
        money("__sum").alias("net_sales"),
        "orders",
        round_div(as_units("__sum", 2), F.col("units_sold") * 100, 2).alias("average_unit_value"),
    ).orderBy(F.desc("net_sales"), F.asc_nulls_first("product_name"))


def sales_by_country(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy("country")
        .agg(
            F.sum("sales_value").alias("__sum"),
            F.countDistinct("invoice_no").alias("orders"),
            F.countDistinct("customer_id").alias("customers"),
        )
        .select("country", money("__sum").alias("net_sales"), "orders", "customers")
        .orderBy(F.desc("net_sales"), "country")
    )


def top_international(sales: DataFrame, home_country: str, k: int = 10) -> DataFrame:
    """Top-k countries other than home, with their share of *all* non-home sales."""
    by_country = (
        sales.where(F.col("country") != home_country)
        .groupBy("country")
        .agg(as_units(F.sum("sales_value"), 2).alias("__c"), F.countDistinct("invoice_no").alias("orders"))
    )
    total = by_country.agg(F.sum("__c").alias("__t"))
    return (
        by_country.crossJoin(F.broadcast(total))
        .orderBy(F.desc("__c"), "country")
        .limit(k)
        .select(
            "country",
            (F.col("__c") / 100).cast("double").alias("net_sales"),
            "orders",
            pct("__c", "__t", 2).alias("share_of_international_sales_pct"),
        )
    )


def sales_per_customer_by_country(sales: DataFrame) -> DataFrame:
    agg = sales.groupBy("country").agg(
        F.sum("sales_value").alias("__sum"), F.countDistinct("customer_id").alias("customers")
    )
    return agg.select(
        "country",
        money("__sum").alias("net_sales"),
        "customers",
        round_div(as_units("__sum", 2), F.col("customers") * 100, 2).alias("sales_per_customer"),
    ).orderBy(F.desc("net_sales"), "country")


# --- cancellations -----------------------------------------------------------


def cancellation_kpis(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """Cancelled invoices over (cancelled + valid orders): the published mix of populations."""
    c = cancels.agg(
        F.countDistinct("invoice_no").alias("cancelled_invoices"),
        F.sum("cancellation_value").alias("__v"),
    )
    v = sales.agg(F.countDistinct("invoice_no").alias("valid_orders"))
    return c.crossJoin(F.broadcast(v)).select(
        "cancelled_invoices",
        money("__v").alias("cancellation_value"),
        "valid_orders",
        pct("cancelled_invoices", F.col("cancelled_invoices") + F.col("valid_orders"), 2).alias(
            "cancellation_rate_pct"
        ),
    )


def cancelled_by_month(cancels: DataFrame) -> DataFrame:
    return (
        cancels.groupBy("cancellation_month")
        .agg(
            money(F.sum("cancellation_value")).alias("cancelled_value"),
            F.countDistinct("invoice_no").alias("cancelled_invoices"),
        )
        .orderBy("cancellation_month")
    )


def most_cancelled_products(cancels: DataFrame, k: int = 10) -> DataFrame:
    """Top-k names by cancelled value; a missing name is a group of its own."""
    return (
        cancels.groupBy("product_name")
        .agg(
            F.sum("quantity").cast("bigint").alias("units_cancelled"),
            F.sum("cancellation_value").alias("__v"),
            F.countDistinct("invoice_no").alias("cancelled_invoices"),
        )
        .orderBy(F.desc("__v"), F.asc_nulls_first("product_name"))
        .limit(k)
        .select("product_name", "units_cancelled", money("__v").alias("cancelled_value"), "cancelled_invoices")
    )


# Descriptions that are fees or manual adjustments, not returns
# (the test mapping's names; the original data uses AMAZON FEE, Manual,
# CRUK Commission and Bank Charges).
DEFAULT_FEE_NAMES = ("MARKETPLACE FEE", "Manual")


def fee_vs_return_split(cancels: DataFrame, fee_names=DEFAULT_FEE_NAMES) -> DataFrame:
    """Cancellations split into fee/adjustment lines and genuine returns."""
    kind = F.when(F.col("product_name").isin(list(fee_names)), F.lit("Fee or adjustment")).otherwise(
        F.lit("Customer return")
    )
    return (
        cancels.groupBy(kind.alias("cancellation_kind"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.countDistinct("invoice_no").alias("cancelled_invoices"),
            money(F.sum("cancellation_value")).alias("cancelled_value"),
        )
        .orderBy("cancellation_kind")
    )
