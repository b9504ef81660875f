"""Base relations: valid sales, cancellations and reversal-corrected sales.

All three are lazy DataFrames over the raw lines; Catalyst inlines them into
every query, pushes their filters into the scan and prunes unused columns.
Reports on sales and cancellations together take both from one read: ``trade_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a leading capital C marks a cancellation invoice (case-sensitive).
CANCEL_PREFIX = "C"


def is_cancellation(invoice_no="invoice_no") -> F.Column:
    c = F.col(invoice_no) if isinstance(invoice_no, str) else invoice_no
    return c.startswith(CANCEL_PREFIX)


def _is_sale(require_customer: bool = True) -> F.Column:
    cond = (
        ~is_cancellation()
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0)
        & F.col("description").isNotNull()
    )
    return cond & F.col("customer_id").isNotNull() if require_customer else cond


def valid_sales(raw: DataFrame, require_customer: bool = True) -> DataFrame:
    """Completed sale lines with money and calendar columns.

    Kept: non-cancellation invoice, quantity > 0, price > 0, description
    present and, unless ``require_customer=False``, a customer id.  NULL
    invoice numbers are neither sales nor cancellations (SQL three-valued logic).
    """
    return raw.where(_is_sale(require_customer)).select(
        "invoice_no",
        "stock_code",
        F.trim("description").alias("product_name"),
        "quantity",
        "invoice_date",
        "unit_price",
        "customer_id",
        "country",
        F.round(F.col("quantity") * F.col("unit_price"), 2).alias("sales_value"),
        F.trunc(F.to_date("invoice_date"), "MM").alias("order_month"),
        F.to_date("invoice_date").alias("order_date"),
    )


def cancellations(raw: DataFrame) -> DataFrame:
    """Every cancellation line, with no other filter (any customer, sign, price)."""
    return raw.where(is_cancellation()).select(
        "invoice_no",
        "stock_code",
        F.trim("description").alias("product_name"),
        "quantity",
        "invoice_date",
        "unit_price",
        "customer_id",
        "country",
        F.round(F.abs(F.col("quantity") * F.col("unit_price")), 2).alias("cancellation_value"),
        F.trunc(F.to_date("invoice_date"), "MM").alias("cancellation_month"),
    )


def trade_lines(raw: DataFrame) -> DataFrame:
    """Valid sales and cancellations from one read of the raw lines, told apart by ``cancelled``."""
    return raw.where(is_cancellation() | _is_sale()).select(
        is_cancellation().alias("cancelled"),
        "invoice_no",
        "stock_code",
        F.trim("description").alias("product_name"),
        "quantity",
        "invoice_date",
        "unit_price",
        "customer_id",
        "country",
        F.round(F.abs(F.col("quantity") * F.col("unit_price")), 2).alias("value"),
        F.trunc(F.to_date("invoice_date"), "MM").alias("month"),
        F.to_date("invoice_date").alias("day"),
    )


def as_trade_lines(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """The same rows from sales and cancellations of their own."""
    same = ["invoice_no", "stock_code", "product_name", "quantity", "invoice_date", "unit_price", "customer_id", "country"]
    return sales.select(
        F.lit(False).alias("cancelled"), *same, F.col("sales_value").alias("value"), F.col("order_month").alias("month"), F.col("order_date").alias("day")
    ).unionByName(cancels.select(
        F.lit(True).alias("cancelled"), *same, F.col("cancellation_value").alias("value"), F.col("cancellation_month").alias("month"),
        F.to_date("invoice_date").alias("day"),
    ))
