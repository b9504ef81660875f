"""Grain changes shared by the customer-level jobs.

line -> invoice (customer, day, invoice) -> purchase occasion (customer, day)
-> customer.  Customer-level jobs take the *invoice grain* (``invoice_grain``,
materialised once per basis by ``Relations``), so the line-level work of a
basis (scan, cleaning, reversal join) happens once per report.  Each step is a ``groupBy`` with map-side partial aggregation,
so a customer holding a third of all lines is pre-summed in every map task
before anything is shuffled.  Per-customer windows run on the occasion grain,
whose group size is bounded by the number of calendar days, not by volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.storage import written


def dataset_end(sales: DataFrame) -> DataFrame:
    """One row: the last order date of this basis ("now" of the data)."""
    return sales.agg(F.max("order_date").alias("dataset_end_date"))


def with_dataset_end(df: DataFrame, sales: DataFrame) -> DataFrame:
    """Attach the one-row end date (broadcast: exactly one row by construction)."""
    return df.crossJoin(F.broadcast(dataset_end(sales)))


def invoice_grain(sales: DataFrame) -> DataFrame:
    """One row per (customer, day, invoice): items and value."""
    return sales.groupBy("customer_id", "order_date", "invoice_no").agg(
        F.sum("quantity").cast("bigint").alias("items"),
        F.sum("sales_value").alias("value"),
    )


def occasions(grain: DataFrame) -> DataFrame:
    """One row per purchase occasion (customer, distinct day) from the invoice grain."""
    return grain.groupBy("customer_id", "order_date").agg(
        F.sum("items").alias("items"),
        F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("invoices"),
    )


def sequenced_occasions(occ: DataFrame) -> DataFrame:
    """Occasion number and the gap in days since the previous occasion."""
    w = Window.partitionBy("customer_id").orderBy("order_date")
    return occ.withColumn("purchase_no", F.row_number().over(w)).withColumn(
        "gap_days", F.datediff("order_date", F.lag("order_date").over(w)).cast("bigint")
    )


def customer_summary(grain: DataFrame) -> DataFrame:
    """Per customer (from the invoice grain): first/last day, invoices, occasions, items, spend."""
    return grain.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.countDistinct("invoice_no").alias("total_invoices"),
        F.countDistinct("order_date").alias("purchase_occasions"),
        F.sum("items").cast("bigint").alias("total_items"),
        F.sum("value").alias("total_spend"),
    )


def latest_by(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """For each ``key``, ``value`` from the row that is last in ``order``.

    An aggregate (``max_by`` over a struct of the order columns), so it is
    partially aggregated per map task; no per-key sort of raw rows.
    """
    ordering: Column = F.struct(*[F.col(c) for c in order])
    return df.groupBy(key).agg(F.max_by(F.col(value), ordering).alias(value))


def reuse(df: DataFrame) -> DataFrame:
    """Compute a relation once for a report that reads it several times.

    Customer-grain inputs feed both exact quantiles and plain aggregates;
    files in the shared folder (not executor memory) evaluate the upstream
    lines once, survive executor loss and cut the lineage the later branches
    would otherwise replay.
    """
    return written(df, "reuse")
