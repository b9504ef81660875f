"""Analyses the original write-up states in prose without a query.

Each is an ordinary job over the same relations: sales on all lines (no
customer requirement), the lines that dominate a month, the trading-day run
rate per month, and the best/worst month ratio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, money, pct, round_div


def sales_all_lines(raw: DataFrame) -> DataFrame:
    """Sales totals when lines without a customer id are kept."""
    from tillroll.plans.clean import valid_sales

    s = valid_sales(raw, require_customer=False)
    return s.agg(
        F.count(F.lit(1)).alias("sales_lines"),
        F.countDistinct("invoice_no").alias("orders"),
        money(F.sum("sales_value")).alias("net_sales"),
        F.count_if(F.col("customer_id").isNull()).alias("lines_without_customer"),
        money(F.coalesce(F.sum(F.when(F.col("customer_id").isNull(), F.col("sales_value"))), F.lit(0))).alias(
            "value_without_customer"
        ),
    )


def month_outlier_share(lines: DataFrame, value_col: str, month_col: str, k: int = 3) -> DataFrame:
    """The k largest lines of each month and their share of the month.

    ``row_number() ... <= k`` over a month window is planned with a group
    limit: every map task keeps only its k best lines per month before the
    shuffle, so a month holding a third of all lines never lands in one task.
    """
    w = Window.partitionBy(month_col).orderBy(
        F.desc(value_col), F.asc_nulls_first("invoice_no"), F.asc_nulls_first("stock_code"),
        F.asc_nulls_first("product_name"), F.asc_nulls_first("quantity"),
    )
    top = lines.withColumn("line_rank", F.row_number().over(w)).where(F.col("line_rank") <= k)
    totals = lines.groupBy(month_col).agg(as_units(F.sum(value_col), 2).alias("__t"))
    return (
        top.join(totals, month_col)
        .select(
            F.col(month_col).alias("month"),
            F.col("line_rank").cast("bigint").alias("line_rank"),
            "invoice_no",
            "product_name",
            F.col("quantity").cast("bigint").alias("quantity"),
            money(value_col).alias("line_value"),
            (F.col("__t") / 100).cast("double").alias("month_total"),
            pct(as_units(value_col, 2), "__t", 1).alias("pct_of_month"),
        )
        .orderBy("month", "line_rank")
    )


def daily_run_rate(sales: DataFrame) -> DataFrame:
    """Sales per trading-calendar day of each month; the first and last month
    count only the days inside the data (a partial month is not a collapse)."""
    bounds = sales.agg(F.min("order_date").alias("__lo"), F.max("order_date").alias("__hi"))
    monthly = sales.groupBy("order_month").agg(as_units(F.sum("sales_value"), 2).alias("__c"))
    days = (
        F.datediff(
            F.least(F.last_day("order_month"), F.col("__hi")), F.greatest(F.col("order_month"), F.col("__lo"))
        )
        + 1
    )
    return (
        monthly.crossJoin(F.broadcast(bounds))
        .select(
            "order_month",
            (F.col("__c") / 100).cast("double").alias("net_sales"),
            days.cast("bigint").alias("trading_days"),
            round_div("__c", days * 100, 2).alias("sales_per_day"),
        )
        .orderBy("order_month")
    )


def peak_trough_ratio(sales: DataFrame) -> DataFrame:
    """Best and worst month (ties: the later best, the earlier worst) and their ratio."""
    monthly = sales.groupBy("order_month").agg(as_units(F.sum("sales_value"), 2).alias("__c"))
    order = F.struct("__c", "order_month")
    agg = monthly.agg(
        F.max(order).alias("__best"),
        F.min(order).alias("__worst"),
    )
    return agg.select(
        F.col("__best.order_month").alias("peak_month"),
        (F.col("__best.__c") / 100).cast("double").alias("peak_sales"),
        F.col("__worst.order_month").alias("trough_month"),
        (F.col("__worst.__c") / 100).cast("double").alias("trough_sales"),
        round_div("__best.__c", "__worst.__c", 2).alias("peak_to_trough_ratio"),
    )
