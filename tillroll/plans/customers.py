"""Customer profile and the fixed-recency (90-day) segmentation.

One row per customer, read off the day sets.  "Now" is the last order
date of the same basis, attached as a one-row broadcast.  The spend quintile
is NTILE(5) over the spend order: its four cut points (spend, customer_id) are
selected by counting (``operators/selection.py``) and customers compared with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, avg_money, money, round_div
from tillroll.operators import dayset
from tillroll.operators.grain import reuse
from tillroll.operators.selection import ntile

# Segment labels of the 90-day rule (the report contract).
HIGH_VALUE_ACTIVE = "High-value active"
HIGH_VALUE_AT_RISK = "High-value at risk"
ACTIVE_REPEAT = "Active repeat customer"
AT_RISK_REPEAT = "At-risk repeat customer"
ONE_TIME = "One-time customer"
AT_RISK_SEGMENTS = (HIGH_VALUE_AT_RISK, AT_RISK_REPEAT)


def segment_rule(orders, spend, quiet, high_value=1000, quiet_days=90, min_orders=2) -> F.Column:
    repeat = orders >= min_orders
    high = spend >= high_value
    return (
        F.when(repeat & high & (quiet <= quiet_days), F.lit(HIGH_VALUE_ACTIVE))
        .when(repeat & high & (quiet > quiet_days), F.lit(HIGH_VALUE_AT_RISK))
        .when(repeat & (quiet <= quiet_days), F.lit(ACTIVE_REPEAT))
        .when(repeat & (quiet > quiet_days), F.lit(AT_RISK_REPEAT))
        .otherwise(F.lit(ONE_TIME))
    )


def customer_profile(
    sets: DataFrame, high_value=1000, quiet_days=90, min_orders=2, quintiles: int | None = 5
) -> DataFrame:
    """The profile view from a basis' day sets (with counted invoices); ``quintiles=None`` leaves
    out the spend quintile (and with it the written customers) for reports
    that do not read it."""
    sets = dayset.of(sets, count_invoices=True)
    summ = sets.select(
        "customer_id",
        dayset.nth_day(0)["day"].alias("first_order_date"),
        dayset.nth_day(-1)["day"].alias("last_order_date"),
        dayset.total("new_invoices").alias("total_invoices"),
        dayset.total("items").alias("total_items"),
        dayset.spend().alias("total_spend"),
    )
    summ = dayset.with_last_day(summ, sets).withColumn(
        "days_since_last_order", F.datediff("dataset_end_date", "last_order_date").cast("bigint")
    )
    if quintiles:
        held = reuse(summ.withColumn("__pence", as_units("total_spend", 2).cast("long")))
        ranked, quintile = ntile(held, "__pence", "customer_id", quintiles, "__tile"), F.col("__tile")
    else:
        ranked, quintile = summ, F.lit(None).cast("bigint")
    return ranked.select(
        "customer_id",
        "first_order_date",
        "last_order_date",
        "dataset_end_date",
        "days_since_last_order",
        F.col("total_invoices").alias("total_orders"),
        "total_items",
        "total_spend",
        avg_money("total_spend", "total_invoices").alias("average_order_value"),
        quintile.alias("spend_quintile"),
        segment_rule(
            F.col("total_invoices"), F.col("total_spend"), F.col("days_since_last_order"),
            high_value, quiet_days, min_orders,
        ).alias("customer_segment"),
    )


def segment_summary(profile: DataFrame) -> DataFrame:
    return (
        profile.groupBy("customer_segment")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("total_spend").alias("__s"))
        .select(
            "customer_segment",
            "customers",
            money("__s").alias("total_sales"),
            avg_money("__s", "customers").alias("average_customer_spend"),
        )
        .orderBy(F.desc("total_sales"))
    )


def retention_priority(profile: DataFrame) -> DataFrame:
    return (
        profile.where(F.col("customer_segment") == HIGH_VALUE_AT_RISK)
        .orderBy(F.desc("total_spend"), "customer_id")
        .select(
            "customer_id",
            money("total_spend").alias("total_spend"),
            "total_orders",
            "average_order_value",
            "last_order_date",
            "days_since_last_order",
            "customer_segment",
        )
    )


def top_customers(profile: DataFrame, k: int = 20) -> DataFrame:
    """Top-k by spend with the dense spend rank.

    Dense rank within the first k rows equals the global dense rank (it only
    counts distinct spends above), so the rank runs on k rows after a top-k.
    """
    top = profile.orderBy(F.desc("total_spend"), "customer_id").limit(k)
    w = Window.orderBy(F.desc("total_spend"))
    return top.select(
        "customer_id",
        money("total_spend").alias("total_spend"),
        "total_orders",
        "average_order_value",
        "last_order_date",
        F.dense_rank().over(w).cast("bigint").alias("spend_rank"),
    ).orderBy("spend_rank", "customer_id")


def spend_quintile_summary(profile: DataFrame) -> DataFrame:
    return (
        profile.groupBy("spend_quintile")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("total_spend").alias("__s"),
            F.min("total_spend").alias("__lo"),
            F.max("total_spend").alias("__hi"),
        )
        .select(
            "spend_quintile",
            "customers",
            money("__s").alias("total_spend"),
            avg_money("__s", "customers").alias("average_customer_spend"),
            money("__lo").alias("lowest_spend"),
            money("__hi").alias("highest_spend"),
        )
        .orderBy("spend_quintile")
    )


def segment_measures(profile: DataFrame, by: list[Column | str] | None = None, where: Column | None = None) -> DataFrame:
    """The four segment-count KPI measures in one pass, of the customers in ``where``, per value of ``by``."""
    seg = F.col("customer_segment")
    picked = profile if where is None else profile.where(where)
    return picked.groupBy(*(by or [])).agg(
        F.count_if(seg == HIGH_VALUE_ACTIVE).alias("high_value_active_customers"),
        F.count_if(seg == HIGH_VALUE_AT_RISK).alias("high_value_at_risk_customers"),
        F.count_if(seg == AT_RISK_REPEAT).alias("at_risk_repeat_customers"),
        F.count_if(seg == ONE_TIME).alias("one_time_customers"),
    )


__all__ = [
    "customer_profile", "segment_summary", "retention_priority", "top_customers",
    "spend_quintile_summary", "segment_measures", "segment_rule", "as_units", "round_div",
]
