"""First-to-second purchase analysis (corrected basis).

``first_second_purchase`` reads the first and second day off each customer's
day set.  A day carries its value and items, so the value of the first order
needs no way back to the lines.

Counting reports pre-aggregate to the (observation days, days to second)
grain before meeting their parameter lists, so a list of windows never
multiplies customer rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import avg_money, avg_round, money, pct, round_div
from tillroll.operators import dayset
from tillroll.operators.quantiles import exact_quantiles
from tillroll.plans.cadence import gap_table

# Group labels of the reports.
ONE_AND_DONE = "One and done"
CAME_BACK = "Came back at least once"
FIRST_GAP = "Gap 1->2 (winning the second purchase)"
LATER_GAPS = "All later gaps (2->3, 3->4, ...)"


def first_second_purchase(sets: DataFrame, observed: bool = True) -> DataFrame:
    """One row per customer from the corrected basis' day sets.

    ``observed=False`` leaves out ``observation_days``, and with it the end of the data.
    """
    sets = dayset.of(sets)
    first, second = dayset.nth_day(0), dayset.nth_day(1)
    folded = sets.select(
        "customer_id",
        first["day"].alias("first_purchase_date"),
        second["day"].alias("second_purchase_date"),
        dayset.occasions().alias("purchase_occasions"),
        first["value"].alias("first_order_value"),
        first["items"].cast("bigint").alias("first_order_items"),
    )
    span = []
    if observed:
        folded = dayset.with_last_day(folded, sets)
        span = [F.datediff("dataset_end_date", "first_purchase_date").cast("bigint").alias("observation_days")]
    return folded.select(
        "customer_id",
        "first_purchase_date",
        "second_purchase_date",
        "purchase_occasions",
        F.datediff("second_purchase_date", "first_purchase_date").cast("bigint").alias("days_to_second_purchase"),
        *span,
        "first_order_value",
        "first_order_items",
        (F.col("purchase_occasions") == 1).alias("is_one_and_done"),
    )


def one_and_done_rate(fsp: DataFrame) -> DataFrame:
    agg = fsp.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if("is_one_and_done").alias("one_and_done"),
        F.count_if(~F.col("is_one_and_done")).alias("repeat_buyers"),
    )
    return agg.select(
        "customers", "one_and_done", pct("one_and_done", "customers", 1).alias("pct_one_and_done"), "repeat_buyers"
    )


def single_invoice_rate(grain: DataFrame) -> DataFrame:
    per_customer = grain.groupBy("customer_id").agg(F.countDistinct("invoice_no").alias("invoices"))
    agg = per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("invoices") == 1).alias("single_invoice_customers"),
    )
    return agg.select(
        "customers",
        "single_invoice_customers",
        pct("single_invoice_customers", "customers", 1).alias("pct_single_invoice"),
    )


DEFAULT_WINDOWS = (0, 30, 60, 90, 120, 180, 270)


def one_and_done_by_window(fsp: DataFrame, windows: Sequence[int] = DEFAULT_WINDOWS) -> DataFrame:
    """One-and-done rate among customers observed for at least w days, per w."""
    spark = fsp.sparkSession
    by_obs = fsp.groupBy("observation_days").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("is_one_and_done").alias("__one")
    )
    w = spark.createDataFrame([(int(x),) for x in windows], "min_observation_days long")
    agg = (
        by_obs.join(F.broadcast(w), F.col("observation_days") >= F.col("min_observation_days"))
        .groupBy("min_observation_days")
        .agg(F.sum("__n").alias("customers_judged"), F.sum("__one").alias("never_returned"))
    )
    return agg.select(
        "min_observation_days",
        "customers_judged",
        "never_returned",
        pct("never_returned", "customers_judged", 1).alias("pct_one_and_done"),
    ).orderBy("min_observation_days")


def second_purchase_timing(fsp: DataFrame) -> DataFrame:
    rep = fsp.where(F.col("second_purchase_date").isNotNull()).select("days_to_second_purchase")
    q = exact_quantiles(rep, [], "days_to_second_purchase", ["0.25", "0.5", "0.75", "0.9"], value_type="decimal(12,0)")
    agg = rep.agg(
        F.count(F.lit(1)).alias("repeat_buyers"),
        F.min("days_to_second_purchase").alias("fastest_days"),
        F.max("days_to_second_purchase").alias("slowest_days"),
        round_div(F.sum("days_to_second_purchase"), F.count(F.lit(1)), 1).alias("mean_days"),
    )
    return agg.crossJoin(F.broadcast(q)).select(
        "repeat_buyers",
        "fastest_days",
        F.col("p_0_25").cast("double").alias("p25_days"),
        F.col("p_0_5").cast("double").alias("median_days"),
        F.col("p_0_75").cast("double").alias("p75_days"),
        F.col("p_0_9").cast("double").alias("p90_days"),
        "slowest_days",
        "mean_days",
    )


def gap_first_vs_later(sets: DataFrame) -> DataFrame:
    gaps = gap_table(sets).select(
        F.when(F.col("purchase_no") == 2, F.lit(FIRST_GAP)).otherwise(F.lit(LATER_GAPS)).alias("which_gap"),
        "gap_days",
    )
    q = exact_quantiles(gaps, ["which_gap"], "gap_days", ["0.5"], value_type="decimal(12,0)")
    agg = gaps.groupBy("which_gap").agg(
        F.count(F.lit(1)).alias("gaps_measured"),
        round_div(F.sum("gap_days"), F.count(F.lit(1)), 1).alias("mean_days"),
    )
    return (
        agg.join(q, "which_gap")
        .select("which_gap", "gaps_measured", F.col("p_0_5").cast("double").alias("median_days"), "mean_days")
        .orderBy("which_gap")
    )


DEFAULT_CUTOFFS = (30, 60, 90, 120, 150, 180, 210, 240)


def return_cutoff_curve(fsp: DataFrame, cutoffs: Sequence[int] = DEFAULT_CUTOFFS, min_observed: int = 270) -> DataFrame:
    """Among customers observed >= min_observed days: who has returned by day w."""
    spark = fsp.sparkSession
    d = F.col("days_to_second_purchase")
    by_days = (
        fsp.where(F.col("observation_days") >= min_observed)
        .groupBy(d.alias("d"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    w = spark.createDataFrame([(int(x),) for x in cutoffs], "by_day long")
    dd = F.col("d")
    agg = (
        F.broadcast(w)
        .crossJoin(by_days)
        .groupBy("by_day")
        .agg(
            F.sum("__n").alias("__all"),
            F.sum(F.when(dd <= F.col("by_day"), F.col("__n")).otherwise(0)).alias("returned_by_then"),
            F.sum(F.when(dd.isNotNull(), F.col("__n")).otherwise(0)).alias("__eventual"),
            F.sum(F.when(dd > F.col("by_day"), F.col("__n")).otherwise(0)).alias("__later"),
            F.sum(F.when(dd.isNull() | (dd > F.col("by_day")), F.col("__n")).otherwise(0)).alias("__silent"),
        )
    )
    return agg.select(
        "by_day",
        F.col("returned_by_then").cast("bigint").alias("returned_by_then"),
        pct("returned_by_then", "__all", 1).alias("pct_of_all_first_time_buyers"),
        pct("returned_by_then", "__eventual", 1).alias("pct_of_eventual_repeaters"),
        pct("__later", "__silent", 1).alias("pct_of_still_silent_who_return_later"),
    ).orderBy("by_day")


def one_and_done_value(fsp: DataFrame) -> DataFrame:
    g = fsp.select(
        F.when(F.col("is_one_and_done"), F.lit(ONE_AND_DONE)).otherwise(F.lit(CAME_BACK)).alias("group_name"),
        "first_order_value",
        "first_order_items",
    )
    q = exact_quantiles(g, ["group_name"], "first_order_value", ["0.5"])
    agg = g.groupBy("group_name").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("first_order_value").alias("__v"),
        F.count("first_order_value").alias("__vn"),
        F.sum("first_order_items").alias("__i"),
        F.count("first_order_items").alias("__in"),
    )
    return (
        agg.join(q, "group_name", "left")
        .select(
            "group_name",
            "customers",
            money("__v").alias("total_first_order_value"),
            avg_money("__v", "__vn").alias("avg_first_order_value"),
            F.col("p_0_5").cast("double").alias("median_first_order_value"),
            avg_round("__i", "__in", 1).alias("avg_items_in_first_order"),
        )
        .orderBy("group_name")
    )

