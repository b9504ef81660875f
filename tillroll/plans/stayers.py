"""Stayers vs leavers: first-order and cadence profiles of the groups
(corrected basis; cadence computed on the corrected sales).

Group medians and percentiles are exact (``exact_quantiles`` grouped by
segment/band), means are exact rounded quotients.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import avg_money, avg_round, round_exact
from tillroll.operators.quantiles import column_quantiles, exact_quantiles
from tillroll.plans.cadence import OVERDUE, SCORED_SEGMENTS, WITHIN

# Group and band labels.
NEVER_RETURNED = "Never returned"
RETURNED = "Returned at least once"
BANDS = ((20, "a. Fast (under 20d)"), (40, "b. Medium (20-40d)"), (70, "c. Slow (40-70d)"))
TOP_BAND = "d. Very slow (70d+)"


def _returned_group(fsp: DataFrame) -> DataFrame:
    return fsp.withColumn(
        "customer_group", F.when(F.col("is_one_and_done"), F.lit(NEVER_RETURNED)).otherwise(F.lit(RETURNED))
    )


def _value_items_report(g: DataFrame, with_days_observed: bool) -> DataFrame:
    g = g.select("customer_group", "first_order_value", "first_order_items", "observation_days")
    q = column_quantiles(g, ["customer_group"], ["first_order_value", "first_order_items"], ["0.5"]).select(
        "customer_group",
        F.col("first_order_value__p_0_5").alias("__mv"),
        F.col("first_order_items__p_0_5").alias("__mi"),
    )
    agg = g.groupBy("customer_group").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("first_order_value").alias("__v"),
        F.count("first_order_value").alias("__vn"),
        F.sum("first_order_items").alias("__i"),
        F.count("first_order_items").alias("__in"),
        F.sum("observation_days").alias("__o"),
    )
    cols = [
        "customer_group",
        "customers",
        avg_money("__v", "__vn").alias("mean_first_order_value"),
        round_exact("__mv", 2).alias("median_first_order_value"),
        avg_round("__i", "__in", 1).alias("mean_first_order_items"),
        round_exact("__mi", 1).alias("median_first_order_items"),
    ]
    if with_days_observed:
        cols.append(avg_round("__o", "customers", 0).alias("mean_days_observed"))
    return (
        agg.join(q, "customer_group", "left")
        .select(*cols)
        .orderBy("customer_group")
    )


def first_hurdle(fsp: DataFrame) -> DataFrame:
    # True of all customers: medians and means then read the same joined relation, and share its exchanges.
    return _value_items_report(_returned_group(fsp.where(F.col("observation_days") >= 0)), True)


def first_hurdle_fair(fsp: DataFrame, min_observed: int = 90) -> DataFrame:
    return _value_items_report(_returned_group(fsp.where(F.col("observation_days") >= min_observed)), False)


def _scored(cadence_net: DataFrame) -> DataFrame:
    return cadence_net.where(F.col("cadence_segment").isin(list(SCORED_SEGMENTS)))


def _scored_with_first(cadence_net: DataFrame, fsp: DataFrame | None) -> DataFrame:
    """Scored customers with their first order: their own columns, or joined from ``fsp``."""
    if fsp is None:
        return _scored(cadence_net)
    first = fsp.select("customer_id", "first_order_value", "first_order_items", "days_to_second_purchase")
    return _scored(cadence_net).join(first, "customer_id")


def stayers_vs_lapsed(cadence_net: DataFrame, fsp: DataFrame | None = None) -> DataFrame:
    j = _scored_with_first(cadence_net, fsp).withColumnRenamed("cadence_segment", "customer_group")
    grp = ["customer_group"]
    q = column_quantiles(
        j, grp, ["first_order_value", "first_order_items", "days_to_second_purchase"], ["0.5"]
    ).select(
        *grp,
        F.col("first_order_value__p_0_5").alias("__mv"),
        F.col("first_order_items__p_0_5").alias("__mi"),
        F.col("days_to_second_purchase__p_0_5").alias("__md"),
    )
    agg = j.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("first_order_value").alias("__v"),
        F.count("first_order_value").alias("__vn"),
        F.sum("first_order_items").alias("__i"),
        F.count("first_order_items").alias("__in"),
        F.sum("days_to_second_purchase").alias("__d"),
        F.count("days_to_second_purchase").alias("__dn"),
        F.sum("purchase_occasions").alias("__p"),
        F.sum("total_spend").alias("__s"),
    )
    return (
        agg.join(q, grp, "left")
        .select(
            "customer_group",
            "customers",
            avg_money("__v", "__vn").alias("mean_first_order_value"),
            round_exact("__mv", 2).alias("median_first_order_value"),
            avg_round("__i", "__in", 1).alias("mean_first_order_items"),
            round_exact("__mi", 1).alias("median_first_order_items"),
            avg_round("__d", "__dn", 1).alias("mean_days_to_second"),
            round_exact("__md", 1).alias("median_days_to_second"),
            avg_round("__p", "customers", 1).alias("mean_purchases"),
            avg_money("__s", "customers").alias("mean_total_spend"),
        )
        .orderBy("customer_group")
    )


def control_check(cadence_net: DataFrame) -> DataFrame:
    return (
        _scored(cadence_net)
        .groupBy(F.col("cadence_segment").alias("customer_group"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.min("first_order_date").alias("earliest_first_order"),
            F.sum(F.datediff("dataset_end_date", "first_order_date")).alias("__o"),
        )
        .select(
            "customer_group", "customers", "earliest_first_order",
            avg_round("__o", "customers", 0).alias("mean_observation_days"),
        )
        .orderBy("customer_group")
    )


def first_order_spread(cadence_net: DataFrame, fsp: DataFrame | None = None) -> DataFrame:
    probs = ["0.1", "0.25", "0.5", "0.75", "0.9"]
    j = _scored_with_first(cadence_net, fsp).withColumnRenamed("cadence_segment", "customer_group")
    q = exact_quantiles(j, ["customer_group"], "first_order_value", probs)
    n = j.groupBy("customer_group").agg(F.count(F.lit(1)).alias("customers"))
    names = {"0.1": "p10", "0.25": "p25", "0.5": "p50", "0.75": "p75", "0.9": "p90"}
    return (
        n.join(q, "customer_group", "left")
        .select(
            "customer_group",
            "customers",
            *[round_exact("p_" + p.replace(".", "_"), 0).alias(names[p]) for p in probs],
        )
        .orderBy("customer_group")
    )


def cadence_structure(cadence_net: DataFrame) -> DataFrame:
    s = _scored(cadence_net).select(
        F.col("cadence_segment").alias("customer_group"), "median_gap_days", "days_since_last_order"
    )
    q = exact_quantiles(s, ["customer_group"], "median_gap_days", ["0.5"], value_type="decimal(12,1)")
    agg = s.groupBy("customer_group").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("median_gap_days").alias("__m"),
        F.count("median_gap_days").alias("__mn"),
        F.sum("days_since_last_order").alias("__q"),
    )
    return (
        agg.join(q, "customer_group", "left")
        .select(
            "customer_group",
            "customers",
            avg_round("__m", "__mn", 1, scale=1).alias("mean_of_their_median_gaps"),
            round_exact("p_0_5", 1).alias("median_of_their_median_gaps"),
            avg_round("__q", "customers", 1).alias("mean_days_currently_quiet"),
        )
        .orderBy("customer_group")
    )


def within_band_compare(cadence_net: DataFrame, fsp: DataFrame | None = None) -> DataFrame:
    med = F.col("median_gap_days")
    band = F.lit(TOP_BAND)
    for limit, label in reversed(BANDS):
        band = F.when(med < limit, F.lit(label)).otherwise(band)
    j = _scored_with_first(cadence_net, fsp).withColumn("cadence_band", band)
    q = exact_quantiles(j, ["cadence_band", "cadence_segment"], "days_to_second_purchase", ["0.5"], "decimal(20,0)")
    counts = j.groupBy("cadence_band").agg(
        F.count_if(F.col("cadence_segment") == WITHIN).alias("n_active"),
        F.count_if(F.col("cadence_segment") == OVERDUE).alias("n_lapsed"),
    )
    meds = q.groupBy("cadence_band").agg(
        F.max(F.when(F.col("cadence_segment") == WITHIN, F.col("p_0_5"))).alias("__a"),
        F.max(F.when(F.col("cadence_segment") == OVERDUE, F.col("p_0_5"))).alias("__l"),
    )
    return (
        counts.join(meds, "cadence_band", "left")
        .select(
            "cadence_band",
            "n_active",
            round_exact("__a", 0).alias("active_median_days_to_second"),
            "n_lapsed",
            round_exact("__l", 0).alias("lapsed_median_days_to_second"),
        )
        .orderBy("cadence_band")
    )
