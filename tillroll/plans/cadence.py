"""Cadence-based retention: each customer judged against their own rhythm.

Purchase occasion = a distinct order day.  Gaps, their median, mean and extremes
are read off the customer's day set (``operators/dayset.py``), whose size is
bounded by the number of calendar days in the data, not by line volume.
Medians of whole days are multiples of 0.5, so the ``decimal(…,1)`` median and
every comparison against it are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, avg_money, money, pct, round_div
from tillroll.operators import dayset
from tillroll.operators.grain import occasions

# Cadence segment labels (the report contract).
SINGLE = "Single purchase - no cadence"
TWO = "Two purchases - cadence unreliable"
OVERDUE = "At risk - overdue on own cadence"
WITHIN = "Active - within own cadence"
SCORED_SEGMENTS = (WITHIN, OVERDUE)

# Censoring bucket labels.
NOT_YET_DUE = "1. Not yet due - no signal either way"
LATE_IN_TOLERANCE = "2. Late, but inside tolerance"
UNDER_FLOOR = "3. Past 2x but under the 30-day floor"
FLAGGED = "4. Past 2x and past the floor - FLAGGED"

MEDIAN_TYPE = "decimal(10,1)"


def gap_table(sets: DataFrame) -> DataFrame:
    """One row per real gap (customer, purchase_no of the later occasion, gap_days)."""
    sets = dayset.of(sets)
    return sets.select("customer_id", F.posexplode(dayset.gaps()).alias("at", "gap_days")).select(
        "customer_id", (F.col("at") + 2).cast("bigint").alias("purchase_no"), "gap_days"
    )


def customer_cadence(sets: DataFrame, multiple: int = 2, floor_days: int = 30, first_orders: bool = False) -> DataFrame:
    """One row per customer of this basis (given as its day sets) with gap
    statistics and the segment; ``total_invoices`` only if the sets count them.

    ``first_orders`` adds value and items of the first day and the days to the second,
    which the same set holds, so that no report joins them to the cadence.
    """
    sets = dayset.of(sets, count_invoices=True)
    counted = dayset.counts_invoices(sets)
    df = sets.select(
        "customer_id",
        dayset.nth_day(0)["day"].alias("first_order_date"),
        dayset.nth_day(-1)["day"].alias("last_order_date"),
        dayset.occasions().alias("purchase_occasions"),
        *([dayset.total("new_invoices").alias("total_invoices")] if counted else []),
        dayset.total("items").alias("total_items"),
        dayset.spend().alias("total_spend"),
        dayset.gaps().alias("__gaps"),
        *([dayset.nth_day(0)["value"].alias("first_order_value"), dayset.nth_day(0)["items"].alias("first_order_items")] if first_orders else []),
    )
    n = F.size("__gaps").cast("bigint")
    some = lambda c: F.when(n > 0, c)
    df = dayset.with_last_day(df, sets).withColumns({
        "gap_count": some(n),
        "median_gap_days": dayset.median_of(F.col("__gaps"), MEDIAN_TYPE),
        # The gaps of a history add up to its span.
        "mean_gap_days": round_div(F.datediff("last_order_date", "first_order_date"), n, 1),
        "shortest_gap_days": F.array_min("__gaps"),
        "longest_gap_days": F.array_max("__gaps"),
    })
    quiet = F.datediff("dataset_end_date", "last_order_date").cast("bigint")
    med = F.col("median_gap_days")
    tenths = (med * 10).cast("decimal(20,0)")
    df = df.withColumn("days_since_last_order", quiet)
    quiet = F.col("days_since_last_order")
    return df.select(
        "customer_id",
        "first_order_date",
        "last_order_date",
        "dataset_end_date",
        "days_since_last_order",
        "purchase_occasions",
        *(["total_invoices"] if counted else []),
        "total_items",
        "total_spend",
        avg_money("total_spend", "purchase_occasions").alias("avg_value_per_occasion"),
        "gap_count",
        "median_gap_days",
        "mean_gap_days",
        "shortest_gap_days",
        "longest_gap_days",
        F.when(med.isNull() | (med == 0), F.lit(None).cast("double"))
        .otherwise(round_div(quiet * 10, tenths, 2))
        .alias("cadence_ratio"),
        F.when(F.col("purchase_occasions") == 1, F.lit(SINGLE))
        .when(F.col("purchase_occasions") == 2, F.lit(TWO))
        .when((quiet > med * F.lit(multiple)) & (quiet >= floor_days), F.lit(OVERDUE))
        .otherwise(F.lit(WITHIN))
        .alias("cadence_segment"),
        *(["first_order_value", "first_order_items", F.get("__gaps", F.lit(0)).alias("days_to_second_purchase")] if first_orders else []),
    )


def _med_dbl(c="median_gap_days"):
    return F.col(c).cast("double")


def cadence_multiple_evidence(
    sets: DataFrame, multiples: Sequence[str] = ("1.5", "2", "2.5", "3", "4"), min_gaps: int = 2
) -> DataFrame:
    """Share of real gaps above k x the customer's own median (customers with >= min_gaps gaps)."""
    sets = dayset.of(sets)
    own = sets.select(dayset.gaps().alias("__gaps")).where(F.size("__gaps") >= min_gaps)
    g = own.select(dayset.median_of(F.col("__gaps"), MEDIAN_TYPE).alias("__med"), F.explode("__gaps").alias("gap_days"))
    aggs = [F.count(F.lit(1)).alias("historical_gaps_examined")]
    for m in multiples:
        name = "pct_exceeding_" + m.replace(".", "_") + "x"
        aggs.append(F.count_if(F.col("gap_days") > F.col("__med") * F.lit(Decimal(m))).alias(name))
    agg = g.agg(*aggs)
    cols = ["historical_gaps_examined"]
    for m in multiples:
        name = "pct_exceeding_" + m.replace(".", "_") + "x"
        cols.append(pct(name, "historical_gaps_examined", 1).alias(name))
    return agg.select(*cols)


def cadence_segment_summary(cadence: DataFrame) -> DataFrame:
    return (
        cadence.groupBy("cadence_segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("total_spend").alias("__s"),
            F.sum("median_gap_days").alias("__m"),
            F.count("median_gap_days").alias("__mn"),
            F.sum("days_since_last_order").alias("__q"),
        )
        .select(
            "cadence_segment",
            "customers",
            money("__s").alias("total_spend"),
            avg_money("__s", "customers").alias("avg_spend_per_customer"),
            round_div(as_units("__m", 1), F.col("__mn") * 10, 1).alias("avg_of_median_gaps"),
            round_div("__q", "customers", 1).alias("avg_days_quiet"),
        )
        .orderBy(F.desc("total_spend"))
    )


def cadence_at_risk_list(cadence: DataFrame) -> DataFrame:
    return (
        cadence.where(F.col("cadence_segment") == OVERDUE)
        .orderBy(F.desc("total_spend"), "customer_id")
        .select(
            "customer_id",
            money("total_spend").alias("total_spend"),
            "purchase_occasions",
            _med_dbl().alias("median_gap_days"),
            "days_since_last_order",
            "cadence_ratio",
            "last_order_date",
        )
    )


# List and movement labels of the rule comparison.
LIST_A = "A. Old rule: high-value at risk (90d + GBP1k)"
LIST_B = "B. Old rule: all at-risk repeat (90d, no spend floor)"
LIST_C = "C. New rule: overdue on own cadence (2x median)"
ON_BOTH = "On both lists"
ADDED = "ADDED by cadence rule"
DROPPED = "DROPPED by cadence rule"


def rule_before_after(profile: DataFrame, cadence: DataFrame) -> DataFrame:
    from tillroll.plans.customers import AT_RISK_SEGMENTS, HIGH_VALUE_AT_RISK

    def listed(df, cond, label):
        return df.where(cond).agg(
            F.lit(label).alias("list"),
            F.count(F.lit(1)).alias("customers"),
            money(F.sum("total_spend")).alias("total_spend"),
        )

    seg = F.col("customer_segment")
    return (
        listed(profile, seg == HIGH_VALUE_AT_RISK, LIST_A)
        .unionByName(listed(profile, seg.isin(list(AT_RISK_SEGMENTS)), LIST_B))
        .unionByName(listed(cadence, F.col("cadence_segment") == OVERDUE, LIST_C))
    )


def _movement(profile: DataFrame, cadence: DataFrame, old_segments) -> DataFrame:
    """Customers on the old list, the new list or both, with their cadence row.

    Both inputs hold one row per customer of the same basis, so one equi-join
    on customer replaces the full outer join of the two lists.
    """
    old = profile.select("customer_id", F.col("customer_segment").isin(list(old_segments)).alias("__old"))
    both = cadence.join(old, "customer_id", "left").withColumn(
        "__new", F.col("cadence_segment") == OVERDUE
    ).withColumn("__old", F.coalesce(F.col("__old"), F.lit(False)))
    label = (
        F.when(F.col("__old") & F.col("__new"), F.lit(ON_BOTH))
        .when(F.col("__new"), F.lit(ADDED))
        .otherwise(F.lit(DROPPED))
    )
    return both.where(F.col("__old") | F.col("__new")).withColumn("movement", label)


def rule_movement_like_for_like(profile: DataFrame, cadence: DataFrame) -> DataFrame:
    from tillroll.plans.customers import AT_RISK_SEGMENTS

    m = _movement(profile, cadence, AT_RISK_SEGMENTS)
    return (
        m.groupBy("movement")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("total_spend").alias("__s"),
            F.sum("median_gap_days").alias("__m"),
            F.count("median_gap_days").alias("__mn"),
            F.sum("days_since_last_order").alias("__q"),
        )
        .select(
            "movement",
            "customers",
            money("__s").alias("total_spend"),
            round_div(as_units("__m", 1), F.col("__mn") * 10, 1).alias("avg_median_gap"),
            round_div("__q", "customers", 1).alias("avg_days_quiet"),
        )
        .orderBy(F.desc("total_spend"))
    )


def rule_movement_headline(profile: DataFrame, cadence: DataFrame) -> DataFrame:
    from tillroll.plans.customers import HIGH_VALUE_AT_RISK

    m = _movement(profile, cadence, (HIGH_VALUE_AT_RISK,))
    return (
        m.groupBy("movement")
        .agg(F.count(F.lit(1)).alias("customers"), money(F.sum("total_spend")).alias("total_spend"))
        .orderBy(F.desc("total_spend"))
    )


def _disagreement(profile: DataFrame, cadence: DataFrame, flagged_by_old: bool, new_segment: str) -> DataFrame:
    from tillroll.plans.customers import AT_RISK_SEGMENTS

    in_old = F.col("customer_segment").isin(list(AT_RISK_SEGMENTS))
    cond = (in_old if flagged_by_old else ~in_old) & (F.col("cadence_segment") == new_segment)
    return cadence.join(profile.select("customer_id", "customer_segment"), "customer_id").where(cond)


def _case_columns():
    return [
        "customer_id",
        money("total_spend").alias("total_spend"),
        "purchase_occasions",
        _med_dbl().alias("median_gap_days"),
        "days_since_last_order",
        "cadence_ratio",
    ]


def old_rule_false_alarms(profile: DataFrame, cadence: DataFrame, k: int = 15) -> DataFrame:
    """Flagged by the 90-day rule but within their own rhythm: top k by spend."""
    d = _disagreement(profile, cadence, True, WITHIN)
    return d.orderBy(F.desc("total_spend"), "customer_id").limit(k).select(*_case_columns())


def old_rule_misses(profile: DataFrame, cadence: DataFrame, k: int = 15) -> DataFrame:
    """Missed by the 90-day rule but overdue on their own cadence: top k by ratio."""
    d = _disagreement(profile, cadence, False, OVERDUE)
    return d.orderBy(F.desc_nulls_first("cadence_ratio"), "customer_id").limit(k).select(*_case_columns())


def thin_history_buckets(cadence: DataFrame) -> DataFrame:
    return (
        cadence.where(F.col("cadence_segment").isin(SINGLE, TWO))
        .groupBy("cadence_segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("total_spend").alias("__s"),
            F.sum("days_since_last_order").alias("__q"),
        )
        .select(
            "cadence_segment",
            "customers",
            money("__s").alias("total_spend"),
            avg_money("__s", "customers").alias("avg_spend"),
            round_div("__q", "customers", 1).alias("avg_days_quiet"),
        )
        .orderBy(F.desc("customers"))
    )


def censoring_bucket(multiple: int = 2, floor_days: int = 30) -> F.Column:
    quiet, med = F.col("days_since_last_order"), F.col("median_gap_days")
    return (
        F.when(quiet <= med, F.lit(NOT_YET_DUE))
        .when(quiet <= med * multiple, F.lit(LATE_IN_TOLERANCE))
        .when(quiet < floor_days, F.lit(UNDER_FLOOR))
        .otherwise(F.lit(FLAGGED))
    )


def cadence_censoring(cadence: DataFrame, min_occasions: int = 3) -> DataFrame:
    return (
        cadence.where(F.col("purchase_occasions") >= min_occasions)
        .groupBy(censoring_bucket().alias("censoring_bucket"))
        .agg(F.count(F.lit(1)).alias("customers"), money(F.sum("total_spend")).alias("total_spend"))
        .orderBy("censoring_bucket")
    )


def floor_suppressed(cadence: DataFrame, multiple: int = 2, floor_days: int = 30, min_occasions: int = 3) -> DataFrame:
    """Scored customers past k x their median but quiet for less than the floor."""
    quiet, med = F.col("days_since_last_order"), F.col("median_gap_days")
    cond = (F.col("purchase_occasions") >= min_occasions) & (quiet > med * multiple) & (quiet < floor_days)
    return cadence.where(cond).agg(
        F.count(F.lit(1)).alias("customers_suppressed"),
        money(F.coalesce(F.sum("total_spend"), F.lit(0))).alias("spend_suppressed"),
    )


def same_day_collapse(grain: DataFrame) -> DataFrame:
    """Invoices against purchase occasions; customers with several invoices on a day."""
    occ = occasions(grain)
    return occ.agg(
        F.sum("invoices").alias("customer_day_invoices"),
        F.count(F.lit(1)).alias("purchase_occasions"),
        F.countDistinct(F.when(F.col("invoices") > 1, F.col("customer_id"))).alias(
            "customers_with_same_day_invoices"
        ),
        F.count_if(F.col("invoices") > 1).alias("customer_days_with_several_invoices"),
    )


def gap_distribution(sets: DataFrame) -> DataFrame:
    """Mean, exact median and longest of all real gaps."""
    from tillroll.operators.quantiles import exact_quantiles

    g = gap_table(sets).select("gap_days")
    q = exact_quantiles(g, [], "gap_days", ["0.5"], value_type="decimal(12,0)")
    agg = g.agg(
        F.count(F.lit(1)).alias("gaps_examined"),
        round_div(F.sum("gap_days"), F.count(F.lit(1)), 1).alias("mean_gap_days"),
        F.max("gap_days").alias("longest_gap_days"),
    )
    return agg.crossJoin(F.broadcast(q.select(F.col("p_0_5").cast("double").alias("median_gap_days"))))


def rule_overlap_by_basis(cadence: DataFrame, cadence_net: DataFrame) -> DataFrame:
    """Overdue lists on the published and corrected bases: common and one-sided."""
    pub = cadence.where(F.col("cadence_segment") == OVERDUE).select("customer_id", F.lit(True).alias("__p"))
    net = cadence_net.where(F.col("cadence_segment") == OVERDUE).select("customer_id", F.lit(True).alias("__n"))
    j = pub.join(net, "customer_id", "full_outer")
    return j.agg(
        F.count_if(F.col("__p") & F.col("__n")).alias("on_both_bases"),
        F.count_if(F.col("__p") & F.col("__n").isNull()).alias("published_only"),
        F.count_if(F.col("__n") & F.col("__p").isNull()).alias("corrected_only"),
    )


__all__ = ["customer_cadence", "as_units"]
