"""Reversal impact and revenue concentration (corrected basis unless noted).

Points of the spend order (revenue of the top N, customers that make a share)
come from ``top_points``: counts and sums per value range, so hundreds of
millions of customers are neither sorted nor ranked.  Top-k lists use
``orderBy().limit()`` on a unique tie-break (TakeOrderedAndProject).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, money, pct, round_div
from tillroll.operators.grain import latest_by
from tillroll.operators import dayset
from tillroll.operators.reversal import MATCH_KEYS, Reversals, flag_reversed, matched_both_ways, reversed_sales, unmatched_cancellations
from tillroll.operators.selection import top_points
from tillroll.storage import written


def reversed_sales_impact(sales: DataFrame, cancels: DataFrame | Reversals) -> DataFrame:
    """Published sale lines that a later cancellation reverses (each once)."""
    flagged = flag_reversed(sales, cancels)
    rev = F.col("is_reversed")
    agg = flagged.agg(
        F.count_if(rev).alias("reversed_sale_lines"),
        F.countDistinct(F.when(rev, F.col("customer_id"))).alias("customers_affected"),
        F.sum(F.when(rev, F.col("sales_value"))).alias("__r"),
        F.sum("sales_value").alias("__all"),
    )
    return agg.select(
        "reversed_sale_lines",
        "customers_affected",
        money(F.coalesce(F.col("__r"), F.lit(0))).alias("revenue_wrongly_counted"),
        pct(as_units(F.coalesce(F.col("__r"), F.lit(0)), 2), as_units("__all", 2), 2).alias(
            "pct_of_reported_net_sales"
        ),
    )


def published_vs_corrected(sales: DataFrame, net: DataFrame) -> DataFrame:
    def basis(df: DataFrame, label: str) -> DataFrame:
        return df.agg(
            F.lit(label).alias("basis"),
            F.count(F.lit(1)).alias("sales_lines"),
            F.countDistinct("customer_id").alias("customers"),
            money(F.sum("sales_value")).alias("net_sales"),
        )

    return basis(sales, "As published (vw_valid_sales)").unionByName(basis(net, "Corrected (vw_valid_sales_net)"))


def customer_spend(sets: DataFrame) -> DataFrame:
    """Spend, orders, first and last day per customer, from the day sets with counted invoices."""
    return dayset.of(sets, count_invoices=True).select(
        "customer_id",
        dayset.spend().alias("spend"),
        dayset.total("new_invoices").alias("orders"),
        dayset.nth_day(0)["day"].alias("first_order"),
        dayset.nth_day(-1)["day"].alias("last_order"),
    )


def spend_pence(sets: DataFrame) -> DataFrame:
    """Each customer's spend, in pence, from the day sets or the invoice grain."""
    return dayset.customer_spend(sets).select(as_units("spend", 2).cast("long").alias("pence"))


def pareto_test(sets: DataFrame, share: int = 80, top_pct: int = 20) -> DataFrame:
    """Customers needed for ``share``% of revenue; revenue share of the top ``top_pct``%.

    The top group size is round(n * top_pct / 100) half up, in integers.
    """
    top_n = F.call_function("div", F.col("n") * (2 * top_pct) + 100, F.lit(200))
    return top_points(spend_pence(sets), F.col("pence"), [top_n], [share]).select(
        F.col("reach_0").alias(f"customers_making_{share}pct"),
        pct("reach_0", "n", 1).alias("pct_of_customer_base"),
        pct("sum_0", "total", 1).alias(f"pct_revenue_from_top_{top_pct}pct"),
    )


# The published cut list (the last three were 10%, 20% and the
# 80%-revenue point of the original customer base; pass your own for other data).
DEFAULT_CUTS = (1, 5, 10, 20, 50, 100, 433, 865, 1170)


def concentration_curve(sets: DataFrame, cuts: Sequence[int] = DEFAULT_CUTS) -> DataFrame:
    """Cumulative revenue of the top N customers for each N in ``cuts``.

    A cut above the customer count has no rank row and yields NULL revenue.
    """
    cuts = [int(c) for c in cuts]
    points = top_points(spend_pence(sets), F.col("pence"), cuts).where(F.col("n").isNotNull())
    listed = F.array(*[F.struct(F.lit(c).cast("long").alias("cut"), F.col(f"sum_{i}").alias("cum_pence")) for i, c in enumerate(cuts)])
    return (
        points.select("n", "total", F.inline(listed))
        .select(
            F.col("cut").alias("top_n_customers"),
            pct("cut", "n", 1).alias("pct_of_customers"),
            (F.col("cum_pence") / 100).cast("double").alias("cumulative_revenue"),
            pct("cum_pence", "total", 1).alias("pct_of_revenue"),
        )
        .orderBy("top_n_customers")
    )


def home_country(net: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Latest country per customer (by time, then invoice number, then name).

    ``of``: only for these few customers (a top-k list); their lines are picked before any shuffle.
    """
    if of is not None:
        net = net.join(F.broadcast(of.select("customer_id")), "customer_id", "left_semi")
    return latest_by(net, "customer_id", "country", ["invoice_date", "invoice_no", "country"])


def top10_customers(grain: DataFrame, net: DataFrame, k: int = 10) -> DataFrame:
    cs = customer_spend(grain)
    total = cs.agg(as_units(F.sum("spend"), 2).alias("__t"))
    top = cs.orderBy(F.desc("spend"), "customer_id").limit(k)
    top = top.join(home_country(net, top), "customer_id").crossJoin(F.broadcast(total))
    w = Window.orderBy(F.desc("spend"), "customer_id")
    return top.select(
        F.row_number().over(w).cast("bigint").alias("rank"),
        "customer_id",
        money("spend").alias("lifetime_spend"),
        pct(as_units("spend", 2), "__t", 2).alias("pct_of_revenue"),
        "orders",
        "country",
        "first_order",
        "last_order",
    ).orderBy("rank")


def top10_exposure(grain: DataFrame, k: int = 10) -> DataFrame:
    spend = dayset.customer_spend(grain)
    totals = spend.agg(as_units(F.sum("spend"), 2).alias("t"), F.count(F.lit(1)).alias("n"))
    top = (
        spend.orderBy(F.desc("spend"), "customer_id")
        .limit(k)
        .agg(as_units(F.sum("spend"), 2).alias("s"), F.count(F.lit(1)).alias("k"))
    )
    return top.crossJoin(F.broadcast(totals)).select(
        (F.col("s") / 100).cast("double").alias("top10_revenue"),
        pct("s", "t", 2).alias("pct_of_total_revenue"),
        round_div("s", F.col("k") * 100, 2).alias("avg_top10_customer"),
        round_div("t", F.col("n") * 100, 2).alias("avg_customer_overall"),
        round_div(F.col("s") * F.col("n"), F.col("k") * F.col("t"), 0).alias("each_worth_x_average_customers"),
        round_div(F.col("s") * F.col("n"), F.col("t"), 0).alias("avg_customers_needed_to_replace_all_10"),
    )


def top10_geography(grain: DataFrame, net: DataFrame, k: int = 10) -> DataFrame:
    spend = dayset.customer_spend(grain)
    total = spend.agg(as_units(F.sum("spend"), 2).alias("__t"))
    top = spend.orderBy(F.desc("spend"), "customer_id").limit(k)
    top = top.join(home_country(net, top), "customer_id")
    return (
        top.groupBy("country")
        .agg(F.count(F.lit(1)).alias("customers_in_top_10"), as_units(F.sum("spend"), 2).alias("__c"))
        .crossJoin(F.broadcast(total))
        .select(
            "country",
            "customers_in_top_10",
            (F.col("__c") / 100).cast("double").alias("revenue"),
            pct("__c", "__t", 2).alias("pct_of_all_revenue"),
        )
        .orderBy(F.desc("revenue"), "country")
    )


def unmatched_cancellation_summary(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    u = unmatched_cancellations(sales, cancels)
    return u.agg(
        F.count(F.lit(1)).alias("unmatched_lines"),
        money(F.coalesce(F.sum("cancellation_value"), F.lit(0))).alias("unmatched_value"),
    )


def reversal_bracket(lines: DataFrame) -> DataFrame:
    """Upper bound, measured fix and unmatched value -> range of true net sales.

    The columns of ``trade_lines`` that the match needs are written once; the reversal index and the match read them.
    """
    back = F.col("cancelled")
    lines = written(lines.select("cancelled", *MATCH_KEYS, "invoice_date", "value"), "trade-lines")
    met = matched_both_ways(lines, Reversals(lines.where(back)))
    known = back & F.col("identified")
    fix = ~back & (F.col("last_reversal_at") >= F.col("at"))
    unmatched = known & (F.col("first_sale_at").isNull() | (F.col("first_sale_at") > F.col("at")))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("value"))), F.lit(0))
    return met.agg(
        total(known).alias("__upper"), total(fix).alias("__fix"), total(unmatched).alias("__un"),
        F.sum(F.when(~back, F.col("value"))).alias("__pub"),
    ).select(
        money("__upper").alias("upper_bound_all_identified_cancellations"),
        money("__fix").alias("measured_reversed_sales"),
        money("__un").alias("unmatched_cancellation_value"),
        money(F.col("__pub") - F.col("__upper")).alias("net_sales_low"),
        money(F.col("__pub") - F.col("__fix")).alias("net_sales_high"),
    )


def reversal_delay_summary(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """Reversed sale lines and the minutes to their earliest reversal,
    aggregated on the (key, day, time) grid weighted by its line counts."""
    from tillroll.operators.reversal import next_reversal_grid

    g = next_reversal_grid(sales, cancels)
    agg = g.agg(
        F.sum("lines").alias("reversed_sale_lines"),
        F.min("minutes_to_reversal").alias("fastest_minutes"),
        F.max("minutes_to_reversal").alias("slowest_minutes"),
        F.sum(F.col("minutes_to_reversal") * F.col("lines")).alias("__m"),
    )
    return agg.select(
        F.coalesce(F.col("reversed_sale_lines"), F.lit(0)).cast("bigint").alias("reversed_sale_lines"),
        "fastest_minutes",
        "slowest_minutes",
        round_div("__m", "reversed_sale_lines", 1).alias("mean_minutes"),
    )


__all__ = [
    "reversed_sales_impact", "published_vs_corrected", "pareto_test", "concentration_curve",
    "home_country", "top10_customers", "top10_exposure", "top10_geography", "reversed_sales",
    "unmatched_cancellation_summary", "reversal_bracket", "reversal_delay_summary",
]
