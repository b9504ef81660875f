"""Customer value distribution (corrected basis).

All quantiles over customers are exact (``exact_quantiles`` and ``top_points``:
digit histograms, no sort and no single value map).  Group shares of the whole use a one-row total
broadcast instead of ``SUM(...) OVER ()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, avg_money, avg_round, floor_div, money, pct, round_div, round_exact
from tillroll.operators import dayset
from tillroll.operators.quantiles import exact_quantiles
from tillroll.operators.selection import top_points

# Group and band labels.
ONE_TIME_BUYER = "One-time buyer"
REPEAT_BUYER = "Repeat buyer"
BANDS = ((1, 1, "1 purchase"), (2, 2, "2 purchases"), (3, 5, "3-5 purchases"), (6, 10, "6-10 purchases"))
TOP_BAND = "11+ purchases"

# Per-purchase values are carried in units of 10^-18 currency (exact for every
# terminating quotient) and rounded to pence only at the end.
_FINE = 18


def customer_value(sets: DataFrame) -> DataFrame:
    """Spend, purchase occasions and items per customer from the day sets."""
    return dayset.of(sets).select(
        "customer_id", dayset.spend().alias("spend"), dayset.occasions().alias("purchase_occasions"),
        dayset.total("items").alias("items"),
    )


def value_distribution(sets: DataFrame) -> DataFrame:
    cv = dayset.customer_spend(sets).select("spend")
    q = exact_quantiles(cv, [], "spend", ["0.25", "0.5", "0.75", "0.9"])
    agg = cv.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("spend").alias("__s"),
        F.max("spend").alias("__max"),
    )
    return agg.crossJoin(F.broadcast(q)).select(
        "customers",
        money("__s").alias("total_revenue"),
        avg_money("__s", "customers").alias("mean_spend"),
        round_exact("p_0_25", 2).alias("p25"),
        round_exact("p_0_5", 2).alias("median_spend"),
        round_exact("p_0_75", 2).alias("p75"),
        round_exact("p_0_9", 2).alias("p90"),
        money("__max").alias("largest_customer"),
    )


def mean_robustness(sets: DataFrame, top_k: int = 10, top_share_pct: int = 1) -> DataFrame:
    """Mean and median spend for all customers, without the top k, and
    without the top ``top_share_pct``% (round(n * pct / 100) customers).

    Leaving out the top x leaves the n - x smallest, whose middle lies at known
    ranks of the whole order, so all three bases are points of one selection.
    """
    n = F.col("n")
    share = F.call_function("div", n * (2 * top_share_pct) + 100, F.lit(200))
    label = F.concat(F.lit(f"Excluding the top {top_share_pct}% ("), share.cast("string"), F.lit(" customers)"))
    bases = [(F.lit(0), F.lit("All customers")), (F.lit(top_k), F.lit(f"Excluding the top {top_k}")), (share, label)]
    # From the smallest, the middle of m values is at (m - 1) div 2 and m div 2, counted from 0.
    ranks = []
    for out, _ in bases:
        ranks += [out, n - F.call_function("div", n - out - 1, F.lit(2)), n - F.call_function("div", n - out, F.lit(2))]
    cv = dayset.customer_spend(sets).select(as_units("spend", 2).alias("pence"))
    points = top_points(cv, F.col("pence"), ranks)
    rows = []
    for k, (out, basis) in enumerate(bases):
        low, high = F.col(f"value_{3 * k + 1}"), F.col(f"value_{3 * k + 2}")
        rows.append(F.struct(
            F.lit(k).alias("k"), basis.alias("basis"), (n - out).cast("bigint").alias("customers"),
            (F.col("total") - F.coalesce(F.col(f"sum_{3 * k}"), F.lit(0))).cast("decimal(38,0)").alias("pence"),
            (low + high).cast("decimal(38,0)").alias("twice_median"),
        ))
    return (
        points.where(n.isNotNull()).select(F.inline(F.array(*rows))).where(F.col("customers") > 0).orderBy("k")
        .select(
            "basis",
            "customers",
            round_div("pence", F.col("customers") * 100, 2).alias("mean_spend"),
            round_div("twice_median", F.lit(200), 2).alias("median_spend"),
        )
    )


def _group_report(cv: DataFrame, group: F.Column, name: str, extra_aggs, extra_cols, order_col: str) -> DataFrame:
    g = cv.withColumn(name, group)
    q = exact_quantiles(g, [name], "spend", ["0.5"])
    agg = g.groupBy(name).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("spend").alias("__s"),
        *extra_aggs,
    )
    totals = agg.agg(F.sum("customers").alias("__tn"), F.sum("__s").alias("__ts"))
    return (
        agg.join(q, name, "left")
        .crossJoin(F.broadcast(totals))
        .orderBy(order_col)
        .select(
            name,
            "customers",
            pct("customers", "__tn", 1).alias("pct_of_customers"),
            money("__s").alias("revenue"),
            pct(as_units("__s", 2), as_units("__ts", 2), 1).alias("pct_of_revenue"),
            avg_money("__s", "customers").alias("mean_spend"),
            round_exact("p_0_5", 2).alias("median_spend"),
            *extra_cols,
        )
    )


def one_time_vs_repeat(sets: DataFrame) -> DataFrame:
    cv = customer_value(sets)
    group = F.when(F.col("purchase_occasions") == 1, F.lit(ONE_TIME_BUYER)).otherwise(F.lit(REPEAT_BUYER))
    return _group_report(
        cv,
        group,
        "customer_group",
        [F.sum("purchase_occasions").alias("__p")],
        [avg_round("__p", "customers", 1).alias("avg_purchases")],
        "customer_group",
    )


def value_ladder(sets: DataFrame) -> DataFrame:
    cv = customer_value(sets)
    occ = F.col("purchase_occasions")
    band = F.lit(TOP_BAND)
    for lo, hi, label in reversed(BANDS):
        band = F.when(occ.between(lo, hi), F.lit(label)).otherwise(band)
    per_purchase = floor_div(as_units("spend", 2) * F.lit(2 * 10 ** (_FINE - 2)) + occ, occ * 2)
    cv = cv.withColumn("__vpp", per_purchase)
    return _group_report(
        cv,
        band,
        "purchase_band",
        [F.sum("__vpp").alias("__vpp_s"), F.min("purchase_occasions").alias("__min_occ")],
        [round_div("__vpp_s", F.col("customers").cast("decimal(38,0)") * F.lit(10**_FINE), 2).alias("mean_value_per_purchase")],
        "__min_occ",
    )
