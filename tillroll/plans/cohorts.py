"""First-purchase-month cohorts (corrected basis).

A customer's first day and active months are read off their day set; the cohort
month is the earliest of the months.  The triangle grid is cohorts x month
indexes: a cell is NULL when that month is not yet fully observed and 0 when it is
observed and nobody came back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import money, pct
from tillroll.operators import dayset

DEFAULT_TRIANGLE_MONTHS = (1, 2, 3, 4, 5, 6, 9, 11)


def first_months(sets: DataFrame) -> DataFrame:
    return dayset.of(sets).select("customer_id", F.trunc(dayset.nth_day(0)["day"], "MM").alias("cohort_month"))


def cohort_sizes(sets: DataFrame) -> DataFrame:
    sizes = first_months(sets).groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    total = sizes.agg(F.sum("cohort_size").alias("__t"))
    return (
        sizes.crossJoin(F.broadcast(total))
        .select("cohort_month", "cohort_size", pct("cohort_size", "__t", 1).alias("pct_of_customer_base"))
        .orderBy("cohort_month")
    )


def opening_pileup(sets: DataFrame, before: str | None = None, opening_days: int = 12) -> DataFrame:
    """Customers whose first purchase falls in the opening days of the data.

    ``before`` is an exclusive date; by default the first day + ``opening_days``.
    """
    firsts = dayset.of(sets).select("customer_id", dayset.nth_day(0)["day"].alias("first_date"))
    if before is None:
        bound = firsts.agg(F.date_add(F.min("first_date"), opening_days).alias("__b"))
    else:
        bound = firsts.sparkSession.range(1).select(F.lit(before).cast("date").alias("__b"))
    return (
        firsts.crossJoin(F.broadcast(bound))
        .where(F.col("first_date") < F.col("__b"))
        .groupBy("first_date")
        .agg(F.count(F.lit(1)).alias("customers_recorded_as_new"))
        .orderBy("first_date")
    )


def last_complete_month(sets: DataFrame) -> DataFrame:
    """One row: the last month fully inside the data (a month ending on the
    last day counts as complete)."""
    end = F.col("dataset_end_date")
    return dayset.last_day(dayset.of(sets)).select(
        F.when(end == F.last_day(end), F.trunc(end, "MM"))
        .otherwise(F.add_months(F.trunc(end, "MM"), -1))
        .alias("last_complete_month")
    )


def retention_triangle(
    sets: DataFrame, last_complete: str | None = None, months: Sequence[int] = DEFAULT_TRIANGLE_MONTHS
) -> DataFrame:
    spark, sets = sets.sparkSession, dayset.of(sets)
    if last_complete is None:
        bound = last_complete_month(sets)
    else:
        bound = spark.range(1).select(F.lit(last_complete).cast("date").alias("last_complete_month"))

    active = sets.select(dayset.months().alias("__months"))
    active = active.select(F.get("__months", F.lit(0)).alias("cohort_month"), F.explode("__months").alias("order_month"))
    idx = (F.year("order_month") - F.year("cohort_month")) * 12 + F.month("order_month") - F.month("cohort_month")
    counts = (
        active.crossJoin(F.broadcast(bound))
        .where(F.col("order_month") <= F.col("last_complete_month"))
        .groupBy("cohort_month", idx.alias("month_index"))
        .agg(F.count(F.lit(1)).alias("__active"))
    )
    sizes = active.where(F.col("order_month") == F.col("cohort_month")).groupBy("cohort_month").agg(
        F.count(F.lit(1)).alias("cohort_size")
    )
    top = max(months)
    grid = sizes.crossJoin(F.broadcast(bound)).withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(top))))
    cells = grid.join(counts, ["cohort_month", "month_index"], "left").withColumn(
        "__pct",
        F.when(
            F.add_months("cohort_month", F.col("month_index")) <= F.col("last_complete_month"),
            pct(F.coalesce(F.col("__active"), F.lit(0)), F.col("cohort_size"), 1),
        ),
    )
    return (
        cells.groupBy("cohort_month", "cohort_size")
        .agg(*[F.max(F.when(F.col("month_index") == m, F.col("__pct"))).alias(f"m{m}") for m in months])
        .orderBy("cohort_month")
    )


def cohort_equal_age_repeat(fsp: DataFrame, ages: Sequence[int] = (30, 60, 90)) -> DataFrame:
    obs, d2 = F.col("observation_days"), F.col("days_to_second_purchase")
    aggs, cols = [], []
    for a in ages:
        aggs += [
            F.count_if(obs >= a).alias(f"judged_at_{a}d"),
            F.count_if((obs >= a) & (d2 <= a)).alias(f"__r{a}"),
        ]
        cols += [f"judged_at_{a}d", pct(f"__r{a}", f"judged_at_{a}d", 1).alias(f"repeat_within_{a}d")]
    return (
        fsp.groupBy(F.trunc("first_purchase_date", "MM").alias("cohort_month"))
        .agg(*aggs)
        .select("cohort_month", *cols)
        .orderBy("cohort_month")
    )


def monthly_volume(grain: DataFrame) -> DataFrame:
    return (
        grain.groupBy(F.trunc("order_date", "MM").alias("order_month"))
        .agg(
            F.countDistinct("invoice_no").alias("orders"),
            F.countDistinct("customer_id").alias("active_customers"),
            money(F.sum("value")).alias("net_sales"),
        )
        .orderBy("order_month")
    )
