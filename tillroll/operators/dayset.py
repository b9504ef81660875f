"""The day set: a customer's whole purchase history in one row, from one aggregate.

A day is (date, items, value, invoices) and a set is the sorted array of a
customer's days.  It is built by partial aggregates, invoice grain -> days ->
set, so a hot customer is summed before anything of theirs is brought together,
and an array holds at most one entry per calendar day.

Everything per customer is then read off the array in the row: first, second and
last day, gaps and their median, active months, spend, first-order value.  No
window, no join, no second pass over the lines.  A report that needs one set
twice (say for the last day of the data) reads its one exchange twice: the set
is a single column, so all readers ask for the same aggregate, and Spark
reuses the exchange under it.

``day_sets(count_invoices=True)`` also counts each invoice on its first day, so
that an invoice written over several days is one in the customer's total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = "days"


def day_sets(grain: DataFrame, count_invoices: bool = False) -> DataFrame:
    """(customer_id, days) from the (customer, day, invoice) grain."""
    fields = ["items", "value", "invoices"]
    sums = [F.sum("items").cast("bigint").alias("items"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("invoices")]
    if count_invoices:
        # The days of one invoice: nearly always one, at most a calendar.
        invoice = grain.groupBy("customer_id", "invoice_no").agg(
            F.array_sort(F.collect_list(F.struct("order_date", "items", "value"))).alias("on")
        )
        grain = invoice.select("customer_id", F.posexplode("on").alias("nth", "d")).select("customer_id", "nth", "d.*")
        sums.append(F.count_if(F.col("nth") == 0).alias("new_invoices"))
        fields.append("new_invoices")
    by_day = grain.groupBy("customer_id", "order_date").agg(*sums)
    day = F.struct(F.col("order_date").alias("day"), *fields)
    return by_day.groupBy("customer_id").agg(F.array_sort(F.collect_list(day)).alias(DAYS))


def of(relation: DataFrame, count_invoices: bool = False) -> DataFrame:
    """Day sets as they are, or those of an invoice grain."""
    return relation if DAYS in relation.columns else day_sets(relation, count_invoices)


def counts_invoices(sets: DataFrame) -> bool:
    return "new_invoices" in sets.schema[DAYS].dataType.elementType.names


def nth_day(i: int) -> Column:
    """The i-th day (from 0; -1 is the last), null beyond."""
    days = F.col(DAYS)
    return F.get(days, F.lit(i)) if i >= 0 else F.get(days, F.size(days) + i)


def occasions() -> Column:
    return F.size(DAYS).cast("bigint")


def total(field: str, kind: str = "bigint") -> Column:
    """The sum of a field over a customer's days."""
    return F.aggregate(DAYS, F.lit(0).cast(kind), lambda acc, d: (acc + d[field]).cast(kind))


def spend() -> Column:
    return total("value", "decimal(38,2)")


def customer_spend(relation: DataFrame) -> DataFrame:
    """(customer_id, spend) off day sets, or straight from an invoice grain, which needs no set for it."""
    if DAYS in relation.columns:
        return relation.select("customer_id", spend().alias("spend"))
    return relation.groupBy("customer_id").agg(F.sum("value").cast("decimal(38,2)").alias("spend"))


def gaps() -> Column:
    """Whole days between consecutive purchase days, in order; none for a single day."""
    days = F.col(DAYS)
    later, earlier = F.slice(days, 2, F.size(days)), F.slice(days, 1, F.size(days) - 1)
    return F.zip_with(later, earlier, lambda b, a: F.datediff(b["day"], a["day"]).cast("bigint"))


def median_of(values: Column, kind: str) -> Column:
    """The exact median of a small array of whole numbers, null if it is empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.call_function("div", n - 1, F.lit(2)).cast("int"))
    high = F.get(ordered, F.call_function("div", n, F.lit(2)).cast("int"))
    return F.when(n > 0, ((low + high).cast("decimal(20,0)") / 2)).cast(kind)


def months() -> Column:
    """The months a customer bought in, earliest first."""
    return F.array_distinct(F.transform(DAYS, lambda d: F.trunc(d["day"], "MM")))


def last_day(sets: DataFrame) -> DataFrame:
    """One row: the last order date of this basis ("now" of the data)."""
    return sets.select(nth_day(-1)["day"].alias("__last")).agg(F.max("__last").alias("dataset_end_date"))


def with_last_day(df: DataFrame, sets: DataFrame) -> DataFrame:
    """Attach the one-row end date (broadcast: exactly one row by construction).

    The join stays even where no one reads the date, so only ask for it where it is read.
    """
    return df.crossJoin(F.broadcast(last_day(sets)))
