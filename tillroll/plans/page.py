"""A report page: every card under many filter contexts, from one read of the lines.

A page has a card row per slicer setting (a quarter, a market, a product line).
Asked one by one, each setting reads the lines again.  Here every line gets a bit
mask, one bit per slicer it is in, and

1. lines are summed per (sale or cancellation, invoice, customer, mask) -- partial
   sums in the tasks, the only shuffle of line-level work;
2. each of these rows stands for three things, told apart by a label: its sums,
   its invoice, its customer.  Rows are brought together per (label, name), with
   the masks of an invoice or a customer united, so each is counted once per
   context whatever its lines are spread over;
3. what is left is counted per mask -- contexts, not data, bound this table -- and
   the bits are told off to the contexts.

Sums, counts and distinct counts equal those of the single calls exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exact import as_units, money
from tillroll.operators.cube import Cube, build_cube
from tillroll.plans.clean import as_trade_lines
from tillroll.plans.measures import Slicer, _divide0

CUBE_DIMS = ("order_month", "country")


def sales_cube(sales: DataFrame) -> Cube:
    """Sums and mergeable distinct counts of a sales basis by month and country."""
    return build_cube(sales, CUBE_DIMS, {"orders": "invoice_no", "customers": "customer_id"}, {"value": "sales_value", "items": "quantity"})


def measures_from(cube: Cube, by: Sequence[str] = (), months: tuple[str, str] | None = None, countries: Sequence[str] | None = None) -> DataFrame:
    """The sales measures of ``measures_by`` from the cube alone: whole months (first and last, as dates) and countries."""
    where = F.lit(True)
    if months:
        where = where & F.col("order_month").between(*[F.trunc(F.lit(m).cast("date"), "MM") for m in months])
    if countries:
        where = where & F.col("country").isin(list(countries))
    told = cube.ask(by, where)
    total = F.coalesce(F.col("value"), F.lit(0))
    return told.select(
        *by,
        money(total).alias("m_net_sales"),
        F.col("orders").alias("m_total_orders"),
        F.col("customers").alias("m_unique_customers"),
        _divide0(as_units(total, 2), F.col("orders") * 100).alias("m_average_order_value"),
        F.coalesce(F.col("items"), F.lit(0)).cast("bigint").alias("m_total_items"),
    )


#: Contexts of a page: the bits of a mask.
MOST_CONTEXTS = 62


def context_mask(slicers: list[Slicer], day: str) -> Column:
    """One bit for each slicer a row is in."""
    mask = F.lit(0).cast("long")
    for i, s in enumerate(slicers):
        mask = mask + F.when(s.holds(day), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return mask


def _cards(lines: DataFrame, mask: Column) -> DataFrame:
    """(context, and the cards of its sales and cancellations)."""
    sold = ~F.col("cancelled")
    held = lines.select(
        "cancelled", "invoice_no", F.when(sold, F.col("customer_id")).alias("customer_id"), mask.alias("mask"), "value", F.when(sold, F.col("quantity")).alias("quantity")
    ).groupBy("cancelled", "invoice_no", "customer_id", "mask").agg(
        F.sum("value").cast("decimal(38,2)").alias("v"), F.sum("quantity").cast("long").alias("q"))
    kind = lambda back, sale: F.when(F.col("cancelled"), F.lit(back)).otherwise(F.lit(sale))
    none = [F.lit(None).cast("decimal(38,2)").alias("v"), F.lit(None).cast("long").alias("q")]
    sums = F.struct(kind("back", "sold").alias("label"), F.col("mask").cast("string").alias("name"), "mask", "v", "q")
    invoice = F.struct(kind("invoices", "orders").alias("label"), F.col("invoice_no").alias("name"), "mask", *none)
    customer = F.struct(F.lit("customers").alias("label"), F.col("customer_id").alias("name"), "mask", *none)
    # Lines of no context go here, not before: a filter on the mask would move to the lines and work the mask out twice.
    told = held.select(F.inline(F.array(sums, invoice, customer))).where("name IS NOT NULL AND mask > 0")
    once = told.groupBy("label", "name").agg(F.bit_or("mask").alias("mask"), F.sum("v").cast("decimal(38,2)").alias("v"), F.sum("q").alias("q"))
    few = once.groupBy("label", "mask").agg(F.count(F.lit(1)).alias("things"), F.sum("v").cast("decimal(38,2)").alias("v"), F.sum("q").alias("q"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(MOST_CONTEXTS - 1)), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    of = lambda label, what: F.sum(F.when(F.col("label") == label, F.col(what)))
    return few.select(F.explode(bits).alias("at"), "label", "things", "v", "q").groupBy("at").agg(
        of("sold", "v").cast("decimal(38,2)").alias("value"), of("sold", "q").alias("quantity"), of("back", "v").cast("decimal(38,2)").alias("back"),
        *[of(label, "things").alias(label) for label in ("orders", "customers", "invoices")],
    )


def kpi_page(sales: DataFrame, cancels: DataFrame, contexts: Mapping[str, Slicer], slice_cancellations: bool = False) -> DataFrame:
    """One row per context with all card measures, like ``kpi_measures`` of each.

    A context that holds no line has its row of zeros.
    """
    return page_of(as_trade_lines(sales, cancels), contexts, slice_cancellations)


def page_of(lines: DataFrame, contexts: Mapping[str, Slicer], slice_cancellations: bool = False) -> DataFrame:
    """``kpi_page`` from ``trade_lines``: one read for sales and cancellations."""
    if not 0 < len(contexts) <= MOST_CONTEXTS:
        raise ValueError(f"a page has 1 to {MOST_CONTEXTS} contexts, not {len(contexts)}")
    spark, slicers = lines.sparkSession, list(contexts.values())
    mask = context_mask(slicers, "day")
    if not slice_cancellations:
        mask = F.when(F.col("cancelled"), F.lit((1 << len(slicers)) - 1).cast("long")).otherwise(mask)
    page = spark.createDataFrame([(i, name) for i, name in enumerate(contexts)], "at int, context string")
    out = page.join(_cards(lines, mask), "at", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.orderBy("at").select(
        "context",
        money(zero("value")).alias("m_net_sales"),
        zero("orders").alias("m_total_orders"),
        zero("customers").alias("m_unique_customers"),
        _divide0(as_units(zero("value"), 2), zero("orders") * 100).alias("m_average_order_value"),
        zero("quantity").cast("bigint").alias("m_total_items"),
        money(zero("back")).alias("m_cancelled_value"),
        zero("invoices").alias("m_cancelled_invoices"),
        _divide0(zero("invoices"), zero("invoices") + zero("orders")).alias("m_cancellation_rate"),
    )
