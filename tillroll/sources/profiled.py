"""Data quality while loading: the figures of a raw table, from the pass that writes it.

Counts, nulls, extremes and sums are *observed* (``DataFrame.observe``): the tasks that
write the table add them up beside, so no figure costs a scan.  Distinct counts can't be
observed.  They come from one narrow aggregate over the written table, in which every
line stands for its invoice, its customer and its (country, invoice), each with a mask of
what it was seen as; nothing is expanded beyond distinct things.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillroll.functions.exact import money
from tillroll.plans.clean import is_cancellation
from tillroll.sources.files import read_raw_parquet, write_raw_parquet

_NULLABLE = ["invoice_no", "stock_code", "description", "customer_id", "country"]
#: What a thing was seen as: on any line, on a cancellation, on a valid sale.
ANY, CANCELLED, SOLD = 1, 2, 4


def _valid_sale() -> F.Column:
    """The rule of ``clean.valid_sales`` as a condition, false where it is unknown."""
    kept = (
        ~is_cancellation() & (F.col("quantity") > 0) & (F.col("unit_price") > 0)
        & F.col("description").isNotNull() & F.col("customer_id").isNotNull()
    )
    return F.coalesce(kept, F.lit(False))


def _observed() -> list[F.Column]:
    value = F.round(F.col("quantity") * F.col("unit_price"), 2)
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.min("invoice_date").alias("earliest_transaction"),
        F.max("invoice_date").alias("latest_transaction"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in _NULLABLE],
        F.count_if(F.coalesce(is_cancellation(), F.lit(False))).alias("cancellation_lines"),
        F.count_if(F.col("quantity") <= 0).alias("non_positive_quantity"),
        F.count_if(F.col("unit_price") <= 0).alias("non_positive_price"),
        F.count_if(_valid_sale()).alias("valid_sales_lines"),
        F.sum(F.when(_valid_sale(), value)).alias("net_sales"),
    ]


@dataclass
class Profile:
    """``figures``: one row with all single figures.  ``countries``: (country, invoices)."""

    figures: DataFrame
    countries: DataFrame

    def row_count(self) -> DataFrame:
        return self.figures.select("total_rows")

    def date_range(self) -> DataFrame:
        return self.figures.select("earliest_transaction", "latest_transaction")

    def missing_values(self) -> DataFrame:
        return self.figures.select(*[f"missing_{c}" for c in _NULLABLE])

    def cancellation_counts(self) -> DataFrame:
        return self.figures.select("cancelled_invoices", "cancellation_lines")

    def non_positive(self) -> DataFrame:
        return self.figures.select("non_positive_quantity", "non_positive_price")

    def sales_sanity(self) -> DataFrame:
        return self.figures.select("valid_sales_lines", "valid_orders", "identified_customers", money("net_sales").alias("net_sales"))

    def country_invoices(self) -> DataFrame:
        return self.countries.orderBy(F.desc("invoices"), F.asc_nulls_first("country"))


def distinct_things(raw: DataFrame) -> DataFrame:
    """(kind, country, seen, things): how many invoices, customers and (country, invoice) pairs were seen as what."""
    seen = F.lit(ANY) + F.when(F.coalesce(is_cancellation(), F.lit(False)), CANCELLED).when(_valid_sale(), SOLD).otherwise(0)
    # Lines of one invoice are alike in most of this, so they are summed up before anything is told apart.
    alike = raw.groupBy("invoice_no", "customer_id", "country").agg(F.bit_or(seen).alias("seen"))
    none = F.lit(None).cast("string")
    thing = lambda kind, country, name: F.struct(
        F.lit(kind).alias("kind"), country.alias("country"), F.col(name).alias("name"), F.col("seen"))
    told = alike.select(F.inline(F.array(
        thing("invoice", none, "invoice_no"), thing("customer", none, "customer_id"), thing("pair", F.col("country"), "invoice_no"))))
    once = told.groupBy("kind", "country", "name").agg(F.bit_or("seen").alias("seen"))
    return once.groupBy("kind", "country", "seen").agg(
        F.count("name").alias("things"), F.count(F.lit(1)).alias("with_null"))


def write_raw_profiled(raw: DataFrame, path: str) -> Profile:
    """Write the raw table and return its data-quality figures."""
    spark, watch = raw.sparkSession, Observation("raw profile")
    write_raw_parquet(raw.observe(watch, *_observed()), path)
    got = watch.get
    things = distinct_things(read_raw_parquet(spark, path))
    counted = things.groupBy("kind", "country").agg(
        F.sum("things").alias("any"),
        *[F.sum(F.when(F.col("seen").bitwiseAND(F.lit(bit)) > 0, F.col("things")).otherwise(0)).alias(n) for n, bit in (("cancelled", CANCELLED), ("sold", SOLD))],
    )
    # One row a country and two more: what there is of kinds and countries, whatever the data.
    rows = counted.collect()
    of = {r["kind"]: r for r in rows if r["kind"] != "pair"}
    at = lambda kind, n: int(of[kind][n] or 0) if kind in of else 0
    figures = {**got, "cancelled_invoices": at("invoice", "cancelled"), "valid_orders": at("invoice", "sold"), "identified_customers": at("customer", "sold")}
    kinds = {f.name: f.dataType.simpleString() for f in raw.agg(*_observed()).schema.fields}
    schema = ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in figures)
    countries = [(r["country"], int(r["any"])) for r in rows if r["kind"] == "pair"]
    return Profile(
        spark.createDataFrame([tuple(figures.values())], schema),
        spark.createDataFrame(countries, "country string, invoices bigint"),
    )
