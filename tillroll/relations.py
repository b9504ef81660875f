"""The derived relations of one raw table, built lazily and shared by jobs.

Each property is a DataFrame plan that Catalyst inlines (like a SQL view); only
the index of reversal keys, which is small beside the lines, is written when the
corrected basis is first asked for.  For batch runs, ``shared=True`` writes the invoice
grain of each basis once for all reports, and ``materialise`` does the same for
the corrected sales; both go to the cluster's checkpoint directory.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import reversal
from tillroll.operators.dayset import day_sets
from tillroll.operators.grain import invoice_grain, reuse
from tillroll.plans import clean
from tillroll.storage import fresh_path


class Relations:
    def __init__(self, raw: DataFrame, home_country: str = "United Kingdom", shared: bool = False, partitions: int | None = None):
        """``partitions``: how many of them line-level work needs; None leaves it to the session."""
        self.raw = raw
        self.partitions = partitions
        self.home_country = home_country
        self.shared = shared

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    @classmethod
    def from_star(cls, spark: SparkSession, sf_dir: str, home_country: str = "NATION_0") -> "Relations":
        from tillroll.sources.star import partitions_for, raw_from_star

        n = partitions_for(spark, sf_dir)
        return cls(raw_from_star(spark, sf_dir, n), home_country=home_country, partitions=n)

    @classmethod
    def from_tables(cls, spark: SparkSession, name: str, **options) -> "Relations":
        """The relations of raw lines stored by ``sources.tables.write_raw_tables``.

        Sales are read from the buckets of identified customers alone, so customer-level jobs
        need no exchange by customer; reversals join them bucket by bucket unless the index is
        small enough to be broadcast.
        """
        from tillroll.sources.tables import read_raw_tables

        known, others, index = read_raw_tables(spark, name)
        r = cls(known.unionByName(others), **options)
        r.__dict__["sales"] = clean.valid_sales(known)
        r.__dict__["reversals"] = reversal.Reversals(None, index=index, most_buckets=0)
        return r

    @cached_property
    def sales(self) -> DataFrame:
        return clean.valid_sales(self.raw)

    @cached_property
    def cancels(self) -> DataFrame:
        return clean.cancellations(self.raw)

    @cached_property
    def lines(self) -> DataFrame:
        """Sales and cancellations from one read, for reports on both."""
        return clean.trade_lines(self.raw)

    @cached_property
    def reversals(self) -> reversal.Reversals:
        """The index of reversal keys, written once; its size decides how sales meet it."""
        return reversal.Reversals(self.cancels)

    @cached_property
    def net(self) -> DataFrame:
        return reversal.valid_sales_net(self.sales, self.reversals)

    @cached_property
    def grain(self) -> DataFrame:
        """Published sales at the (customer, day, invoice) grain."""
        return self._once(invoice_grain(self.sales))

    @cached_property
    def grain_net(self) -> DataFrame:
        """Corrected sales at the (customer, day, invoice) grain."""
        if "materialised" in self.__dict__:
            return self._once(invoice_grain(self.net))
        return self._once(self.reversals.net_grain(self.sales))

    def _once(self, df: DataFrame) -> DataFrame:
        return reuse(df) if self.shared else df

    @cached_property
    def days(self) -> DataFrame:
        """The day set of each customer, published basis."""
        return day_sets(self.grain)

    @cached_property
    def days_net(self) -> DataFrame:
        """The day set of each customer, corrected basis."""
        return day_sets(self.grain_net)

    @cached_property
    def cube(self):
        """Published sales by month and country: sums and mergeable distinct counts, built in one pass and kept."""
        from tillroll.plans.page import sales_cube

        return sales_cube(self.sales)

    @cached_property
    def profile(self) -> DataFrame:
        from tillroll.plans.customers import customer_profile

        return customer_profile(day_sets(self.grain, count_invoices=True))

    @cached_property
    def segments(self) -> DataFrame:
        """The profile without the spend quintile (no global spend ranking)."""
        from tillroll.plans.customers import customer_profile

        return customer_profile(day_sets(self.grain, count_invoices=True), quintiles=None)

    @cached_property
    def cadence(self) -> DataFrame:
        """The cadence view, with each customer's number of invoices."""
        from tillroll.plans.cadence import customer_cadence

        return customer_cadence(day_sets(self.grain, count_invoices=True))

    @cached_property
    def cadence_net(self) -> DataFrame:
        from tillroll.plans.cadence import customer_cadence

        return customer_cadence(day_sets(self.grain_net, count_invoices=True))

    @cached_property
    def cadence_days(self) -> DataFrame:
        """The cadence view without numbers of invoices, for reports that don't read them."""
        from tillroll.plans.cadence import customer_cadence

        return customer_cadence(self.days)

    @cached_property
    def cadence_days_net(self) -> DataFrame:
        from tillroll.plans.cadence import customer_cadence

        return customer_cadence(self.days_net)

    @cached_property
    def stories_net(self) -> DataFrame:
        """The corrected cadence with each customer's first order."""
        from tillroll.plans.cadence import customer_cadence

        return customer_cadence(self.days_net, first_orders=True)

    @cached_property
    def first_second(self) -> DataFrame:
        from tillroll.plans.second_purchase import first_second_purchase

        return first_second_purchase(self.days_net)

    @cached_property
    def first_second_days(self) -> DataFrame:
        """First and second purchases without the observation span, for reports that don't read it."""
        from tillroll.plans.second_purchase import first_second_purchase

        return first_second_purchase(self.days_net, observed=False)

    def materialise(self, path: str | None = None) -> "Relations":
        """Write the corrected-basis sales once and read them back.

        ``path`` defaults to a folder of this call's own under the shared
        checkpoint directory; the written table also cuts the lineage of later jobs.
        """
        target = path or fresh_path(self.spark, "net-sales")
        self.net.write.mode("overwrite").parquet(target)
        self.__dict__["net"] = self.spark.read.parquet(target)
        self.__dict__["materialised"] = target
        for name in ("grain_net", "days_net", "cadence_net", "cadence_days_net", "stories_net", "first_second", "first_second_days"):
            self.__dict__.pop(name, None)
        return self
